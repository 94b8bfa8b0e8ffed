"""The encoder against the library, on fuzzed and table texts."""

import random

import pytest
import public_tokenizers
import sentencepiece

from reelwise.llm.sentencepieces import Codec, encode, read_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return Codec(read_model(PATH))


def ids_of(coder, text):
    import numpy as np

    return np.frombuffer(coder.encode(text)[0], np.int32).tolist()


def test_fuzzed_texts(coder, library):
    draw = random.Random(5)
    alphabets = ["ab ", "the and ion er", "  \n\t", "éèçß 漢字▁🙂‍", "aeiou.,!?'\"-()[]{}0123456789 ", "<s></s><unk><0x41>", "á  \x00\x7f"]
    samples = ["", " ", "   ", "a" * 500, " " * 77, "▁x", "hello world" * 30]
    for _ in range(1500):
        letters = draw.choice(alphabets) + draw.choice(alphabets)
        samples.append("".join(draw.choice(letters) for _ in range(draw.randint(1, 60))))
    samples += ["".join(chr(draw.choice([draw.randint(1, 0x24F), draw.randint(0x400, 0x9FFF), draw.randint(0x1F300, 0x1F6FF)])) for _ in range(30)) for _ in range(300)]
    for text in samples:
        wanted = library.encode(text)
        assert ids_of(coder, text) == wanted, text
        assert coder.encode(text)[1] == library.decode(wanted), text


def test_decode_any_ids(coder, library):
    draw = random.Random(6)
    for _ in range(300):
        ids = [draw.choice([draw.randint(0, 31999), draw.randint(0, 262)]) for _ in range(draw.randint(0, 12))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_table_with_nulls_and_clashes(spark, library):
    rows = [(1, "the cat", "x"), (None, None, None), (3, "", "y"), (1, "the cat", "x"), (4, "é" * 3000 + " end", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df, read_model(PATH)).collect()
    assert [r.doc_id for r in got] == [1, None, 3, 1, 4]
    for row, source in zip(got, rows):
        assert row.ids == library.encode(source[1] or "") and row.decoded == library.decode(row.ids)
    assert encode(df.limit(0), read_model(PATH)).count() == 0
