"""The pipeline's stages against brute force on what each one was given."""

from pathlib import Path

import corpus_pipeline as pipeline
import public_tokenizers
import sentencepiece
from test_dedup import brute_lines, brute_near
from test_native import brute_hits

from reelwise.llm.toxicity import toxicity

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    given, seen = docs.collect(), {}
    for name, stage in pipeline.STAGES:
        frame = spark.createDataFrame(given, docs.schema)
        after = stage(spark, frame, FOLDER).collect()
        seen[name] = after
        rows = [(r.doc_id, r.text) for r in given]
        if name == "toxicity":
            rejected = {r.doc_id for r in toxicity(frame, spark.read.parquet(f"{FOLDER}/labels.parquet")).collect() if r.predicted}
            assert rejected and {r.doc_id for r in after} == {d for d, _ in rows} - rejected
        if name == "line_dedup":
            wanted = {doc: kept for doc, _, _, kept in brute_lines(rows, 40, 5)}
            assert {r.doc_id: r.text for r in after} == wanted and all(r.n_chars == len(r.text) for r in after)
        if name == "near_duplicates":
            assert {r.doc_id for r in after} == {doc for doc, _, _, kept in brute_near(rows, 5, 80) if kept}
        if name == "decontamination":
            assert {r.doc_id for r in after} == {doc for doc, _, hit, _, _ in brute_hits(rows, items, 10) if not hit}
        if name == "sentencepiece":
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert {r.doc_id: list(r.ids) for r in after} == {doc: library.encode(text) for doc, text in rows}
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in after)
        else:
            assert list(after[0].asDict()) == docs.columns
        given = after
    assert sorted(r.doc_id for r in pipeline.run(spark, FOLDER).collect()) == sorted(r.doc_id for r in seen["sentencepiece"])
    assert Path(pipeline.__file__).name == "corpus_pipeline.py"


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_nulls_repeated_ids_and_other_columns(spark):
    plain = " ".join(f"w{i}" for i in range(40))
    rows = [(1, plain), (1, plain), (2, plain + " end"), (3, None), (3, None), (4, ""), (None, "some words of a row without an id"), (5, "one two")]
    frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, score int")
    seen = {}
    for name, stage in pipeline.STAGES:
        frame = spark.createDataFrame(stage(spark, frame, FOLDER).collect(), stage(spark, frame, FOLDER).schema)
        seen[name] = sorted((r.doc_id if r.doc_id is not None else -1) for r in frame.collect())
    assert seen["toxicity"] == seen["line_dedup"] == [-1, 1, 1, 2, 3, 3, 4, 5]
    assert seen["near_duplicates"] == seen["sentencepiece"] == [-1, 1, 1, 3, 3, 4, 5]
    assert {r.doc_id: r.n_tokens for r in frame.collect()}[3] == 0
