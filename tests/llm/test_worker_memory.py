import pyarrow as pa

from reelwise.llm import sentencepieces as S


def test_codec_ends_with_its_task(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string").coalesce(1)
    coded = S.encode(docs, S.read_model(public_tokenizers.path("piece_bpe_32k.model")), cache=100, keep=False)
    assert {r.doc_id: r.decoded for r in coded.collect()} == {1: "some words", 2: ""}

    def left(batches):
        from reelwise.llm import sentencepieces

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sentencepieces._CODECS)] * batch.num_rows)], names=["n"])

    assert sum(r.n for r in spark.range(0, 64, 1, 8).mapInArrow(left, "n long").collect()) == 0
