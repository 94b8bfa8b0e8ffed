from pyspark.sql import functions as F

from reelwise.llm.quality import quality_rules


def test_every_label_counts(spark):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id")).filter("pmod(crc32(cast(doc_id as string)), 5) != 0")
    # Documents whose labels come last by id hash, beyond any bounded sample.
    last = [r.doc_id for r in labels.orderBy(F.desc(F.xxhash64("doc_id"))).limit(200).collect()]
    good = " ".join(f"plain word number{i} here" for i in range(12))
    bad = " ".join(f"buy cheap pills{i} now" for i in range(12))
    docs = spark.createDataFrame([(d, good if n % 2 else bad) for n, d in enumerate(last)], "doc_id long, text string")
    is_bad = F.col("doc_id").isin([d for n, d in enumerate(last) if n % 2 == 0])
    out = quality_rules(docs, labels.withColumn("quality", F.when(is_bad, 0).otherwise(1))).collect()
    assert {r.doc_id for r in out if r.kept} == {d for n, d in enumerate(last) if n % 2}
