"""What the join of op7 shuffles: the same at any size, and no text twice."""

import re

from reelwise.llm.lines import dedup_lines


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_shuffle_a_text_once(spark, copies, tmp_path):
    spark.createDataFrame(copies, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    physical = plan_of(dedup_lines(docs))
    join = re.search(r"ShuffledHashJoin \[doc#\d+L, row#\d+L\], \[doc#\d+L, row#\d+L\], LeftOuter", physical)
    assert join
    sent = re.search(r"Project \[(.*)\]", physical[join.end() :]).group(1)
    assert "AS own#" in sent and "AS row#" in sent
    assert not re.search(r"(^|, )text#\d+(,|$)", re.sub(r"\([^()]*\)", "", sent))
