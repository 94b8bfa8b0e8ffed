"""Which texts the join with the labels shuffles: the same at any size."""

import re

from reelwise.llm import quality


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_only_texts_that_can_be_trusted_meet_the_labels(spark, copies, tmp_path, monkeypatch):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in copies], "doc_id long, quality int")
    plans, settle = [], quality.settle
    monkeypatch.setattr(quality, "settle", lambda df: plans.append(plan_of(df)) or settle(df))
    whole = quality.quality_rules(docs, labels).count()
    assert whole == len(copies)
    counted = [physical for logical, physical in plans if "_t" in logical and "LeftOuter" in physical and "_text" in physical]
    assert counted
    for physical in counted:
        assert re.search(r"ShuffledHashJoin \[_doc#\d+L?\], \[_id#\d+L?\], LeftOuter", physical)
        assert "pmod(crc32(" in physical  # ids of other remainders stay out of the shuffle
