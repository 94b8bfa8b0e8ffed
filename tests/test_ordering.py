"""Ranks, totals and quantiles on skewed data against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelwise.functions import ordering
from reelwise.functions.ordering import exact_quantiles, ordinal, running_totals, smallest, top_n


@pytest.fixture(scope="module")
def skewed():
    """4,000 rows; a third belong to user 0 and a third carry the value 7."""
    rng = random.Random(3)
    rows = []
    for n in range(4000):
        user = 0 if rng.random() < 1 / 3 else rng.randrange(1, 60)
        value = 7.0 if rng.random() < 1 / 3 else round(rng.uniform(-50, 50), 1)
        rows.append((n, user, value))
    return pd.DataFrame(rows, columns=["id", "user_id", "value"])


def test_ordinal_within_skewed_groups(spark, skewed):
    got = ordinal(spark.createDataFrame(skewed), ["value", "id"], "pos", ["user_id"]).toPandas()
    want = skewed.sort_values(["user_id", "value", "id"])
    want["pos"] = want.groupby("user_id").cumcount() + 1
    merged = got.merge(want, on="id")
    assert len(got) == len(skewed)
    assert (merged.pos_x == merged.pos_y).all()


@pytest.mark.parametrize("rows", [100, 1000])
def test_buckets_grow_with_the_data(spark, skewed, rows, monkeypatch):
    """A tenth of the rows per bucket gives ten times the buckets, and no bucket holds the hot group."""
    monkeypatch.setattr(ordering, "BUCKET_ROWS", rows)
    df = spark.createDataFrame(skewed)
    out = running_totals(df, ["user_id"], ["value", "id"], {"pos": F.lit(1)})
    assert "_bucket" in out._jdf.queryExecution().optimizedPlan().toString()
    want = skewed.sort_values(["user_id", "value", "id"])
    want["pos"] = want.groupby("user_id").cumcount() + 1
    merged = out.toPandas().merge(want, on="id")
    assert len(merged) == len(skewed) and (merged.pos_x == merged.pos_y).all()
    cut = df.repartitionByRange(-(-len(skewed) // rows), "user_id", "value", "id").groupBy(F.spark_partition_id()).count()
    sizes = [r["count"] for r in cut.collect()]
    assert len(sizes) > 0.8 * len(skewed) / rows and max(sizes) < 3 * rows


def test_global_running_sum(spark, skewed):
    got = running_totals(spark.createDataFrame(skewed), [], ["value", "id"], {"total": F.col("id")}).toPandas()
    want = skewed.sort_values(["value", "id"]).assign(total=lambda d: d.id.cumsum())
    merged = got.merge(want, on="id")
    assert (merged.total_x == merged.total_y).all()


@pytest.mark.parametrize("n", [5, 1500])
def test_top_n_small_and_beyond_the_group_limit(spark, skewed, n):
    got = top_n(spark.createDataFrame(skewed), ["user_id"], [F.desc("value"), F.asc("id")], n).toPandas()
    want = skewed.sort_values(["user_id", "value", "id"], ascending=[True, False, True])
    want["rank"] = want.groupby("user_id").cumcount() + 1
    want = want[want["rank"] <= n]
    merged = got.merge(want, on="id")
    assert len(got) == len(want) == len(merged)
    assert (merged.rank_x == merged.rank_y).all()


def test_smallest_keeps_exactly_n(spark, skewed):
    got = smallest(spark.createDataFrame(skewed), ["value", "id"], F.lit(1234)).toPandas()
    want = skewed.sort_values(["value", "id"]).head(1234)
    assert sorted(got.id) == sorted(want.id)


def test_exact_quantiles(spark, skewed):
    qs = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.99, "e": 1.0}
    row = exact_quantiles(spark.createDataFrame(skewed), "value", qs).first()
    for name, q in qs.items():
        assert row[name] == pytest.approx(np.quantile(skewed.value, q))


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_group_ranks_write_no_full_frame(spark, skewed, limit, monkeypatch):
    """Bounded groups are ranked without a write; large ones write keys and order values only."""
    written = []
    monkeypatch.setattr(ordering, "BUCKET_ROWS", limit)
    keep = ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: written.append(df.columns) or keep(df))
    df = spark.createDataFrame(skewed).withColumn("payload", F.lit("x")).withColumnRenamed("id", "item_id")
    out = ordering.group_ranks(df, ["user_id"], {"up": F.col("value"), "down": -F.col("value")})
    got = out.toPandas()
    assert not any("payload" in columns for columns in written) and bool(written) == (limit == 10)
    for name, sign in (("up", 1), ("down", -1)):
        want = skewed.assign(o=sign * skewed.value).sort_values(["user_id", "o", "id"])
        want["pos"] = want.groupby("user_id").cumcount() + 1
        merged = got.merge(want, left_on="item_id", right_on="id")
        assert len(merged) == len(skewed) and (merged[name] == merged.pos).all()
    assert set(got.payload) == {"x"}
