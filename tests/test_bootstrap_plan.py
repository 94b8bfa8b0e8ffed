import re

import pytest
from pyspark.sql import functions as F

from reelwise.operators import evaluate as E
from reelwise.session import cut_lineage


def test_position_draws_are_not_broadcast(spark):
    users = spark.range(400).select(F.col("id").alias("user_id"))
    a = cut_lineage(users.withColumn("m", (F.col("user_id") % 7).cast("double")))
    b = cut_lineage(users.withColumn("m", (F.col("user_id") % 5).cast("double")))
    out = E.paired_bootstrap(a, b, "m", 50, poisson=False)
    plan = out._jdf.queryExecution().toString()
    assert "strategy=shuffle_hash" in plan and not re.search(r"BroadcastHashJoin \[pos#", plan)
    row = out.first()
    diffs = [u % 5 - u % 7 for u in range(400)]
    assert row.paired_users == 400 and row.mean_difference == pytest.approx(sum(diffs) / 400)
    assert row.ci_95_low < row.mean_difference < row.ci_95_high
