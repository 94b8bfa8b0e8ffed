import inspect
import math

import numpy as np

from reelwise.functions import ordering
from reelwise.operators import newton, rankers


def test_medians_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(float(rng.normal()), None if i % 3 else float(rng.integers(0, 4)), None, math.nan if i < 90 else -0.0) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    want = [np.median([r[0] for r in rows]), np.median([r[1] for r in rows if r[1] is not None]), 0.0, 0.0]
    for held in (250_000, 30):  # one window, then buckets
        monkeypatch.setattr(ordering, "BUCKET_ROWS", held)
        assert np.allclose(newton.medians_of(df.repartition(3), list("abcd")), want, rtol=0, atol=1e-15)
        assert newton.medians_of(df.filter("a > 1e9"), ["a", "b"]).tolist() == [0.0, 0.0]

def test_fits_know_no_size_at_which_rows_are_drawn(spark):
    assert set(inspect.signature(newton.fit_newton).parameters) == {"train", "columns", "label", "ridge"}
    # Over a million rows: the median of a draw would be off the exact one, 524288.
    df = spark.range(1_048_577).selectExpr("CAST(id AS DOUBLE) a", "CAST(id % 2 AS INT) label_complete")
    assert rankers.fit_logistic(df, ["a"]).medians.tolist() == [524288.0]
