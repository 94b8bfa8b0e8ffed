"""The factorisation ranker gives FMClassifier's scores from one aggregation per step."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array

from reelwise.operators import factorization
from reelwise.operators import rankers as R


def rows(spark, n=300):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.1] + [0.0, 5.0, 3.0]
    y = (x[:, 0] * (x[:, 1] - 5) + rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(i, *map(float, r), 7.0, int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, flat double, label_complete int")


def test_scores_equal_those_of_the_library(spark, monkeypatch):
    df, columns = rows(spark), ["a", "b", "c", "flat"]
    passes, sums = [], factorization.gradient
    monkeypatch.setattr(factorization, "gradient", lambda *args: passes.append(1) or sums(*args))
    got = {r.id: r.score for r in R.predict(R.fit_factorization(df, columns), df, columns).collect()}
    assert len(passes) == 30
    stages = [VectorAssembler(inputCols=columns, outputCol="_raw"), MinMaxScaler(inputCol="_raw", outputCol="_x"),
              FMClassifier(featuresCol="_x", labelCol="label_complete", factorSize=8, stepSize=0.01, maxIter=30, seed=2026, probabilityCol="_p")]
    model = Pipeline(stages=stages).fit(df)
    for r in model.transform(df).select("id", vector_to_array("_p")[1].alias("p")).collect():
        assert got[r.id] == pytest.approx(r.p, abs=1e-9)


def test_gaps_are_refused(spark):
    with pytest.raises(ValueError, match="gap"):
        R.fit_factorization(rows(spark, 5).selectExpr("nullif(a, a) AS a", "label_complete"), ["a"])
