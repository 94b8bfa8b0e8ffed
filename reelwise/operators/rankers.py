"""Learned rankers: logistic regression by Newton steps, trees on `pyspark.ml`, factorisation, linear pairwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwise.operators.factorization import Factorization, fit_factors
from reelwise.operators.newton import Logistic, fit_newton
from reelwise.operators.sampling import pairwise_samples

MISSING = -1000.0


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in columns})


def fit_logistic(train: DataFrame, columns: Sequence[str], label: str = "label_complete") -> Logistic:
    """Median impute, standardise, class-balanced logistic regression; see newton.fit_newton."""
    return fit_newton(train, columns, label)


def fit_boosted(
    train: DataFrame, columns: Sequence[str], label: str = "label_complete", trees: int = 20, seed: int = 2026
) -> PipelineModel:
    """Gradient-boosted trees, learning rate 0.05.

    Vectors cannot hold gaps, so a missing value becomes `MISSING`, below every feature's range: a tree can split it off.
    """
    columns = list(columns)
    data = _doubles(train, columns).withColumn("_label", F.col(label).cast("double"))
    filled = [f"_f_{name}" for name in columns]
    fills = ", ".join(f"coalesce(`{name}`, {MISSING}D) AS `{out}`" for name, out in zip(columns, filled))
    stages = [
        SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"),
        VectorAssembler(inputCols=filled, outputCol="_features"),
        GBTClassifier(
            featuresCol="_features",
            labelCol="_label",
            maxIter=trees,
            stepSize=0.05,
            maxDepth=5,
            subsamplingRate=0.8,
            seed=seed,
            predictionCol="_class",
        )
        .setProbabilityCol("_prob")
        .setRawPredictionCol("_margin"),
    ]
    return Pipeline(stages=stages).fit(data)


def fit_factorization(
    train: DataFrame, columns: Sequence[str], label: str = "label_complete", factors: int = 8, seed: int = 2026
) -> Factorization:
    """Second-order feature interactions; see factorization.fit_factors."""
    return fit_factors(train, columns, label, factors, steps=30, rate=0.01, seed=seed)


def predict(model: PipelineModel | Logistic | Factorization, df: DataFrame, columns: Sequence[str], out: str = "score") -> DataFrame:
    """`df` plus the positive-class probability."""
    if isinstance(model, Logistic | Factorization):
        return df.withColumn(out, model.probability())
    scored = model.transform(_doubles(df, columns))
    return scored.select(*df.columns, vector_to_array("_prob")[1].alias(out))


def fit_pairwise(
    train: DataFrame, columns: Sequence[str], n_neg: int = 4, seed: int = 2026
) -> dict[str, float]:
    """Linear pairwise ranker: logistic regression without intercept on feature differences.

    Each sampled pair appears once per direction, which keeps the classes balanced. Features are
    scaled by their standard deviation. Returns one coefficient per column.
    """
    columns = list(columns)
    keys = ["user_id", "date"]
    pairs = pairwise_samples(train, n_neg, seed)
    side = lambda prefix, key: train.select(
        *keys, F.col("item_id").alias(key), *[F.col(n).cast("double").alias(f"{prefix}{n}") for n in columns]
    )
    joined = pairs.join(side("_p_", "positive_id"), [*keys, "positive_id"]).join(
        side("_n_", "negative_id"), [*keys, "negative_id"]
    )
    both = joined.withColumn("_sign", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).select(
        (F.col("_sign") > 0).cast("double").alias("_label"),
        *[(F.col("_sign") * (F.col(f"_p_{n}") - F.col(f"_n_{n}"))).alias(n) for n in columns],
    )
    stages = [
        VectorAssembler(inputCols=columns, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", fitIntercept=False, regParam=1e-3),
    ]
    model = Pipeline(stages=stages).fit(both)
    spread, weight = model.stages[1].std.toArray(), model.stages[2].coefficients.toArray()
    return {n: float(w / s) if s > 0 else 0.0 for n, w, s in zip(columns, weight, spread)}


def score_linear(df: DataFrame, coefficients: dict[str, float], out: str = "score") -> DataFrame:
    value = sum((F.lit(w) * F.col(n).cast("double") for n, w in coefficients.items()), F.lit(0.0))
    return df.withColumn(out, value)


def label_heads(train: DataFrame, columns: Sequence[str], labels: Sequence[str]) -> dict[str, Logistic]:
    """One logistic head per label."""
    return {label: fit_logistic(train, columns, label) for label in labels}


def importance_table(df: DataFrame, model: PipelineModel | Logistic, columns: Sequence[str]) -> DataFrame:
    """(feature, importance), strongest first: tree gain shares or absolute weights of standardised features."""
    values = abs(model.weights) if isinstance(model, Logistic) else model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(columns, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), F.asc("feature")
    )


def ablation(
    train: DataFrame,
    test: DataFrame,
    feature_sets: dict[str, Sequence[str]],
    evaluate,
) -> DataFrame:
    """The same logistic pipeline per feature set, one row of `evaluate(scored)` each."""
    result = None
    for name, columns in feature_sets.items():
        model = fit_logistic(train, columns)
        row = evaluate(predict(model, test, columns)).withColumn("feature_set", F.lit(name))
        result = row if result is None else result.unionByName(row, allowMissingColumns=True)
    return result
