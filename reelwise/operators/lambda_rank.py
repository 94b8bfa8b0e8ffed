"""A linear group-wise ranker trained with LambdaRank gradients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwise.functions.columns import steady
from reelwise.functions.ordering import group_ranks
from reelwise.session import cut_lineage

KEYS = ("user_id", "date")


def ideal_gain(positives: Column, k: int) -> Column:
    """DCG of `positives` relevant rows at the top, cut at `k`."""
    return F.aggregate(F.sequence(F.lit(1), F.least(positives, F.lit(k)).cast("int")), F.lit(0.0), lambda total, r: total + 1 / F.log2(r + 1.0))


def training_groups(train: DataFrame, columns: Sequence[str], label: str, k: int, keys: Sequence[str]) -> tuple[DataFrame, list[float], list[float]]:
    """Rows (keys, item_id, y, x0, x1, ..., idcg) of the groups with both labels, standardised over `train`; and the
    means and deviations. A missing feature counts as 0."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    facts = train.agg(*[f(v).alias(f"{tag}{i}") for i, v in enumerate(values) for tag, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = [facts[f"m{i}"] or 0.0 for i in range(len(values))]
    spreads = [facts[f"s{i}"] or 0.0 for i in range(len(values))]
    scaled = [((v - F.lit(m)) / F.lit(s) if s > 0 else F.lit(0.0)).alias(f"x{i}") for i, (v, m, s) in enumerate(zip(values, means, spreads))]
    rows = train.select(*keys, "item_id", F.col(label).cast("int").alias("y"), *scaled).filter("y IS NOT NULL")
    sizes = rows.groupBy(*keys).agg(F.sum("y").alias("_p"), F.count("*").alias("_n")).filter("_p > 0 AND _p < _n")
    return cut_lineage(rows.join(sizes.select(*keys, ideal_gain(F.col("_p"), k).alias("idcg")), list(keys))), means, spreads


def ranked_groups(rows: DataFrame, weights: Sequence[float], k: int, keys: Sequence[str]) -> DataFrame:
    """Add the score `s`, the position `r` in the group (ties by item) and its discount `d`, 0 beyond `k`."""
    score = sum((F.lit(float(w)) * F.col(f"x{i}") for i, w in enumerate(weights)), F.lit(0.0))
    placed = group_ranks(rows.withColumn("s", score), list(keys), {"r": -steady("s")})
    return placed.withColumn("d", F.when(F.col("r") <= k, 1 / F.log2(F.col("r") + 1.0)).otherwise(F.lit(0.0)))


def lambda_gradient(rows: DataFrame, weights: Sequence[float], k: int, keys: Sequence[str] = KEYS) -> tuple[list[float], float]:
    """(gradient, mean NDCG at `k`) for a linear scorer.

    A pair of a relevant and another row weighs as much as swapping the two would change NDCG, times how wrong its order
    is. Swaps below position `k` change nothing, so every row only meets the at most `k` rows at the top of its group.
    """
    placed = ranked_groups(rows, weights, k, keys)
    features = [f"x{i}" for i in range(len(weights))]
    top = placed.filter(F.col("r") <= k).groupBy(*keys).agg(F.collect_list(F.struct("r", "y", "s", "d", F.array(*features).alias("x"))).alias("top"))
    pairs = placed.join(top, list(keys)).withColumn(
        "t", F.explode(F.filter("top", lambda t: (t["y"] != F.col("y")) & ((F.col("r") > k) | (t["r"] < F.col("r")))))
    )
    sign = F.when(F.col("y") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))  # of the row against the one at the top
    wrong = 1 / (1 + F.exp(sign * (F.col("s") - F.col("t.s"))))
    force = sign * wrong * F.abs(F.col("d") - F.col("t.d")) / F.col("idcg")
    pull = pairs.withColumn("_f", force).agg(*[F.coalesce(F.sum(F.col("_f") * (F.col(c) - F.col("t.x")[i])), F.lit(0.0)).alias(c) for i, c in enumerate(features)])
    gain = placed.groupBy(*keys).agg((F.sum(F.col("y") * F.col("d")) / F.max("idcg")).alias("g")).agg(F.coalesce(F.avg("g"), F.lit(0.0)).alias("g"), F.count("*").alias("n"))
    sums, quality = pull.first(), gain.first()
    return [sums[c] / max(1, quality.n) for c in features], quality.g


def fit_lambda_rank(
    train: DataFrame,
    columns: Sequence[str],
    label: str = "label",
    k: int = 10,
    steps: int = 10,
    rate: float = 5.0,
    keys: Sequence[str] = KEYS,
) -> tuple[dict[str, float], list[float]]:
    """(coefficient per column for `rankers.score_linear`, NDCG at `k` before each step).

    Starts from 0; each step moves the standardised weights by `rate` times the mean gradient of the groups that hold
    both labels. Without such groups all coefficients are 0.
    """
    rows, _, spreads = training_groups(train, columns, label, k, keys)
    weights, course = [0.0] * len(columns), []
    for _ in range(steps):
        gradient, quality = lambda_gradient(rows, weights, k, keys)
        course.append(quality)
        weights = [w + rate * g for w, g in zip(weights, gradient)]
    return {c: w / s if s > 0 else 0.0 for c, w, s in zip(columns, weights, spreads)}, course
