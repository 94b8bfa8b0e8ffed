"""AUC family and logged ranking metrics of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwise.functions.ordering import running_totals, top_n

LOG_LOSS_EDGE = 1e-7  # fixed value
LOGGED_K = 10  # fixed value


def _auc_by(df: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """AUC per key group with ties counted half; NULL for one-class groups.

    Rows collapse to one per (group, score) first and ranks are running counts, so neither a tied
    score nor a hot group is held in one task.
    """
    hit = F.col(label) == 1
    counts = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.count_if(hit).alias("_p"), F.count_if(~hit).alias("_n")
    )
    ranked = running_totals(counts, keys, ["_s"], {"_below": F.col("_n")})
    wins = F.sum(F.col("_p") * (F.col("_below") - F.col("_n") / 2))
    return ranked.groupBy(*keys).agg(
        F.try_divide(wins, F.sum("_p") * F.sum("_n")).alias("auc"),
        (F.sum("_p") + F.sum("_n")).alias("rows"),
    )


def auc(df: DataFrame, score: str = "score", label: str = "label_complete") -> DataFrame:
    return _auc_by(df, score, label, [])


def log_loss(score: str = "score", label: str = "label_complete") -> Column:
    """Mean negative log likelihood with the score clipped away from 0 and 1."""
    p = F.least(F.greatest(F.col(score), F.lit(LOG_LOSS_EDGE)), F.lit(1 - LOG_LOSS_EDGE))
    return F.avg(-F.log(F.when(F.col(label) == 1, p).otherwise(1 - p)))


def gauc(df: DataFrame, score: str = "score", label: str = "label_complete") -> DataFrame:
    """Per-user AUC weighted by the user's rows; users with one class are left out, 0 if all are."""
    users = _auc_by(df, score, label, ["user_id"]).filter(F.col("auc").isNotNull())
    weighted = F.try_divide(F.sum(F.col("auc") * F.col("rows")), F.sum("rows"))
    return users.agg(F.coalesce(weighted, F.lit(0.0)).alias("gauc"), F.count("*").alias("gauc_users"))


def _logged_top(df: DataFrame, score: str, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    return top_n(df, list(keys), [F.desc(score), *[F.asc(name) for name in tie]], LOGGED_K)


def _ideal_of(positives: Column) -> Column:
    places = F.sequence(F.lit(1), F.least(positives, F.lit(LOGGED_K)))
    total = F.aggregate(places, F.lit(0.0), lambda acc, place: acc + 1 / F.log2(place + 1))
    return F.when(positives > 0, total).otherwise(0.0)


def ranking_by_group(
    df: DataFrame,
    score: str = "score",
    keys: Sequence[str] = ("user_id", "date"),
    tie: Sequence[str] = ("item_id",),
) -> DataFrame:
    """NDCG@10 per group against the group's own best order; a group without positives gets 0."""
    top = _logged_top(df, score, keys, tie)
    gain = F.when(F.col("label_complete") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    dcg = top.groupBy(*keys).agg(F.sum(gain).alias("_dcg"))
    positives = df.groupBy(*keys).agg(F.count_if(F.col("label_complete") == 1).alias("positives"))
    ideal = _ideal_of(F.col("positives"))
    return positives.join(dcg, list(keys)).select(
        *keys,
        F.when(ideal > 0, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg_at_10"),
        "positives",
    )


def ranking_metrics(
    df: DataFrame,
    score: str = "score",
    keys: Sequence[str] = ("user_id", "date"),
    tie: Sequence[str] = ("item_id",),
) -> DataFrame:
    """AUC, log loss, GAUC, logged NDCG@10 (groups with positives only) and rates of the top 10 rows."""
    groups = ranking_by_group(df, score, keys, tie).filter(F.col("positives") > 0)
    top = _logged_top(df, score, keys, tie)
    rates = {
        "complete_rate_at_10": F.avg("label_complete"),
        "strong_rate_at_10": F.avg("label_strong"),
        "short_rate_at_10": F.avg("label_short"),
        "utility_at_10": F.avg(
            F.col("label_complete") + 0.5 * F.col("label_strong") - 0.5 * F.col("label_short")
        ),
    }
    return top.agg(*[expr.alias(name) for name, expr in rates.items()]).withColumns(
        {
            "auc": auc(df, score).select("auc").scalar(),
            "log_loss": df.agg(log_loss(score)).scalar(),
            "gauc": gauc(df, score).select("gauc").scalar(),
            "ndcg_at_10": F.coalesce(groups.agg(F.avg("ndcg_at_10")).scalar(), F.lit(0.0)),
        }
    )


def per_task_metrics(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """AUC of each label against its own score; log loss for the complete label."""
    out = {
        f"auc_{label.removeprefix('label_')}": auc(df, score, label).select("auc").scalar()
        for label, score in scores.items()
    }
    first = df.agg(log_loss(scores["label_complete"]).alias("log_loss_complete"))
    return first.withColumns(out)
