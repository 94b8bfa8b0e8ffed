"""User and item statistics of a history, plain or strictly before each row's date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.functions.columns import clipped_ratio

RATES = {"complete_rate": "label_complete", "strong_rate": "label_strong", "short_rate": "label_short"}
SIDES = {"user_id": "user", "item_id": "item"}


def history_stats(history: DataFrame, key: str, prefix: str | None = None) -> DataFrame:
    """Count, label rates and mean clipped watch ratio per `key`."""
    prefix = prefix or SIDES[key]
    return history.groupBy(key).agg(
        F.count("*").alias(f"{prefix}_interactions"),
        *[F.avg(label).alias(f"{prefix}_{name}") for name, label in RATES.items()],
        F.avg(clipped_ratio()).alias(f"{prefix}_mean_watch_ratio"),
    )


def _past(target: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Statistics of `history` rows dated before each (key, date) of `target`; NULL without any.

    Both sides shrink to one row per key and day first, so the window runs over days, not events.
    """
    prefix = SIDES[key]
    daily = history.select(
        key,
        "date",
        F.lit(1).alias("n"),
        *[F.col(label).cast("long").alias(name) for name, label in RATES.items()],
        clipped_ratio().alias("watch"),
        F.lit(0).alias("wanted"),
    )
    asked = target.select(
        key,
        "date",
        F.lit(0).alias("n"),
        *[F.lit(0).cast("long").alias(name) for name in RATES],
        F.lit(0.0).alias("watch"),
        F.lit(1).alias("wanted"),
    )
    measures = ["n", *RATES, "watch"]
    days = (
        daily.unionByName(asked)
        .groupBy(key, "date")
        .agg(*[F.sum(name).alias(name) for name in measures], F.max("wanted").alias("wanted"))
    )
    earlier = W.partitionBy(key).orderBy("date").rangeBetween(W.unboundedPreceding, -1)
    sums = days.withColumns({f"_{name}": F.sum(name).over(earlier) for name in measures})
    count = F.nullif(F.col("_n"), F.lit(0))
    return sums.filter(F.col("wanted") == 1).select(
        key,
        "date",
        count.alias(f"{prefix}_interactions"),
        *[(F.col(f"_{name}") / count).alias(f"{prefix}_{name}") for name in RATES],
        (F.col("_watch") / count).alias(f"{prefix}_mean_watch_ratio"),
    )


def attach_past_stats(
    target: DataFrame, history: DataFrame, keys: tuple[str, ...] = ("user_id", "item_id")
) -> DataFrame:
    """Replace any user_/item_ statistic columns of `target` by those strictly before its dates.

    Rows of the same day never see each other.
    """
    stale = [
        name
        for name in target.columns
        if name not in SIDES and (name.startswith("user_") or name.startswith("item_"))
    ]
    target = target.drop(*stale)
    result = target
    for key in keys:
        result = result.join(_past(target, history, key), [key, "date"], "left")
    return result


def strict_past_stats(log: DataFrame, keys: tuple[str, ...] = ("user_id", "item_id")) -> DataFrame:
    return attach_past_stats(log, log, keys)


def pointwise_frame(log: DataFrame, items: DataFrame) -> DataFrame:
    """Log rows with the item attributes the pointwise rankers read."""
    wanted = items.select("item_id", "author_id", "first_category", "first_seen_date")
    return log.join(wanted, "item_id", "left")


def pointwise_training_rows(frame: DataFrame, feature_end: int) -> DataFrame:
    return frame.filter((F.col("split") == "train") & (F.col("date") > feature_end))
