"""From raw files to the labelled interaction log, the observation panel and the item dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwise import schema as S
from reelwise.functions.columns import as_date, clipped_ratio, event_time, split_of, utility, with_labels


def prepare_interactions(
    raw: DataFrame,
    users: DataFrame | None = None,
    train_end: int = S.TRAIN_END,
    valid_end: int = S.VALID_END,
    zone: str = "Asia/Shanghai",
) -> DataFrame:
    """Keep dated rows of the selected users; add split, labels, hour and weekday (Monday = 0)."""
    log = raw.filter(F.col("date").isNotNull()).withColumn("date", F.col("date").cast("int"))
    if users is not None:
        log = log.join(users.select("user_id"), "user_id", "left_semi")
    log = with_labels(log).withColumns(
        {"split": split_of(F.col("date"), train_end, valid_end), "_at": event_time(zone)}
    )
    return log.withColumns(
        {"hour": F.hour("_at").cast("byte"), "weekday": F.weekday("_at").cast("byte")}
    ).drop("_at")


def panel_catalog(raw: DataFrame, item: str = "item_id") -> DataFrame:
    """Every item of the dense matrix, taken before any user filter."""
    return raw.select(F.col(item).alias("item_id")).filter(F.col("item_id").isNotNull()).distinct()


def prepare_panel(
    raw: DataFrame,
    users: DataFrame,
    panel: str,
    reference_date: int = S.PANEL_REFERENCE_DATE,
) -> DataFrame:
    """Label the dense matrix for the panel's users and move every row to the reference date.

    Undated rows stay: the matrix is an answer sheet, not a history.
    """
    rows = with_labels(raw.join(users.select("user_id"), "user_id", "left_semi"))
    day = as_date(F.lit(reference_date))
    return rows.withColumns(
        {
            "source_date": F.col("date"),
            "date": F.lit(reference_date),
            "split": F.lit(panel),
            "watch_ratio_clipped": clipped_ratio(low=0.0),
            "utility": utility().cast("float"),
            "hour": F.lit(12).cast("byte"),
            "weekday": F.weekday(day).cast("byte"),
        }
    )


def first_of_list(literal: Column) -> Column:
    """First number of a list literal such as `[8, 3]`; -1 when empty, missing or malformed."""
    return F.coalesce(F.try_element_at(F.from_json(literal, "array<int>"), F.lit(1)), F.lit(-1))


def list_length(literal: Column, kind: str = "bigint") -> Column:
    return F.coalesce(F.size(F.from_json(F.coalesce(literal, F.lit("[]")), f"array<{kind}>")), F.lit(0))


def joined_text(names: list[str]) -> Column:
    """Nullable text columns joined by a space, with the literal UNKNOWN removed."""
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in names]
    return F.replace(F.concat_ws(" ", *parts), F.lit("UNKNOWN"), F.lit(""))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by `order`; an aggregate, so a hot key is reduced before the shuffle."""
    payload = [name for name in df.columns if name not in keys]
    newest = F.max_by(F.struct(*payload), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def first_seen(daily: DataFrame, item: str = "item_id") -> DataFrame:
    return daily.groupBy(item).agg(F.min("date").alias("first_seen_date"))


def median_by_item(log: DataFrame, value: str = "video_duration", item: str = "item_id") -> DataFrame:
    """Exact median per item; equal values are counted first so a hot item shuffles as few rows."""
    counts = log.filter(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(item).agg(F.expr(f"percentile({value}, 0.5, _n)").alias(f"median_{value}"))


def item_dimension(
    categories: DataFrame,
    daily: DataFrame,
    captions: DataFrame,
    log: DataFrame,
    train_end: int = S.TRAIN_END,
) -> DataFrame:
    """One row per item: first category, newest attributes up to `train_end`, first date, text.

    Every first-seen item keeps a row on the attribute side (right join), then categories lead.
    """
    attributes = ["author_id", "video_type", "video_duration"]
    newest = latest_per_key(
        daily.filter(F.col("date") <= train_end).select("item_id", "date", *attributes),
        ["item_id"],
        ["date", *attributes],
    ).drop("date")
    known = newest.join(first_seen(daily), "item_id", "right")
    texts = (
        captions.withColumn("item_id", F.expr("try_cast(item_id as bigint)"))
        .filter(F.col("item_id").isNotNull())
        .select("item_id", joined_text(S.CAPTION_TEXTS).alias("content_text"))
    )
    return (
        categories.select("item_id", first_of_list(F.col("feat")).alias("first_category"))
        .join(known, "item_id", "left")
        .join(texts, "item_id", "left")
        .join(median_by_item(log), "item_id", "left")
        .withColumn("video_duration", F.coalesce("video_duration", "median_video_duration"))
        .drop("median_video_duration")
        .na.fill({"content_text": "", "video_type": "UNKNOWN", "author_id": -1})
    )


def prepared_summary(log: DataFrame, panel_users: DataFrame) -> DataFrame:
    """One row: sizes, splits, complete rate and how many log users are also in the dense panel."""
    users = log.select("user_id").distinct()
    shared = users.join(panel_users.select("user_id"), "user_id", "left_semi").agg(F.count("*"))
    return log.agg(
        F.lit(S.PREPARED_VERSION).alias("prepared_version"),
        F.count("*").alias("rows"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("item_id").alias("items"),
        *[F.count_if(F.col("split") == name).alias(f"{name}_rows") for name in ("train", "valid", "test")],
        F.avg("label_complete").alias("complete_rate"),
    ).withColumn("panel_users_in_log", shared.scalar())


def split_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("split").agg(F.count("*").alias("rows"))
