"""Point-in-time behaviour sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.functions.columns import clipped_ratio, days_between
from reelwise.functions.ordering import top_n
from reelwise.operators.candidates import AUTHOR_BINS

GAP_SCALE_DAYS = 90  # fixed value


def behaviour_code() -> Column:
    """1 plain, +1 complete, +2 strong, +4 short."""
    return (
        1 + F.col("label_complete").cast("int") + 2 * F.col("label_strong").cast("int")
        + 4 * F.col("label_short").cast("int")
    )


def scaled_watch_ratio() -> Column:
    return clipped_ratio(low=0.0) / F.lit(5.0)


def time_gap(later: Column, earlier: Column) -> Column:
    """log1p of the days since the event, relative to 90 days."""
    return F.log1p(F.greatest(days_between(later, earlier), F.lit(0))) / F.log1p(F.lit(GAP_SCALE_DAYS))


def history_rows_as_of(
    log: DataFrame, targets: DataFrame, length: int, positives_only: bool = False
) -> DataFrame:
    """Latest `length` events dated before each (user_id, date) of `targets`, `pos` 0 = newest.

    A user-day first keeps its own newest `length` events, and a target only meets the newest days
    that can hold its window: at most `length` of them, found by day number. However busy a user is,
    a target costs a bounded number of rows.
    """
    events = log.filter(F.col("label_complete") == 1) if positives_only else log
    newest = [F.desc("date"), F.desc("timestamp"), F.desc("event_id")]
    daily = top_n(events, ["user_id", "date"], newest, length, "_d").drop("_d")
    days = daily.groupBy("user_id", "date").agg(F.count("*").alias("_n"))
    reached = _window_days(days, targets, length).join(daily, ["user_id", "date"])
    return top_n(reached, ["user_id", "as_of"], newest, length, "pos").withColumn("pos", F.col("pos") - 1)


def _window_days(days: DataFrame, targets: DataFrame, length: int) -> DataFrame:
    """(user_id, as_of, date): earlier days of a target whose newer days hold under `length` events."""
    marks = (
        days.select("user_id", "date", F.lit(1).alias("_is_day"), "_n", F.lit(0).alias("_asked"))
        .union(targets.select("user_id", "date", F.lit(0), F.lit(0), F.lit(1)))
        .groupBy("user_id", "date")
        .agg(*[F.max(name).alias(name) for name in ("_is_day", "_n", "_asked")])
    )
    before = W.partitionBy("user_id").orderBy("date").rangeBetween(W.unboundedPreceding, -1)
    numbered = marks.withColumn("_earlier", F.coalesce(F.sum("_is_day").over(before), F.lit(0)))
    own = numbered.filter(F.col("_is_day") == 1).select(
        "user_id", "date", "_n", (F.col("_earlier") + 1).alias("_day_no")
    )
    first = F.greatest(F.col("_earlier") - (length - 1), F.lit(1))
    asked = (
        numbered.filter((F.col("_asked") == 1) & (F.col("_earlier") > 0))
        .select("user_id", F.col("date").alias("as_of"), F.explode(F.sequence(first, "_earlier")).alias("_day_no"))
    )
    newer = W.partitionBy("user_id", "as_of").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, -1)
    return (
        asked.join(own, ["user_id", "_day_no"])
        .withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
        .filter(F.col("_newer") < length)
        .select("user_id", "as_of", "date")
    )


def history_as_of(
    log: DataFrame,
    targets: DataFrame,
    items: DataFrame,
    length: int,
    positives_only: bool = False,
    content: DataFrame | None = None,
) -> DataFrame:
    """One row per target with `history`, an array of at most `length` events, oldest first.

    Targets without earlier events get an empty array. `content` (item_id, vector) adds vectors.
    """
    rows = history_rows_as_of(log, targets, length, positives_only)
    facts = items.select("item_id", "first_category", "author_id").dropDuplicates(["item_id"])
    rows = rows.join(facts, "item_id", "left")
    fields = {
        "item_id": F.col("item_id"),
        "first_category": F.coalesce("first_category", F.lit(-1)),
        "author_id_hash": F.pmod(F.coalesce("author_id", F.lit(-1)), F.lit(AUTHOR_BINS)).cast("int"),
        "behaviour": behaviour_code(),
        "watch": scaled_watch_ratio(),
        "gap": time_gap(F.col("as_of"), F.col("date")),
    }
    if content is not None:
        rows = rows.join(content.select("item_id", "vector"), "item_id", "left")
        fields["vector"] = F.col("vector")
    event = F.struct((-F.col("pos")).alias("_order"), *[expr.alias(name) for name, expr in fields.items()])
    gathered = rows.groupBy("user_id", F.col("as_of").alias("date")).agg(
        F.transform(
            F.array_sort(F.collect_list(event)), lambda e: F.struct(*[e[name].alias(name) for name in fields])
        ).alias("history")
    )
    asked = targets.select("user_id", "date").distinct()
    kind = gathered.schema["history"].dataType
    return asked.join(gathered, ["user_id", "date"], "left").withColumn(
        "history", F.coalesce("history", F.array().cast(kind))
    )


def require_histories(candidates: DataFrame, histories: DataFrame) -> DataFrame:
    """Candidate rows, failing when a candidate date has no history table at all."""
    dates = histories.select("date").distinct().withColumn("_has", F.lit(True))
    checked = candidates.join(dates, "date", "left")
    message = F.concat(F.lit("no histories for date "), F.col("date").cast("string"))
    guard = F.coalesce(F.col("_has"), F.raise_error(message).cast("boolean"))
    return checked.filter(guard).drop("_has")
