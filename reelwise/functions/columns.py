"""Column expressions shared by the operators: labels, dates, hashes, safe numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwise import schema as S


def flag(condition: Column) -> Column:
    """0/1 as a byte; a NULL condition counts as 0."""
    return F.when(condition, 1).otherwise(0).cast("byte")


def split_of(date: Column, train_end: int, valid_end: int) -> Column:
    return F.when(date <= train_end, "train").when(date <= valid_end, "valid").otherwise("test")


def with_labels(df: DataFrame) -> DataFrame:
    """Add the three labels from `watch_ratio`, `play_duration`, `video_duration`."""
    shortest = F.least(F.lit(S.SHORT_PLAY_MS), F.col("video_duration"))
    return df.withColumns(
        {
            "label_complete": flag(F.col("watch_ratio") >= S.COMPLETE_RATIO),
            "label_strong": flag(F.col("watch_ratio") >= S.STRONG_RATIO),
            # NULL duration compares as unknown, hence not short.
            "label_short": flag(
                F.col("video_duration").isNotNull() & (F.col("play_duration") < shortest)
            ),
        }
    )


def utility() -> Column:
    return (
        F.col("label_complete") + F.lit(0.5) * F.col("label_strong") - F.lit(0.5) * F.col("label_short")
    )


def clipped_ratio(low: float | None = None) -> Column:
    ratio = F.least(F.col("watch_ratio"), F.lit(S.WATCH_RATIO_CAP))
    return ratio if low is None else F.greatest(ratio, F.lit(low))


def watch_regression() -> Column:
    """Declared regression target: log1p of the capped watch ratio."""
    return F.log1p(clipped_ratio())


def as_date(yyyymmdd: Column) -> Column:
    return F.to_date(yyyymmdd.cast("string"), "yyyyMMdd")


def days_between(later: Column, earlier: Column) -> Column:
    """Calendar days between two integer dates."""
    return F.datediff(as_date(later), as_date(earlier))


def event_time(zone: str = "Asia/Shanghai") -> Column:
    """Local wall-clock time: the `time` string, else Unix seconds in `zone`, else noon of `date`."""
    from_seconds = F.from_utc_timestamp(F.timestamp_seconds("timestamp"), zone)
    # timestamp_seconds yields an instant; render it in UTC so the session zone has no effect.
    wall = F.to_timestamp_ntz(F.convert_timezone(F.current_timezone(), F.lit("UTC"), from_seconds.cast("timestamp_ntz")))
    noon = F.to_timestamp_ntz(F.concat(as_date(F.col("date")).cast("string"), F.lit(" 12:00:00")))
    return F.coalesce(F.expr("try_cast(time as timestamp_ntz)"), wall, noon)


def hash32(seed: int | str, *parts: Column | str) -> Column:
    """Seeded 32-bit value of the parts as a long, identical in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def unit_hash(seed: int | str, *parts: Column | str) -> Column:
    """A draw in the open interval (0, 1)."""
    return (hash32(seed, *parts) + F.lit(0.5)) / F.lit(4294967296.0)


def finite(column: Column | str) -> Column:
    """Value as double with NaN and infinities turned into NULL."""
    value = _col(column).cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def steady(column: Column | str, digits: int = 9) -> Column:
    """Rounded copy for ordering: sums of doubles added in another order must not reorder ties."""
    return F.round(_col(column), digits)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
