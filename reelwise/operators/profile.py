"""Log profiling and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise import schema as S
from reelwise.functions.columns import finite
from reelwise.functions.ordering import exact_quantiles, running_totals
from reelwise.operators.prepare import latest_per_key, list_length


def pct(value: Column) -> Column:
    return F.round(100 * value, 4)


def activity(log: DataFrame, key: str) -> DataFrame:
    """Rows per user, item or day, largest first left to the sink."""
    return log.groupBy(key).agg(F.count("*").alias("interaction_count"))


def _size_histogram(counts: DataFrame) -> DataFrame:
    """How many keys have each count. Different counts of n rows number at most sqrt(2n)."""
    return counts.groupBy("interaction_count").agg(F.count("*").alias("keys"))


def concentration(counts: DataFrame, shares: Sequence[float] = (0.01, 0.05, 0.2)) -> DataFrame:
    """Share (percent) of all rows held by the top ceil(keys * share) keys, at least one.

    Works on the histogram of counts: which of several equal keys makes the cut does not matter.
    """
    sized = _size_histogram(counts).withColumn("_neg", -F.col("interaction_count"))
    ranked = running_totals(sized, [], ["_neg"], {"upto": F.col("keys")})
    facts = counts.agg(
        F.struct(F.count("*").alias("keys"), F.sum("interaction_count").alias("rows")).alias("s")
    ).scalar()
    cut = F.greatest(F.lit(1), F.ceil(F.col("_s.keys") * F.col("share")))
    inside = F.greatest(F.lit(0), F.least("keys", cut - (F.col("upto") - F.col("keys"))))
    shares_column = F.array(*[F.lit(float(share)) for share in shares])
    return (
        ranked.withColumn("_s", facts)
        .withColumn("share", F.explode(shares_column))
        .groupBy("share")
        .agg(pct(F.sum(inside * F.col("interaction_count")) / F.max("_s.rows")).alias("held_pct"))
    )


def cumulative_share(counts: DataFrame, key: str = "item_id") -> DataFrame:
    """Popularity curve: position share and cumulative row share per key, most frequent first."""
    ordered = counts.withColumn("_neg", -F.col("interaction_count"))
    ranked = running_totals(
        ordered, [], ["_neg", key], {"position": F.lit(1).cast("long"), "upto": F.col("interaction_count")}
    )
    facts = counts.agg(
        F.struct(F.count("*").alias("keys"), F.sum("interaction_count").alias("rows")).alias("s")
    ).scalar()
    return ranked.withColumn("_s", facts).select(
        key,
        "position",
        (F.col("position") / F.col("_s.keys")).alias("key_share"),
        (F.col("upto") / F.col("_s.rows")).alias("row_share"),
    )


def log_profile(log: DataFrame) -> DataFrame:
    """One row: sizes, density, dates, watch-ratio quantiles, label rates, activity, concentration."""
    log = log.withColumn("_watch", finite("watch_ratio"))
    short = F.col("play_duration") < F.least(F.lit(S.SHORT_PLAY_MS), F.col("video_duration"))
    base = log.agg(
        F.count("*").alias("interactions"),
        F.countDistinct("user_id").alias("users"),
        F.countDistinct("item_id").alias("items"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
        F.round(F.avg("_watch"), 6).alias("watch_ratio_mean"),
        F.round(F.max("_watch"), 6).alias("watch_ratio_max"),
        pct(F.count_if(F.col("watch_ratio") >= 1) / F.count("*")).alias("complete_rate_pct"),
        pct(F.count_if(F.col("watch_ratio") >= 2) / F.count("*")).alias("strong_positive_rate_pct"),
        pct(F.count_if(short) / F.count("*")).alias("short_play_rate_pct"),
        F.count_if(F.col("video_duration") <= 0).alias("invalid_duration_rows"),
    )
    quantiles = exact_quantiles(
        log, "_watch", {"watch_ratio_median": 0.5, "watch_ratio_p90": 0.9, "watch_ratio_p99": 0.99}
    )
    out = base.withColumn("density_pct", pct(F.col("interactions") / (F.col("users") * F.col("items"))))
    out = out.withColumn("_q", quantiles.select(F.struct("*").alias("s")).scalar())
    for key, name in (("user_id", "user"), ("item_id", "item")):
        counts = activity(log, key)
        # A histogram of counts is small, so the exact weighted percentile is safe on it.
        middle = _size_histogram(counts).agg(F.expr("percentile(interaction_count, 0.5, keys)")).scalar()
        out = out.withColumns(
            {
                f"interactions_per_{name}_mean": F.round(F.col("interactions") / F.col(f"{name}s"), 4),
                f"interactions_per_{name}_median": F.round(middle, 4),
            }
        )
    held = concentration(activity(log, "item_id"))
    shares = held.agg(F.map_from_entries(F.collect_list(F.struct("share", "held_pct")))).scalar()
    names = {"top_1pct_share_pct": 0.01, "top_5pct_share_pct": 0.05, "top_20pct_share_pct": 0.2}
    out = out.withColumn("_held", shares).withColumns(
        {name: F.element_at("_held", F.lit(share)) for name, share in names.items()}
    )
    quantile_names = ["watch_ratio_median", "watch_ratio_p90", "watch_ratio_p99"]
    return out.withColumns({name: F.round(F.col(f"_q.{name}"), 6) for name in quantile_names}).drop(
        "_q", "_held"
    )


def distinct_sketches(log: DataFrame, key: str, day: str = "date", precision: int = 12) -> DataFrame:
    """One HyperLogLog sketch of `key` per day; kept days merge into any range without reading the log again.

    The standard error is about 1.04 / sqrt(2^precision): 1.6 % by default. NULL keys do not count.
    """
    return log.groupBy(day).agg(F.hll_sketch_agg(key, F.lit(precision)).alias("sketch"))


def distinct_between(sketches: DataFrame, first: int | None = None, last: int | None = None, day: str = "date") -> DataFrame:
    """One row with `approx`, the estimated distinct keys of the days from `first` to `last`; 0 without any day."""
    if first is not None:
        sketches = sketches.filter(F.col(day) >= first)
    if last is not None:
        sketches = sketches.filter(F.col(day) <= last)
    return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).cast("long").alias("approx"))


def distinct_to_date(sketches: DataFrame, day: str = "date") -> DataFrame:
    """Per day the estimate of the day (`approx`) and of all days up to it (`approx_to_date`); one row per day is read."""
    upto = W.orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    return sketches.select(
        day, F.hll_sketch_estimate("sketch").alias("approx"), F.hll_sketch_estimate(F.hll_union_agg("sketch").over(upto)).alias("approx_to_date")
    )


def table_quality(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns, duplicate rows beyond the first, and missing cells of a table.

    Rows are compared whole; grouping by all columns splits on their combined hash, so equal rows
    collapse before the shuffle.
    """
    width = len(df.columns)
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    distinct = df.withColumn("_nulls", nulls).groupBy(*df.columns, "_nulls").agg(F.count("*").alias("_n"))
    return distinct.agg(
        F.sum("_n").alias("rows"),
        F.lit(width).alias("columns"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        F.sum(F.col("_n") * F.col("_nulls")).alias("missing_cells"),
        pct(F.sum(F.col("_n") * F.col("_nulls")) / (F.sum("_n") * F.lit(width))).alias("missing_cell_pct"),
    ).select(F.lit(name).alias("table_name"), "*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Distribution of a categorical column with NULL shown as UNKNOWN."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("UNKNOWN")).alias(column)).agg(
        F.count("*").alias("count")
    )


# Numerator and denominator of the daily item rates.
DAILY_RATES = {
    "play_rate": ("play_cnt", "show_cnt"),
    "complete_rate": ("complete_play_cnt", "play_cnt"),
    "like_rate": ("like_cnt", "play_cnt"),
    "comment_rate": ("comment_cnt", "play_cnt"),
    "follow_rate": ("follow_cnt", "play_cnt"),
    "share_rate": ("share_cnt", "play_cnt"),
    "negative_feedback_rate": ("reduce_similar_cnt", "play_cnt"),
}


def daily_rates(daily: DataFrame) -> DataFrame:
    """Derived rates per item-day; a zero denominator gives NULL."""
    return daily.withColumns(
        {
            name: finite(F.try_divide(F.col(top), F.nullif(F.col(bottom), F.lit(0))))
            for name, (top, bottom) in DAILY_RATES.items()
        }
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, 50/90/99 % and max per column, one row each; NULLs ignored."""
    result = None
    for name in columns:
        quantiles = exact_quantiles(df, name, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
        row = df.agg(
            F.lit(name).alias("metric"),
            F.count(name).alias("count"),
            F.avg(name).alias("mean"),
            F.stddev_samp(name).alias("std"),
            F.min(name).alias("min"),
            F.max(name).alias("max"),
        ).withColumn("_q", quantiles.select(F.struct("*").alias("s")).scalar())
        row = row.select("metric", "count", "mean", "std", "min", "_q.p50", "_q.p90", "_q.p99", "max")
        result = row if result is None else result.unionByName(row)
    return result


def list_length_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean and largest length of a list-literal column."""
    return df.select(list_length(F.col(column)).alias("n")).agg(
        F.round(F.avg("n"), 4).alias("mean_length"), F.max("n").alias("max_length")
    )


def non_null_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[pct(F.avg(F.col(c).isNotNull().cast("double"))).alias(f"{c}_non_null_pct") for c in columns])


def key_coverage(a: DataFrame, b: DataFrame, key: str, name: str = "coverage_pct") -> DataFrame:
    """Percent of a's distinct keys that b has."""
    left = a.select(key).distinct()
    right = b.select(key).distinct().withColumn("_has", F.lit(1.0))
    return left.join(right, key, "left").agg(pct(F.avg(F.coalesce("_has", F.lit(0.0)))).alias(name))


def latest_runs(runs: DataFrame, keys: Sequence[str] = ("panel", "experiment_id", "seed")) -> DataFrame:
    """Newest record per key (ties by run_id)."""
    return latest_per_key(runs, list(keys), ["created_at_utc", "run_id"])


def seed_means(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of the metrics and number of seeds per key; NULL keys form their own group."""
    return runs.groupBy(*keys).agg(
        *[F.avg(name).alias(name) for name in metrics], F.countDistinct("seed").alias("seed_count")
    )


def compare_to_baseline(run: DataFrame, baseline: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, baseline, current, diff, verdict): up, down, flat, or pending without a value.

    `run` is one metric row, `baseline` has (metric, baseline).
    """
    present = [name for name in metrics if name in run.columns]
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("current")) for n in present]
    current = (
        run.select(F.explode(F.array(*entries)).alias("e")).select("e.metric", "e.current")
        if present
        else run.sparkSession.createDataFrame([], "metric string, current double")
    )
    wanted = baseline.filter(F.col("metric").isin(list(metrics)))
    diff = F.col("current") - F.col("baseline")
    verdict = (
        F.when(F.col("current").isNull(), "pending")
        .when(diff > 0, "up")
        .when(diff < 0, "down")
        .otherwise("flat")
    )
    return wanted.join(current, "metric", "left").select(
        "metric", "baseline", "current", diff.alias("diff"), verdict.alias("verdict")
    )
