"""Queries of log profiling and run summaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.operators import profile as PF
from reelwise.plans.candidating import channel_lists
from reelwise.plans.evaluating import MODELS, exposure_summary
from reelwise.plans.registry import register
from reelwise.plans.sql import fragment, query, r6, rx
from reelwise.plans.world import World
from reelwise.session import cut_lineage
from reelwise.sources import driver_tables as D


def pct_sql(expression: str, name: str) -> str:
    return rx(f"round(100 * ({expression}), 4)", name)


def _held(counts: str, share: float) -> str:
    return f"""(SELECT sum(n) FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM {counts})
      WHERE r <= (SELECT greatest(1, ceil(count(*) * {share}::DOUBLE)) FROM {counts})) / (SELECT sum(n) FROM {counts})"""


def counts_extra(log: str) -> dict[str, str]:
    return {
        "uc": f"SELECT user_id, count(*) AS n FROM {log} GROUP BY 1",
        "ic": f"SELECT item_id, count(*) AS n FROM {log} GROUP BY 1",
    }


def profile_sql(log: str) -> str:
    return query(
        [log],
        f"""
SELECT count(*) AS interactions, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
  min(date) AS date_min, max(date) AS date_max, {rx('round(avg(watch_ratio), 6)', 'watch_ratio_mean')},
  {rx('round(max(watch_ratio), 6)', 'watch_ratio_max')},
  {pct_sql('avg((watch_ratio >= 1)::INT)', 'complete_rate_pct')}, {pct_sql('avg((watch_ratio >= 2)::INT)', 'strong_positive_rate_pct')},
  {pct_sql('avg((play_duration < least(3000, video_duration))::INT)', 'short_play_rate_pct')},
  count(*) FILTER (video_duration <= 0) AS invalid_duration_rows,
  {pct_sql('count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id))', 'density_pct')},
  {', '.join(rx(f'round(count(*) / count(DISTINCT {s}_id), 4)', f'interactions_per_{s}_mean') for s in ('user', 'item'))},
  {', '.join(rx(f'round((SELECT median(n) FROM {c}), 4)', f'interactions_per_{s}_median') for s, c in (('user', 'uc'), ('item', 'ic')))},
  {', '.join(pct_sql(_held('ic', share), f'top_{int(share * 100)}pct_share_pct') for share in (0.01, 0.05, 0.2))},
  {', '.join(rx(f'round(quantile_cont(watch_ratio::DOUBLE, {q}), 6)', f'watch_ratio_{n}') for n, q in (('median', 0.5), ('p90', 0.9), ('p99', 0.99)))}
FROM {log}""",
        extra=counts_extra(log),
    )


@register("log_profile", profile_sql("log"))
def log_profile(spark, folder):
    return PF.log_profile(World(spark, folder).log)


@register("log_profile_large", profile_sql("olog"))
def log_profile_large(spark, folder):
    return PF.log_profile(World(spark, folder, "orders").log)


@register(
    "distinct_sketches",
    query(
        ["olog"],
        """
SELECT d.date, d.n AS users, true AS near, (SELECT count(*) FROM f WHERE f.first <= d.date) AS users_to_date, true AS near_to_date
FROM (SELECT date, count(DISTINCT user_id) AS n FROM olog GROUP BY 1) d""",
        extra={"f": "SELECT user_id, min(date) AS first FROM olog GROUP BY 1"},
    ),
)
def distinct_sketches(spark, folder):
    """Exact distinct users per day and to date, and whether daily sketches and their unions lie within 6 % (or 1) of them."""
    log = World(spark, folder, "orders").log
    exact = log.groupBy("date").agg(F.countDistinct("user_id").alias("users"))
    new = log.groupBy("user_id").agg(F.min("date").alias("date")).groupBy("date").agg(F.count("*").alias("new"))
    upto = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    days = exact.join(new, "date", "left").withColumn("users_to_date", F.sum(F.coalesce("new", F.lit(0))).over(upto))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 0.06 * F.col(b))
    sketched = PF.distinct_to_date(PF.distinct_sketches(log, "user_id"))
    return days.join(sketched, "date").select(
        "date", "users", near("approx", "users").alias("near"), "users_to_date", near("approx_to_date", "users_to_date").alias("near_to_date")
    )


@register(
    "concentration",
    query(
        ["olog"],
        " UNION ALL ".join(
            f"SELECT {share}::DOUBLE AS share, {pct_sql(_held('uc', share), 'held_pct')}" for share in (0.01, 0.05, 0.2)
        ),
        extra=counts_extra("olog"),
    ),
)
def concentration(spark, folder):
    """Of the customers of the larger log."""
    return PF.concentration(PF.activity(World(spark, folder, "orders").log, "user_id"))


@register(
    "cumulative_share",
    query(
        ["olog"],
        f"""
SELECT item_id, row_number() OVER w AS position, {rx('row_number() OVER w / count(*) OVER ()', 'key_share')},
  {rx('sum(n) OVER w / sum(n) OVER ()', 'row_share')} FROM ic
WINDOW w AS (ORDER BY n DESC, item_id ROWS UNBOUNDED PRECEDING)""",
        extra=counts_extra("olog"),
    ),
)
def cumulative_share(spark, folder):
    return PF.cumulative_share(PF.activity(World(spark, folder, "orders").log, "item_id"))


@register("daily_activity", query(["olog"], "SELECT date, count(*) AS interaction_count FROM olog GROUP BY 1"))
def daily_activity(spark, folder):
    return PF.activity(World(spark, folder, "orders").log, "date")


QUALITY_TABLES = ["customer", "part", "supplier", "orders", "lineitem", "labels", "nation", "region"]


def quality_sql(name: str) -> str:
    columns = D.SCHEMAS[name].split(", ")
    names = [c.split(" ")[0] for c in columns]
    nulls = " + ".join(f"({n} IS NULL)::BIGINT" for n in names)
    return f"""
SELECT '{name}' AS table_name, count(*) AS rows, {len(names)} AS columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {name})) AS duplicate_rows,
  sum({nulls})::BIGINT AS missing_cells, {pct_sql(f'sum({nulls}) / (count(*) * {len(names)})', 'missing_cell_pct')} FROM {name}"""


@register("table_quality", " UNION ALL ".join(quality_sql(name) for name in QUALITY_TABLES))
def table_quality(spark, folder):
    out = None
    for name in QUALITY_TABLES:
        row = PF.table_quality(D.table(spark, folder, name), name)
        out = row if out is None else out.unionByName(row)
    return out


@register(
    "value_distribution",
    "SELECT coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, 'UNKNOWN') AS event_type, count(*) AS count FROM events GROUP BY 1",
)
def value_distribution(spark, folder):
    events = D.table(spark, folder, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return PF.value_counts(events.select(kind.alias("event_type")), "event_type")


fragment(
    "item_days",
    ["log"],
    """
SELECT l.item_id, l.date, count(*) AS show_cnt, count(*) FILTER (e.event_type IN ('view', 'purchase')) AS play_cnt,
  sum(label_complete) AS complete_play_cnt, count(*) FILTER (e.event_type = 'click') AS like_cnt,
  count(*) FILTER (e.event_type = 'signup') AS follow_cnt, count(*) FILTER (e.event_type = 'error') AS reduce_similar_cnt,
  count(*) FILTER (label_strong = 1) AS comment_cnt, count(*) FILTER (label_short = 1) AS share_cnt
FROM log l JOIN events e ON e.event_id = l.event_id GROUP BY ALL""",
)


def item_days(w: World):
    """Daily counters per item, derived from the event types."""
    kind = F.col("event_type")
    events = w.table("events").select("event_id", "event_type")
    return (
        w.log.join(events, "event_id")
        .groupBy("item_id", "date")
        .agg(
            F.count("*").alias("show_cnt"),
            F.count_if(kind.isin("view", "purchase")).alias("play_cnt"),
            F.sum("label_complete").alias("complete_play_cnt"),
            F.count_if(kind == "click").alias("like_cnt"),
            F.count_if(kind == "signup").alias("follow_cnt"),
            F.count_if(kind == "error").alias("reduce_similar_cnt"),
            F.count_if(F.col("label_strong") == 1).alias("comment_cnt"),
            F.count_if(F.col("label_short") == 1).alias("share_cnt"),
        )
    )


def rate_sql(name: str) -> str:
    top, bottom = PF.DAILY_RATES[name]
    return f"{top} / nullif({bottom}, 0)"


@register(
    "daily_rates",
    query(["item_days"], f"SELECT item_id, date, {', '.join(rx(rate_sql(n), n) for n in PF.DAILY_RATES)} FROM item_days"),
)
def daily_rates(spark, folder):
    rates = PF.daily_rates(item_days(World(spark, folder)))
    return rates.select("item_id", "date", *PF.DAILY_RATES)


@register(
    "rate_summary",
    query(
        ["item_days"],
        " UNION ALL ".join(
            f"""
SELECT '{n}' AS metric, count(x) AS count, {rx('avg(x)', 'mean')}, {rx('stddev_samp(x)', 'std')}, {rx('min(x)', 'min')},
  {rx('quantile_cont(x, 0.5)', 'p50')}, {rx('quantile_cont(x, 0.9)', 'p90')}, {rx('quantile_cont(x, 0.99)', 'p99')}, {rx('max(x)', 'max')}
FROM (SELECT {rate_sql(n)} AS x FROM item_days)"""
            for n in PF.DAILY_RATES
        ),
    ),
)
def rate_summary(spark, folder):
    rates = cut_lineage(PF.daily_rates(item_days(World(spark, folder))))
    return PF.describe(rates, list(PF.DAILY_RATES))


@register(
    "list_lengths",
    f"SELECT {rx('round(avg(p_size % 7), 4)', 'mean_length')}, max(p_size % 7) AS max_length FROM part",
)
def list_lengths(spark, folder):
    """Lengths of list literals, one literal per part, missing where the list would be empty."""
    n = F.col("p_size") % 7
    literal = F.when(n > 0, F.concat(F.lit("["), F.array_join(F.sequence(F.lit(1), n), ", "), F.lit("]")))
    return PF.list_length_stats(D.table(spark, folder, "part").select(literal.alias("feat")), "feat")


@register(
    "key_coverage",
    query(
        ["log"],
        f"""
SELECT {pct_sql('avg((u IN (SELECT o_custkey FROM orders))::INT)', 'customers_with_orders_pct')},
  {pct_sql('(SELECT avg((p_partkey IN (SELECT item_id FROM log))::INT) FROM part)', 'parts_in_log_pct')}
FROM (SELECT DISTINCT c_custkey AS u FROM customer)""",
    ),
)
def key_coverage(spark, folder):
    w = World(spark, folder)
    users = w.table("customer").select(F.col("c_custkey").alias("user_id"))
    orders = w.table("orders").select(F.col("o_custkey").alias("user_id"))
    parts = PF.key_coverage(w.items, w.log, "item_id")
    return PF.key_coverage(users, orders, "user_id", "customers_with_orders_pct").withColumn(
        "parts_in_log_pct", parts.scalar()
    )


@register(
    "non_null_share",
    f"""
SELECT {pct_sql('avg((quality IS NOT NULL)::INT)', 'quality_non_null_pct')}, {pct_sql('avg((text IS NOT NULL)::INT)', 'text_non_null_pct')}
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def non_null_share(spark, folder):
    docs = D.table(spark, folder, "documents").join(D.table(spark, folder, "labels"), "doc_id", "left")
    return PF.non_null_share(docs, ["quality", "text"])


# --- run summaries ------------------------------------------------------------------------------

# Run records from the data: one run per user nation group ("seed") and day, its metrics from that slice.
RUNS_SQL = """
SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE split END AS panel, 'slice_' || (user_id % 4) AS experiment_id,
  user_id % 5 AS seed, CAST(date AS VARCHAR) AS created_at_utc, CAST(max(event_id) AS VARCHAR) AS run_id,
  avg(watch_ratio) AS recall_at_10 FROM log GROUP BY ALL"""
fragment("runs", ["log"], RUNS_SQL.replace("GROUP BY ALL", "GROUP BY user_id % 3 = 0, CASE WHEN user_id % 3 = 0 THEN NULL ELSE split END, user_id % 4, user_id % 5, date"))
fragment(
    "latest",
    ["runs"],
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel, experiment_id, seed ORDER BY created_at_utc DESC, run_id DESC) AS r
  FROM runs) WHERE r = 1""",
)


def run_records(w: World):
    u = F.col("user_id")
    return w.log.groupBy(
        F.when(u % 3 != 0, F.col("split")).alias("panel"),
        F.concat(F.lit("slice_"), (u % 4).cast("string")).alias("experiment_id"),
        (u % 5).alias("seed"),
        F.col("date").cast("string").alias("created_at_utc"),
        (u % 3 == 0).alias("_third"),
    ).agg(F.max("event_id").cast("string").alias("run_id"), F.avg("watch_ratio").alias("recall_at_10")).drop("_third")


@register(
    "latest_runs",
    query(["latest"], f"SELECT panel, experiment_id, seed, created_at_utc, run_id, {r6('recall_at_10')} FROM latest"),
)
def latest_runs(spark, folder):
    return PF.latest_runs(run_records(World(spark, folder)))


@register(
    "seed_means",
    query(
        ["latest"],
        f"SELECT panel, experiment_id, {rx('avg(recall_at_10)', 'recall_at_10')}, count(DISTINCT seed) AS seed_count FROM latest GROUP BY 1, 2",
    ),
)
def seed_means(spark, folder):
    latest = PF.latest_runs(run_records(World(spark, folder)))
    return PF.seed_means(latest, ["panel", "experiment_id"], ["recall_at_10"])


@register(
    "baseline_compare",
    query(
        ["summary"],
        f"""
SELECT metric, {r6('baseline')}, {r6('current')}, {rx('current - baseline', 'diff')},
  CASE WHEN current IS NULL THEN 'pending' WHEN current > baseline THEN 'up' WHEN current < baseline THEN 'down' ELSE 'flat' END AS verdict
FROM (
  SELECT 'recall_at_10' AS metric, (SELECT recall_at_10 FROM f WHERE experiment_id = 'itemcf') AS baseline,
    (SELECT recall_at_10 FROM f WHERE experiment_id = 'tower') AS current
  UNION ALL SELECT 'ndcg_at_10', (SELECT ndcg_at_10 FROM f WHERE experiment_id = 'itemcf'), (SELECT ndcg_at_10 FROM f WHERE experiment_id = 'tower')
  UNION ALL SELECT 'coverage_at_10', 0.5::DOUBLE, NULL
)""",
        extra={"f": "SELECT * FROM summary WHERE evaluation = 'full_exposure'"},
    ),
)
def baseline_compare(spark, folder):
    """The tower channel against the item CF channel on the dense panel."""
    rows = cut_lineage(exposure_summary(World(spark, folder, prepared=True)).filter("evaluation = 'full_exposure'"))
    metrics = ["recall_at_10", "ndcg_at_10", "coverage_at_10"]
    base = rows.filter("experiment_id = 'itemcf'").select(
        F.explode(
            F.array(
                F.struct(F.lit("recall_at_10").alias("metric"), F.col("recall_at_10").alias("baseline")),
                F.struct(F.lit("ndcg_at_10").alias("metric"), F.col("ndcg_at_10").alias("baseline")),
                F.struct(F.lit("coverage_at_10").alias("metric"), F.lit(0.5).alias("baseline")),
            )
        ).alias("e")
    ).select("e.*")
    return PF.compare_to_baseline(rows.filter("experiment_id = 'tower'"), base, metrics)


@register(
    "daily_stability",
    query(
        ["cf_list", "emb_list", "cat_list", "truth", "items"],
        f"""
SELECT experiment_id, date, {rx('avg(r)', 'recall_at_10')} FROM ("""
        + " UNION ALL ".join(
            f"""
SELECT '{m}' AS experiment_id, t.date, t.user_id, count(l.item_id) / count(*) AS r FROM truth t LEFT JOIN (
  SELECT * FROM (SELECT g.user_id, g.date, l.item_id, row_number() OVER (PARTITION BY g.user_id, g.date ORDER BY l.rank) AS rank
    FROM (SELECT DISTINCT user_id, date FROM truth) g JOIN {s} l ON l.user_id = g.user_id
    JOIN items i ON i.item_id = l.item_id AND i.first_seen_date <= g.date) WHERE rank <= 10
) l ON l.user_id = t.user_id AND l.date = t.date AND l.item_id = t.item_id GROUP BY ALL"""
            for m, s in MODELS.items()
        )
        + ") GROUP BY ALL",
    ),
)
def daily_stability(spark, folder):
    """Mean of the group metrics by experiment and date."""
    from reelwise.operators.evaluate import available_on_date, recall_by_group

    w = World(spark, folder, prepared=True)
    rows = None
    for name, ranked in channel_lists(w).items():
        groups = recall_by_group(available_on_date(ranked, w.truth, w.items, 10), w.truth, 10)
        groups = groups.withColumn("experiment_id", F.lit(name))
        rows = groups if rows is None else rows.unionByName(groups)
    return rows.groupBy("experiment_id", "date").agg(F.avg("recall_at_10").alias("recall_at_10"))
