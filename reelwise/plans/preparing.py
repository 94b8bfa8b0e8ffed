"""Queries of the preparation stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwise.functions.columns import utility, watch_regression
from reelwise.operators import prepare as P
from reelwise.operators import stats as ST
from reelwise.plans.registry import register
from reelwise.plans.sql import query, r6, rx
from reelwise.plans.world import World
from reelwise.sources import driver_tables as D


@register(
    "label_events",
    query(
        ["log"],
        f"""SELECT event_id, user_id, item_id, date, split, label_complete, label_strong, label_short,
        {rx('label_complete + 0.5 * label_strong - 0.5 * label_short', 'utility')},
        {rx('ln(1 + least(watch_ratio, 5))', 'watch_regression')},
        {r6('watch_ratio')} FROM log""",
    ),
)
def label_events(spark, folder):
    log = World(spark, folder).log
    return log.select(
        "event_id",
        "user_id",
        "item_id",
        "date",
        "split",
        "label_complete",
        "label_strong",
        "label_short",
        utility().alias("utility"),
        watch_regression().alias("watch_regression"),
        "watch_ratio",
    )


@register(
    "time_features",
    """
WITH t AS (
  SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date,
    CASE WHEN event_type = 'signup' THEN ts + INTERVAL 8 HOUR
         WHEN event_type = 'error' THEN date_trunc('day', ts) + INTERVAL 12 HOUR ELSE ts END AS local
  FROM events
)
SELECT event_id, date, hour(local) AS hour, isodow(local) - 1 AS weekday FROM t
""",
)
def time_features(spark, folder):
    """All three branches of the time cascade: local string, Unix seconds, noon of the date."""
    events = D.table(spark, folder, "events")
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6")
    raw = events.select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        D.day_number("ts").cast("double").alias("date"),
        F.when(F.col("event_type").isin("signup", "error"), None).otherwise(F.col("ts").cast("string")).alias("time"),
        F.when(F.col("event_type") == "error", None).otherwise(seconds).alias("timestamp"),
        (F.col("value") / 50).alias("watch_ratio"),
        (100 * F.col("value")).alias("play_duration"),
        F.lit(3000).alias("video_duration"),
    )
    return P.prepare_interactions(
        raw, train_end=D.EVENT_TRAIN_END, valid_end=D.EVENT_VALID_END
    ).select("event_id", "date", "hour", "weekday")


@register(
    "item_dimension",
    query(
        ["log"],
        """
SELECT p.p_partkey AS item_id,
  CASE WHEN p.p_size = 1 THEN -1 ELSE CAST(regexp_extract(p.p_brand, '[0-9]+') AS INTEGER) END AS first_category,
  coalesce(n.author_id, -1) AS author_id, coalesce(n.video_type, 'UNKNOWN') AS video_type,
  n.first_seen_date,
  round(coalesce(n.video_duration, m.med), 6) + 0.0 AS video_duration,
  coalesce(c.content_text, '') AS content_text
FROM part p
LEFT JOIN (
  SELECT d.item_id, l.author_id, l.video_type, l.video_duration, d.first_seen_date
  FROM (SELECT item_id, min(date) AS first_seen_date FROM daily GROUP BY 1) d
  LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY date DESC, author_id DESC,
      video_type DESC, video_duration DESC) AS rn FROM daily WHERE date <= 20240120) WHERE rn = 1
  ) l ON l.item_id = d.item_id
) n ON n.item_id = p.p_partkey
LEFT JOIN (SELECT item_id, median(video_duration) AS med FROM log GROUP BY 1) m ON m.item_id = p.p_partkey
LEFT JOIN (
  SELECT p_partkey AS item_id, p_name || ' ' || replace('UNKNOWN ' || p_type, 'UNKNOWN', '') || '   ' AS content_text FROM part
) c ON c.item_id = p.p_partkey
""",
        extra={
            "daily": """
SELECT item_id, date, user_id % 7 AS author_id,
  CASE WHEN label_short = 1 THEN 'AD' ELSE 'NORMAL' END AS video_type, CAST(NULL AS DOUBLE) AS video_duration
FROM log"""
        },
    ),
)
def item_dimension(spark, folder):
    """Categories from list literals, daily attributes from the log, captions from the part names."""
    w = World(spark, folder)
    part = w.table("part")
    size_one = F.col("p_size") == 1
    number = F.regexp_extract("p_brand", "[0-9]+", 0)
    categories = part.select(
        F.col("p_partkey").alias("item_id"),
        F.when(size_one, F.lit("[]")).otherwise(F.concat(F.lit("["), number, F.lit(", 3]"))).alias("feat"),
    )
    daily = w.log.select(
        "item_id",
        "date",
        (F.col("user_id") % 7).alias("author_id"),
        F.when(F.col("label_short") == 1, "AD").otherwise("NORMAL").alias("video_type"),
        F.lit(None).cast("double").alias("video_duration"),
    )
    captions = part.select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("manual_cover_text"),
        F.lit("UNKNOWN").alias("caption"),
        F.col("p_type").alias("topic_tag"),
        *[F.lit(None).cast("string").alias(f"{n}_level_category_name") for n in ("first", "second", "third")],
    )
    return P.item_dimension(categories, daily, captions, w.log, D.EVENT_TRAIN_END)


STAT_NAMES = ["complete_rate", "strong_rate", "short_rate", "mean_watch_ratio"]


def past_sql(history: str) -> dict[str, str]:
    out = {}
    for key, p in (("user_id", "user"), ("item_id", "item")):
        window = f"OVER (PARTITION BY {key} ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        out[f"{p}_past"] = f"""
SELECT {key}, date, nullif(n, 0) AS {p}_interactions, c / nullif(n, 0) AS {p}_complete_rate,
  g / nullif(n, 0) AS {p}_strong_rate, s / nullif(n, 0) AS {p}_short_rate, w / nullif(n, 0) AS {p}_mean_watch_ratio
FROM (
  SELECT DISTINCT {key}, date, sum(h) {window} AS n, sum(h * label_complete) {window} AS c,
    sum(h * label_strong) {window} AS g, sum(h * label_short) {window} AS s,
    sum(h * least(watch_ratio, 5)) {window} AS w
  FROM (SELECT *, CASE WHEN {history} THEN 1 ELSE 0 END AS h FROM log)
)"""
    return out


_PAST_SELECT = f"""
SELECT t.event_id, t.date, CAST(user_interactions AS BIGINT) AS user_interactions,
  CAST(item_interactions AS BIGINT) AS item_interactions,
  {r6(*[f'{p}_{n}' for p in ('user', 'item') for n in STAT_NAMES])}
FROM log t LEFT JOIN user_past u ON u.user_id = t.user_id AND u.date = t.date
LEFT JOIN item_past i ON i.item_id = t.item_id AND i.date = t.date
"""
_PAST_COLUMNS = ["event_id", "date"] + [
    f"{p}_{n}" for p in ("user", "item") for n in ["interactions", *STAT_NAMES]
]


@register("history_stats_asof", query(["log"], _PAST_SELECT, past_sql("true")))
def history_stats_asof(spark, folder):
    return ST.strict_past_stats(World(spark, folder).log).select(*_PAST_COLUMNS)


@register(
    "attach_history_stats",
    query(["log"], _PAST_SELECT + " WHERE t.split = 'test'", past_sql("split = 'train'")),
)
def attach_history_stats(spark, folder):
    w = World(spark, folder)
    target = w.log.filter(F.col("split") == "test").withColumn("item_complete_rate", F.lit(9.0))
    return ST.attach_past_stats(target, w.train).select(*_PAST_COLUMNS)


@register(
    "large_log_history_stats",
    query(
        ["olog"],
        f"""
SELECT item_id, count(*) AS item_interactions, {rx('avg(label_complete)', 'item_complete_rate')},
  {rx('avg(label_strong)', 'item_strong_rate')}, {rx('avg(label_short)', 'item_short_rate')},
  {rx('avg(least(watch_ratio, 5))', 'item_mean_watch_ratio')}
FROM olog GROUP BY 1""",
    ),
)
def large_log_history_stats(spark, folder):
    return ST.history_stats(World(spark, folder, "orders").log, "item_id")


@register(
    "prepare_summary",
    query(
        ["log"],
        """
SELECT 4 AS prepared_version, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
  count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'valid') AS valid_rows,
  count(*) FILTER (split = 'test') AS test_rows, round(avg(label_complete), 6) + 0.0 AS complete_rate,
  (SELECT count(DISTINCT user_id) FROM log WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS panel_users_in_log
FROM log""",
    ),
)
def prepare_summary(spark, folder):
    w = World(spark, folder)
    panel = w.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return P.prepared_summary(w.log, panel)


@register("split_counts", query(["log"], "SELECT split, count(*) AS rows FROM log GROUP BY 1"))
def split_counts(spark, folder):
    return P.split_counts(World(spark, folder).log)


def dense_panel(w: World):
    """The test part of the log as a dense panel: one row per pair with the highest feedback."""
    pairs = w.log.groupBy("user_id", "item_id").agg(
        F.max("watch_ratio").alias("watch_ratio"),
        F.max("play_duration").alias("play_duration"),
        F.max("video_duration").alias("video_duration"),
        F.min("date").alias("date"),
    )
    users = w.log.select("user_id").distinct()
    return P.prepare_panel(pairs, users, "full_test", 20240131)


@register(
    "panel_rows",
    query(
        ["log"],
        """
SELECT user_id, item_id, source_date, 20240131 AS date, 'full_test' AS split, 12 AS hour, 2 AS weekday,
  (r >= 1)::INT AS label_complete, (r >= 2)::INT AS label_strong, (p < least(3000, v))::INT AS label_short,
  round(least(greatest(r, 0), 5), 6) + 0.0 AS watch_ratio_clipped,
  round((r >= 1)::INT + 0.5 * (r >= 2)::INT - 0.5 * (p < least(3000, v))::INT, 6) + 0.0 AS utility
FROM (SELECT user_id, item_id, max(watch_ratio) AS r, max(play_duration) AS p, max(video_duration) AS v,
  min(date) AS source_date FROM log GROUP BY ALL)""",
    ),
)
def panel_rows(spark, folder):
    w = World(spark, folder)
    return dense_panel(w).drop("watch_ratio", "play_duration", "video_duration")


@register("panel_catalog", query(["log"], "SELECT DISTINCT item_id FROM log WHERE item_id IS NOT NULL"))
def panel_catalog(spark, folder):
    return P.panel_catalog(World(spark, folder).log)


@register(
    "pointwise_training_rows",
    query(
        ["log", "items"],
        """SELECT l.event_id, l.date, i.author_id, i.first_category, i.first_seen_date FROM log l
        LEFT JOIN items i ON i.item_id = l.item_id WHERE l.split = 'train' AND l.date > 20240105""",
    ),
)
def pointwise_training_rows(spark, folder):
    w = World(spark, folder)
    frame = ST.pointwise_training_rows(ST.pointwise_frame(w.log, w.items), 20240105)
    return frame.select("event_id", "date", "author_id", "first_category", "first_seen_date")
