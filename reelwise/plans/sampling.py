"""Queries of the splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwise.operators import sampling as SM
from reelwise.operators.recall import popularity
from reelwise.plans.preparing import dense_panel
from reelwise.plans.registry import register
from reelwise.plans.sql import fragment, hash32, query, unit_hash
from reelwise.plans.world import World

SEED = 2026


@register(
    "stable_user_split",
    query(
        ["olog"],
        """
SELECT user_id, CASE WHEN substr(sha256('2026:' || user_id), 1, 16) < '8000000000000000'
  THEN 'full_val' ELSE 'full_test' END AS panel
FROM (SELECT DISTINCT user_id FROM olog)""",
    ),
)
def stable_user_split(spark, folder):
    return SM.hash_split(World(spark, folder, "orders").log, SEED, 0.5)


@register(
    "profile_users",
    f"""
WITH panel AS (SELECT c_custkey AS u FROM customer WHERE c_acctbal > 5000),
others AS (SELECT c_custkey AS u FROM customer WHERE NOT c_acctbal > 5000),
size AS (SELECT least((SELECT count(*) FROM panel), 240) AS n)
SELECT u AS user_id FROM (SELECT u, row_number() OVER (ORDER BY {hash32(SEED, 'u')}, u) AS r FROM panel), size WHERE r <= n
UNION ALL
SELECT u FROM (SELECT u, row_number() OVER (ORDER BY {hash32(SEED, 'u')}, u) AS r FROM others), size WHERE r <= 600 - n""",
)
def profile_users(spark, folder):
    users = World(spark, folder).table("customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    return SM.profile_users(users, users.filter("c_acctbal > 5000"), 600, 0.4, SEED)


@register(
    "cap_rows",
    query(
        ["log"],
        f"SELECT event_id, user_id, item_id FROM log ORDER BY {hash32(SEED, 'event_id')}, event_id LIMIT 3000",
    ),
)
def cap_rows(spark, folder):
    log = World(spark, folder).log
    return SM.cap_rows(log, 3000, SEED, ["event_id"]).select("event_id", "user_id", "item_id")


@register(
    "cap_eval_users",
    query(["olog"], f"SELECT DISTINCT user_id FROM olog QUALIFY true ORDER BY {hash32(7, 'user_id')}, user_id LIMIT 500"
          .replace("SELECT DISTINCT user_id FROM olog QUALIFY true", "SELECT user_id FROM (SELECT DISTINCT user_id FROM olog)")),
)
def cap_eval_users(spark, folder):
    return SM.cap_users(World(spark, folder, "orders").log, 500, 7)


@register(
    "cap_complete_users",
    query(
        ["log"],
        f"""
SELECT event_id, user_id FROM log WHERE user_id IN (
  SELECT user_id FROM (
    SELECT user_id, row_number() OVER (ORDER BY {hash32(SEED, 'user_id')}, user_id) AS r
    FROM (SELECT DISTINCT user_id FROM log)
  ) WHERE r <= (SELECT CASE WHEN count(*) <= 4000 THEN count(DISTINCT user_id)
    ELSE greatest(1, floor(count(DISTINCT user_id) * 4000 / count(*))) END FROM log))""",
    ),
)
def cap_complete_users(spark, folder):
    return SM.cap_complete_users(World(spark, folder).log, 4000, SEED).select("event_id", "user_id")


fragment(
    "panel",
    ["log"],
    """
SELECT user_id, item_id, (r >= 1)::INT AS label_complete, (r >= 2)::INT AS label_strong,
  (p < least(3000, v))::INT AS label_short, least(greatest(r, 0), 5) AS watch_ratio_clipped,
  (r >= 1)::INT + 0.5 * (r >= 2)::INT - 0.5 * (p < least(3000, v))::INT AS utility
FROM (SELECT user_id, item_id, max(watch_ratio) AS r, max(play_duration) AS p, max(video_duration) AS v
  FROM log GROUP BY ALL)""",
)
fragment("popularity", ["train"], "SELECT item_id, count(*) AS cnt FROM train GROUP BY 1")


def exposure_fragment(policy: str, weight: str, density: float) -> None:
    fragment(
        f"sample_{policy}",
        ["panel", "popularity"],
        f"""
SELECT * EXCLUDE (r, n) FROM (
  SELECT p.*, count(*) OVER () AS n,
    row_number() OVER (ORDER BY -ln({unit_hash(SEED, 'p.user_id', 'p.item_id')}) / ({weight}), p.user_id, p.item_id) AS r
  FROM panel p LEFT JOIN popularity q ON q.item_id = p.item_id
) WHERE r <= greatest(1, round_even(n * {density}, 0))""",
    )


POLICIES = {
    "uniform": ("1.0", 0.2),
    "popularity_biased": ("ln(1 + coalesce(q.cnt, 0)) + 1e-3", 0.1),
    "positive_biased": ("CASE WHEN p.label_complete = 1 THEN 5.0 ELSE 1.0 END", 0.1),
}
for _policy, (_weight, _density) in POLICIES.items():
    exposure_fragment(_policy, _weight, _density)


def sampled_panel(w: World, policy: str):
    return SM.sample_exposure(dense_panel(w), policy, POLICIES[policy][1], popularity(w.train), SEED)


def _register_exposure(policy: str) -> None:
    sql = query([f"sample_{policy}"], f"SELECT user_id, item_id, label_complete FROM sample_{policy}")

    @register(f"exposure_{policy}", sql)
    def run(spark, folder):
        return sampled_panel(World(spark, folder), policy).select("user_id", "item_id", "label_complete")


for _policy in POLICIES:
    _register_exposure(_policy)


@register(
    "negative_cap",
    query(
        ["log"],
        f"""
SELECT user_id, date, item_id, label FROM (
  SELECT *, sum(label) OVER (PARTITION BY user_id) AS pos,
    row_number() OVER (PARTITION BY user_id, label ORDER BY {hash32(SEED, 'user_id', 'item_id')}, item_id) AS r
  FROM (SELECT user_id, max(date) AS date, item_id, max(label_complete) AS label FROM log GROUP BY user_id, item_id)
) WHERE label = 1 OR r <= greatest(0, 40 - pos)""",
    ),
)
def negative_cap(spark, folder):
    rows = (
        World(spark, folder)
        .log.groupBy("user_id", "item_id")
        .agg(F.max("date").alias("date"), F.max("label_complete").cast("int").alias("label"))
    )
    return SM.cap_negatives(rows, 40, SEED, ["user_id"]).select("user_id", "date", "item_id", "label")


def _negatives_sql(log: str, items: str, ratio: float) -> str:
    hard = f"{unit_hash(SEED, chr(39) + 'mix' + chr(39), 'p.user_id', 'p.item_id')} < {ratio}"
    draw = hash32(SEED, "'neg'", "p.user_id", "p.item_id")
    return query(
        [log, items],
        f"""
SELECT b.user_id, b.item_id, coalesce(c.item_id, o.item_id) AS negative_id, b.hard::INT AS is_hard
FROM b
LEFT JOIN ix c ON b.near AND c.first_category = b.first_category AND c.cat_pos = b.spot
LEFT JOIN ix o ON NOT b.near AND o.pos = b.spot""",
        extra={
            "ix": f"""
SELECT *, row_number() OVER (PARTITION BY first_category ORDER BY item_id) - 1 AS cat_pos,
  row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER (PARTITION BY first_category) AS cat_size,
  count(*) OVER () AS size
FROM (SELECT item_id, first_category FROM {items} WHERE item_id IN (SELECT item_id FROM {log} WHERE split = 'train'))""",
            "a": f"""
SELECT p.*, i.first_category, i.cat_pos, i.pos, i.cat_size, i.size, {hard} AS hard, {draw} AS draw
FROM (SELECT DISTINCT user_id, item_id FROM {log} WHERE split = 'train' AND label_complete = 1) p
JOIN ix i ON i.item_id = p.item_id""",
            "b": """
SELECT *, hard AND cat_size > 1 AS near,
  CASE WHEN hard AND cat_size > 1 THEN (cat_pos + 1 + draw % greatest(cat_size - 1, 1)) % cat_size
       WHEN hard THEN (pos + 1 + draw % greatest(size - 1, 1)) % size ELSE draw % size END AS spot
FROM a""",
        },
    )


def _negatives(w: World, ratio: float):
    positives = w.train.filter("label_complete = 1").select("user_id", "item_id").distinct()
    known = w.items.join(w.train.select("item_id"), "item_id", "left_semi")
    return SM.draw_negatives(positives, known, SEED, ratio)


@register("hard_negatives", _negatives_sql("log", "items", 1.0))
def hard_negatives(spark, folder):
    return _negatives(World(spark, folder), 1.0)


@register("mixed_negatives", _negatives_sql("olog", "oitems", 0.5))
def mixed_negatives(spark, folder):
    return _negatives(World(spark, folder, "orders"), 0.5)


def scored_panel(w: World):
    """Panel rows with simple per-channel scores: the items' train popularity and rates as channels."""
    stats = w.train.groupBy("item_id").agg(
        F.count("*").alias("n"), F.avg("label_complete").alias("c"), F.avg("label_strong").alias("g")
    )
    return (
        dense_panel(w)
        .join(stats, "item_id", "left")
        .select(
            "user_id",
            F.lit(20240131).alias("date"),
            "item_id",
            "label_complete",
            F.coalesce(F.round("c", 6), F.lit(0.0)).alias("itemcf_rank_score"),
            F.coalesce(F.round("g", 6), F.lit(0.0)).alias("content_rank_score"),
            F.coalesce(F.round(1.0 / F.col("n"), 6), F.lit(0.0)).alias("tower_rank_score"),
        )
    )


fragment(
    "scored_panel",
    ["panel", "train"],
    """
SELECT p.user_id, 20240131 AS date, p.item_id, p.label_complete, coalesce(round(c, 6), 0) AS a,
  coalesce(round(g, 6), 0) AS b, coalesce(round(1.0::DOUBLE / n, 6), 0) AS t
FROM panel p LEFT JOIN (SELECT item_id, count(*) AS n, avg(label_complete) AS c, avg(label_strong) AS g
  FROM train GROUP BY 1) s ON s.item_id = p.item_id""",
)


@register(
    "pairwise_pairs",
    query(
        ["scored_panel"],
        f"""
SELECT p.user_id, p.date, p.item_id AS positive_id, n.item_id AS negative_id, p.draw
FROM draws p JOIN mixed n ON n.user_id = p.user_id AND n.date = p.date AND n.hard = p.hard AND n.spot = p.spot""",
        extra={
            "neg": """
SELECT user_id, date, item_id, row_number() OVER (PARTITION BY user_id, date ORDER BY greatest(a, b, t) DESC, item_id) - 1 AS spot
FROM scored_panel WHERE label_complete = 0""",
            "sizes": """
SELECT user_id, date, sum(label_complete) AS p, sum(1 - label_complete) AS n FROM scored_panel GROUP BY ALL
HAVING sum(label_complete) > 0 AND sum(1 - label_complete) > 0""",
            # A shuffle of the whole group and one of its strongest negatives.
            "mixed": f"""
SELECT user_id, date, item_id, hard, row_number() OVER (PARTITION BY user_id, date, hard
  ORDER BY {hash32(SEED, "'mix'", 'user_id', 'date', 'item_id')}, item_id) - 1 AS spot
FROM (SELECT user_id, date, item_id, false AS hard FROM neg
  UNION ALL SELECT user_id, date, item_id, true FROM neg JOIN sizes USING (user_id, date) WHERE spot < least(n, 2 * p))""",
            "draws": f"""
SELECT x.*, draw < least(pool, 2) AS hard, CASE WHEN draw < least(pool, 2)
  THEN ({hash32(SEED, "'hard'", 'x.user_id', 'x.date', 'x.item_id')} + draw) % pool
  ELSE ({hash32(SEED, "'any'", 'x.user_id', 'x.date', 'x.item_id')} + draw) % n END AS spot
FROM (
  SELECT s.user_id, s.date, s.item_id, d.draw, least(z.n, 2 * z.p) AS pool, z.n
  FROM scored_panel s JOIN sizes z ON z.user_id = s.user_id CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS draw) d
  WHERE s.label_complete = 1
) x""",
        },
    ),
)
def pairwise_pairs(spark, folder):
    return SM.pairwise_samples(scored_panel(World(spark, folder)), 4, SEED)


@register(
    "listwise_targets",
    query(
        ["log"],
        """
SELECT event_id, user_id, date, round(label_complete / t, 6) + 0.0 AS target, n AS group_size FROM (
  SELECT *, sum(label_complete) OVER w AS t, count(*) OVER w AS n FROM log WINDOW w AS (PARTITION BY user_id, date)
) WHERE t > 0""",
    ),
)
def listwise_targets(spark, folder):
    out = SM.listwise_targets(World(spark, folder).log)
    return out.select("event_id", "user_id", "date", "target", "group_size")
