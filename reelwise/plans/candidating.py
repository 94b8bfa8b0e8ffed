"""Queries of the candidate table, its encoding, and point-in-time histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwise import schema as S
from reelwise.operators import candidates as C
from reelwise.operators import history as H
from reelwise.operators.recall import category_recall
from reelwise.plans.recalling import K, LENGTH, embedding_lists, itemcf
from reelwise.plans.registry import register
from reelwise.plans.sql import fragment, query, r6, rx
from reelwise.plans.world import World, stored
from reelwise.sources import driver_tables as D

CHANNEL_LISTS = {"itemcf": "cf_list", "content": "cat_list", "tower": "emb_list"}
TOP, WEIGHTS = 15, {"content": 0.5, "tower": 1.0}
LIMITS = {"itemcf": 15, "content": 8, "tower": 15}  # what TOP and WEIGHTS come to
SPARSE = ["user_id", "item_id", "first_category", "author_id_hash"]
DENSE = ["itemcf_rank_score", "channel_count", "user_complete_rate", "item_interactions", "category_affinity"]


def channel_lists(w: World):
    """The three channels, each written once: merging, overlap and evaluation read them again."""
    builders = {
        "itemcf": lambda: itemcf(w, K),
        "content": lambda: category_recall(w.train, w.items, w.users, w.seen, K, LENGTH),
        "tower": lambda: embedding_lists(w),
    }
    columns = ["user_id", "item_id", "rank"]
    return {
        name: stored(w, f"channel_{name}", lambda: build().select(*columns)) for name, build in builders.items()
    }


def candidate_frame(w: World, **options):
    """(candidates, truth) of the test days."""
    name = "candidates" + "".join(f"_{key}_{value}" for key, value in sorted(options.items()))
    build = lambda: C.build_candidates(w.log, w.items, "test", channel_lists(w), TOP, WEIGHTS, **options)[0]
    return stored(w, name, build), w.truth


fragment(
    "merged",
    ["truth", "items", *CHANNEL_LISTS.values()],
    "SELECT user_id, date, item_id, "
    + ", ".join(
        f"max((ch = '{c}')::INT)::DOUBLE AS {c}_present, coalesce(1.0::DOUBLE / min(r) FILTER (ch = '{c}'), 0) AS {c}_rank_score"
        for c in S.CHANNELS
    )
    + " FROM ("
    + " UNION ALL ".join(
        f"""
SELECT * FROM (
  SELECT g.user_id, g.date, l.item_id, '{c}' AS ch, row_number() OVER (PARTITION BY g.user_id, g.date ORDER BY l.rank) AS r
  FROM (SELECT DISTINCT user_id, date FROM truth) g JOIN {CHANNEL_LISTS[c]} l ON l.user_id = g.user_id
  JOIN items i ON i.item_id = l.item_id AND i.first_seen_date <= g.date
) WHERE r <= {LIMITS[c]}"""
        for c in S.CHANNELS
    )
    + ") GROUP BY ALL",
)
fragment(
    "exposed",
    ["log"],
    """
SELECT user_id, date, item_id, max(label_complete) AS label_complete, max(label_strong) AS label_strong,
  max(label_short) AS label_short FROM log WHERE split = 'test' GROUP BY ALL""",
)


def affinity_sql(attribute: str, name: str) -> str:
    return f"""
SELECT user_id, {attribute}, count(*) / any_value(n) AS {name} FROM (
  SELECT t.user_id, i.{attribute}, count(*) OVER (PARTITION BY t.user_id) AS n FROM train t
  LEFT JOIN items i ON i.item_id = t.item_id WHERE t.label_complete = 1
) GROUP BY user_id, {attribute}"""


fragment("cat_aff", ["train", "items"], affinity_sql("first_category", "category_affinity"))
fragment("aut_aff", ["train", "items"], affinity_sql("author_id", "author_affinity"))
for _key, _side in (("user_id", "user"), ("item_id", "item")):
    fragment(
        f"{_side}_stats",
        ["train"],
        f"""
SELECT {_key}, count(*) AS {_side}_interactions, avg(label_complete) AS {_side}_complete_rate,
  avg(label_strong) AS {_side}_strong_rate, avg(label_short) AS {_side}_short_rate,
  avg(least(watch_ratio, 5)) AS {_side}_mean_watch_ratio FROM train GROUP BY 1""",
    )
_filled = [f"coalesce({n}, 0) AS {n}" for n in S.USER_FEATURES + S.ITEM_STAT_FEATURES + S.AFFINITY_FEATURES]
fragment(
    "cand_raw",
    ["merged", "exposed", "truth", "items", "cat_aff", "aut_aff", "user_stats", "item_stats"],
    f"""
SELECT m.*, (t.item_id IS NOT NULL)::INT AS label, e.label_complete, e.label_strong, e.label_short,
  i.first_category, i.video_duration, i.author_id % 256 AS author_id_hash,
  m.itemcf_present + m.content_present + m.tower_present AS channel_count,
  (s.item_id IS NULL)::INT AS is_cold_item,
  greatest(0, date_diff('day', strptime(CAST(i.first_seen_date AS VARCHAR), '%Y%m%d'), strptime(CAST(m.date AS VARCHAR), '%Y%m%d'))) AS item_age_days,
  {', '.join(_filled)}
FROM merged m JOIN exposed e USING (user_id, date, item_id)
LEFT JOIN truth t USING (user_id, date, item_id)
LEFT JOIN items i ON i.item_id = m.item_id
LEFT JOIN cat_aff ca ON ca.user_id = m.user_id AND ca.first_category = i.first_category
LEFT JOIN aut_aff aa ON aa.user_id = m.user_id AND aa.author_id = i.author_id
LEFT JOIN user_stats us ON us.user_id = m.user_id LEFT JOIN item_stats s ON s.item_id = m.item_id""",
)
fragment(
    "cand",
    ["cand_raw"],
    """
SELECT *, category_affinity * item_complete_rate AS category_item_complete_cross,
  author_affinity * item_complete_rate AS author_item_complete_cross,
  channel_count * item_complete_rate AS channel_item_complete_cross,
  is_cold_item * content_present AS cold_content_cross, tower_present * item_age_days AS tower_age_cross
FROM cand_raw""",
)


def f4(*names: str) -> str:
    """Features are stored as floats; compare them to 4 digits."""
    return ", ".join(f"round(CAST({n} AS DOUBLE) + 3e-6, 4) + 0.0 AS {n}" for n in names)


def rounded4(df, names):
    return df.withColumns({n: F.round(F.col(n).cast("double") + F.lit(3e-6), 4) for n in names})


@register(
    "candidate_merge",
    query(
        ["merged"],
        f"SELECT user_id, date, item_id, {', '.join(f'{c}_present' for c in S.CHANNELS)}, {r6(*[f'{c}_rank_score' for c in S.CHANNELS])} FROM merged",
    ),
)
def candidate_merge(spark, folder):
    w = World(spark, folder, prepared=True)
    return C.merge_channels(w.truth, channel_lists(w), w.items, TOP, WEIGHTS)


@register(
    "candidate_features",
    query(["cand"], f"SELECT user_id, date, item_id, label, {', '.join(S.LABELS)}, {f4(*S.FEATURES)} FROM cand"),
)
def candidate_features(spark, folder):
    frame, _ = candidate_frame(World(spark, folder, prepared=True))
    return rounded4(frame.select("user_id", "date", "item_id", "label", *S.LABELS, *S.FEATURES), S.FEATURES)


@register("candidate_features_capped")
def candidate_features_capped(spark, folder):
    """Training form: negatives capped so that a group holds at most four rows beyond its positives."""
    frame, _ = candidate_frame(World(spark, folder, prepared=True), max_per_group=4, seed=7)
    return frame.groupBy("user_id", "date").agg(
        F.count("*").alias("rows"), F.sum(F.col("label").cast("int")).alias("positives")
    )


@register("category_affinity", query(["cat_aff"], f"SELECT user_id, first_category, {r6('category_affinity')} FROM cat_aff"))
def category_affinity(spark, folder):
    w = World(spark, folder)
    return C.affinity(w.train, w.items, "first_category", "category_affinity")


@register(
    "eligible_catalog",
    query(["items", "log"], "SELECT count(*) AS catalog_size FROM items WHERE first_seen_date <= (SELECT max(date) FROM log WHERE split = 'test')"),
)
def eligible_catalog(spark, folder):
    w = World(spark, folder)
    return C.catalog_size(w.items, w.log, "test")


@register(
    "encode_candidates",
    query(
        ["cand"],
        "SELECT user_id, date, item_id, "
        + ", ".join(f"coalesce(v_{c}.code, 0) AS {c}_code" for c in SPARSE)
        + ", "
        + ", ".join(
            f"round((CAST({d} AS FLOAT)::DOUBLE - m_{d}) / CASE WHEN s_{d} < 1e-6 THEN 1 ELSE s_{d} END + 3e-6, 4) + 0.0 AS {d}_z"
            for d in DENSE
        )
        + " FROM (SELECT * FROM cand WHERE date >= 20240128) c, st "
        + " ".join(f"LEFT JOIN v_{c} ON v_{c}.value = c.{c}" for c in SPARSE),
        extra={
            "fit": "SELECT * FROM cand WHERE date < 20240128",
            "st": "SELECT "
            + ", ".join(f"avg(CAST({d} AS FLOAT)::DOUBLE) AS m_{d}, stddev_pop(CAST({d} AS FLOAT)::DOUBLE) AS s_{d}" for d in DENSE)
            + " FROM fit",
            **{
                f"v_{c}": f"SELECT value, row_number() OVER (ORDER BY value) AS code FROM (SELECT DISTINCT {c} AS value FROM fit)"
                for c in SPARSE
            },
        },
    ),
)
def encode_candidates(spark, folder):
    """Encoder fitted on the earlier candidate days, applied to the later ones."""
    frame, _ = candidate_frame(World(spark, folder, prepared=True))
    fit, apply = C.selection_split(frame, 20240128)
    vocab, stats = C.fit_encoder(fit, SPARSE, DENSE)
    out = C.encode(apply, vocab, stats, SPARSE, DENSE)
    zs = [f"{d}_z" for d in DENSE]
    return rounded4(out.select("user_id", "date", "item_id", *[f"{c}_code" for c in SPARSE], *zs), zs)


@register(
    "source_mask",
    query(
        ["merged"],
        """SELECT (itemcf_present + 2 * content_present + 4 * tower_present)::INT AS mask, count(*) AS rows
        FROM merged WHERE itemcf_present = 1 OR content_present = 1 GROUP BY 1""",
    ),
)
def source_mask(spark, folder):
    """Channel bit masks of the candidates left by the no-tower ablation."""
    w = World(spark, folder, prepared=True)
    kept = C.without_tower_only(C.merge_channels(w.truth, channel_lists(w), w.items, TOP, WEIGHTS))
    return kept.groupBy(C.source_mask().alias("mask")).agg(F.count("*").alias("rows"))


def history_sql(log: str, where: str, length: int, targets: str) -> str:
    gap = "date_diff('day', strptime(CAST(date AS VARCHAR), '%Y%m%d'), strptime(CAST(as_of AS VARCHAR), '%Y%m%d'))"
    return f"""
SELECT h.user_id, as_of AS date, pos, h.item_id, coalesce(i.first_category, -1) AS first_category,
  coalesce(i.author_id, -1) % 256 AS author_id_hash, 1 + label_complete + 2 * label_strong + 4 * label_short AS behaviour,
  {rx('least(greatest(watch_ratio, 0), 5) / 5', 'watch')}, {rx(f'ln(1 + greatest({gap}, 0)) / ln(91)', 'gap')}
FROM (
  SELECT l.*, t.date AS as_of, row_number() OVER (PARTITION BY l.user_id, t.date ORDER BY l.date DESC, l.timestamp DESC, l.event_id DESC) - 1 AS pos
  FROM {targets} t JOIN {log} l ON l.user_id = t.user_id AND l.date < t.date WHERE {where}
) h LEFT JOIN items i ON i.item_id = h.item_id WHERE pos < {length}"""


def exploded(histories):
    """One row per history event with `pos` counted back from the newest."""
    return histories.select(
        "user_id", "date", F.size("history").alias("_n"), F.posexplode("history").alias("_i", "e")
    ).select("user_id", "date", (F.col("_n") - 1 - F.col("_i")).alias("pos"), "e.*")


TARGETS = "(SELECT DISTINCT user_id, date FROM log WHERE split = 'test')"


@register("pit_history", query(["log", "items"], history_sql("log", "true", 50, TARGETS)))
def pit_history(spark, folder):
    w = World(spark, folder)
    targets = w.log.filter("split = 'test'")
    return exploded(H.history_as_of(w.log, targets, w.items, 50))


@register("pit_positive_history", query(["log", "items"], history_sql("log", "label_complete = 1", 10, TARGETS)))
def pit_positive_history(spark, folder):
    w = World(spark, folder)
    targets = w.log.filter("split = 'test'")
    return exploded(H.history_as_of(w.log, targets, w.items, 10, positives_only=True))


@register(
    "history_with_vectors",
    query(
        ["log"],
        f"""
SELECT h.user_id, as_of AS date, count(*) AS events, {rx('sum(e.embedding[1]::DOUBLE)', 'first_dim')} FROM (
  SELECT l.*, t.date AS as_of, row_number() OVER (PARTITION BY l.user_id, t.date ORDER BY l.date DESC, l.timestamp DESC, l.event_id DESC) AS r
  FROM {TARGETS} t JOIN log l ON l.user_id = t.user_id AND l.date < t.date
) h LEFT JOIN embeddings e ON e.vec_id = h.item_id WHERE r <= 20 GROUP BY ALL""",
    ),
)
def history_with_vectors(spark, folder):
    w = World(spark, folder)
    targets = w.log.filter("split = 'test'")
    histories = H.history_as_of(w.log, targets, w.items, 20, content=D.embedding_items(spark, folder))
    checked = H.require_histories(targets.select("user_id", "date").distinct(), histories).select("user_id", "date")
    rows = exploded(histories.join(checked, ["user_id", "date"], "left_semi"))
    return rows.groupBy("user_id", "date").agg(
        F.count("*").alias("events"), F.sum(F.col("vector")[0].cast("double")).alias("first_dim")
    )
