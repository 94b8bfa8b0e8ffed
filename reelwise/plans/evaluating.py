"""Queries of fusion, reranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwise.operators import evaluate as E
from reelwise.operators import rerank as RR
from reelwise.operators import scoring_metrics as SC
from reelwise.operators.candidates import catalog_size
from reelwise.operators.ranked import retrieval_depth
from reelwise.operators.recall import category_recall, popular_scores, popularity, recommend_ranked
from reelwise.plans.candidating import K, LENGTH, candidate_frame, channel_lists
from reelwise.plans.preparing import dense_panel
from reelwise.plans.recalling import embedding_lists, first_unseen_sql, itemcf
from reelwise.plans.registry import register
from reelwise.plans.sampling import POLICIES, sampled_panel
from reelwise.plans.sql import fragment, hash32, query, r6, rx
from reelwise.plans.world import World
from reelwise.session import cut_lineage
from reelwise.sources import driver_tables as D

GAIN = "1 / log2(rank + 1)"
DEPTH = retrieval_depth(20, dense_panel=True)  # deep enough that the availability filter leaves full lists


def ideal_sql(pos: str, k: int) -> str:
    return f"list_sum(list_transform(generate_series(1, least({pos}, {k})::BIGINT), lambda x: 1 / log2(x + 1)))"


def daily_fragment(name: str, source: str, prefix: str, k: int) -> None:
    """A channel's list on each truth group, cut to available items."""
    fragment(
        name,
        [source, f"{prefix}truth", f"{prefix}items"],
        f"""
SELECT * FROM (
  SELECT g.user_id, g.date, l.item_id, row_number() OVER (PARTITION BY g.user_id, g.date ORDER BY l.rank, l.item_id) AS rank
  FROM (SELECT DISTINCT user_id, date FROM {prefix}truth) g JOIN {source} l ON l.user_id = g.user_id
  JOIN {prefix}items i ON i.item_id = l.item_id AND i.first_seen_date <= g.date
) WHERE rank <= {k}""",
    )


def group_fragment(name: str, ranked: str, truth: str, ks: list[int], keys: str = "user_id, date") -> None:
    columns = []
    for k in ks:
        columns += [
            f"count(*) FILTER (rank <= {k}) / count(*) AS recall_at_{k}",
            f"coalesce(sum({GAIN}) FILTER (rank <= {k}), 0) / {ideal_sql('count(*)', k)} AS ndcg_at_{k}",
            f"(count(*) FILTER (rank <= {k}) > 0)::INT::DOUBLE AS hit_rate_at_{k}",
        ]
    fragment(
        name,
        [ranked, truth],
        f"SELECT {keys}, {', '.join(columns)} FROM {truth} LEFT JOIN {ranked} USING ({keys}, item_id) GROUP BY {keys}",
    )


fragment("pop_list", ["pop_all", "users", "seen"], first_unseen_sql("pop_all", "users", "seen", DEPTH))
fragment("pop_count", ["train"], "SELECT item_id, count(*) AS cnt FROM train GROUP BY 1")
daily_fragment("pop_daily", "pop_list", "", 20)
group_fragment("pop_groups", "pop_daily", "truth", [5, 10, 20])
METRICS = [f"{m}_at_{k}" for k in (5, 10, 20) for m in ("recall", "ndcg", "hit_rate")]
POP_METRICS = query(
    ["pop_groups", "pop_daily", "pop_count", "items", "log"],
    f"""
SELECT {', '.join(rx(f'avg({m})', m) for m in METRICS)},
  count(DISTINCT user_id) AS evaluated_users, count(*) AS evaluated_groups,
  {', '.join(rx(f'(SELECT count(DISTINCT item_id) FROM pop_daily WHERE rank <= {k}) / (SELECT n FROM size)', f'coverage_at_{k}') for k in (5, 10, 20))},
  {', '.join(rx(f'(SELECT avg(ln(1 + coalesce(cnt, 0))) FROM pop_daily LEFT JOIN pop_count USING (item_id) WHERE rank <= {k})', f'average_log_popularity_at_{k}') for k in (5, 10, 20))}
FROM pop_groups""",
    extra={"size": "SELECT count(*) AS n FROM items WHERE first_seen_date <= (SELECT max(date) FROM log WHERE split = 'test')"},
)


def popular_daily(w: World, k: int = 20):
    ranked = recommend_ranked(popular_scores(w.train), w.users, w.seen, DEPTH)
    return E.available_on_date(ranked, w.truth, w.items, k)


@register("popular_recall_eval", POP_METRICS)
def popular_recall_eval(spark, folder):
    """Flagship: log, labels, split, popularity lists, truth, recall family at several cutoffs."""
    w = World(spark, folder)
    size = catalog_size(w.items, w.log, "test").scalar()
    return E.recall_metrics(cut_lineage(popular_daily(w)), w.truth, popularity(w.train), size, [5, 10, 20])


@register("recall_groups", query(["pop_groups"], f"SELECT user_id, date, {r6(*METRICS)} FROM pop_groups"))
def recall_groups(spark, folder):
    w = World(spark, folder)
    return E.recall_by_group(popular_daily(w), w.truth, [5, 10, 20])


@register("merged_group_tables", query(["pop_groups"], f"SELECT user_id, date, {r6(*METRICS[:6])} FROM pop_groups"))
def merged_group_tables(spark, folder):
    """Cutoffs computed apart and joined on the group."""
    w = World(spark, folder)
    daily = cut_lineage(popular_daily(w))
    return E.merge_group_tables([E.recall_by_group(daily, w.truth, k) for k in (5, 10)])



@register(
    "cold_recall",
    query(
        ["ecat_list", "etruth", "etrain", "eitems"],
        f"""
SELECT {rx('avg(r)', 'cold_recall_at_20')}, count(DISTINCT user_id) AS cold_evaluated_users, count(*) AS cold_evaluated_groups
FROM (
  SELECT t.user_id, t.date, count(d.item_id) / count(*) AS r
  FROM etruth t LEFT JOIN (
    SELECT * FROM (
      SELECT g.user_id, g.date, l.item_id, row_number() OVER (PARTITION BY g.user_id, g.date ORDER BY l.rank, l.item_id) AS rank
      FROM (SELECT DISTINCT user_id, date FROM etruth) g JOIN ecat_list l ON l.user_id = g.user_id
      JOIN eitems i ON i.item_id = l.item_id AND i.first_seen_date <= g.date
    ) WHERE rank <= 20
  ) d ON d.user_id = t.user_id AND d.date = t.date AND d.item_id = t.item_id
  WHERE t.item_id NOT IN (SELECT item_id FROM etrain)
  GROUP BY ALL
)""",
    ),
)
def cold_recall(spark, folder):
    """Category lists on a short training window: positives of items unseen in training."""
    w = World(spark, folder, "early", prepared=True)
    ranked = category_recall(w.train, w.items, w.users, w.seen, K, LENGTH)
    daily = E.available_on_date(ranked, w.truth, w.items, 20)
    return E.cold_recall(daily, w.truth, w.train.select("item_id").distinct(), 20)


@register(
    "evaluation_context",
    query(
        ["truth", "items"],
        """SELECT count(*) AS pairs, count(DISTINCT user_id) AS users, min(date) AS first_date,
        (SELECT count(*) FROM items WHERE first_seen_date <= (SELECT max(date) FROM truth WHERE date >= 20240128)) AS catalog_size
        FROM truth WHERE date >= 20240128""",
    ),
)
def evaluation_context(spark, folder):
    w = World(spark, folder)
    truth, _, size = E.evaluation_context(w.log, w.items, w.users, "test", ["train"], 20240128)
    return truth.agg(
        F.count("*").alias("pairs"), F.countDistinct("user_id").alias("users"), F.min("date").alias("first_date")
    ).withColumn("catalog_size", size.scalar())


# --- dense panel --------------------------------------------------------------------------------

PANEL_METRICS = [
    "precision", "recall", "hit_rate", "ndcg", "complete_rate", "strong_rate", "short_rate", "watch_ratio",
    "utility", "average_log_popularity",
]
fragment(
    "walked",
    ["emb_list", "panel"],
    """
SELECT l.user_id, l.item_id, l.rank, l.item_id IN (SELECT item_id FROM panel) AS inside, p.label_complete,
  p.label_strong, p.label_short, p.watch_ratio_clipped, p.utility,
  sum((p.user_id IS NOT NULL)::INT) OVER (PARTITION BY l.user_id ORDER BY l.rank) AS good
FROM emb_list l LEFT JOIN panel p ON p.user_id = l.user_id AND p.item_id = l.item_id""",
)
fragment(
    "panel_users",
    ["walked", "panel", "pop_count"],
    f"""
SELECT u.user_id, count(w.item_id) AS recommended_count, coalesce(sum(w.label_complete), 0) / 5 AS precision_at_5,
  CASE WHEN u.pos > 0 THEN coalesce(sum(w.label_complete), 0) / u.pos ELSE 0 END AS recall_at_5,
  (coalesce(sum(w.label_complete), 0) > 0)::INT::DOUBLE AS hit_rate_at_5,
  CASE WHEN u.pos > 0 THEN coalesce(sum(w.label_complete / log2(w.good + 1)), 0) / {ideal_sql('u.pos', 5)} ELSE 0 END AS ndcg_at_5,
  coalesce(avg(w.label_complete), 0) AS complete_rate_at_5, coalesce(avg(w.label_strong), 0) AS strong_rate_at_5,
  coalesce(avg(w.label_short), 0) AS short_rate_at_5, coalesce(avg(w.watch_ratio_clipped), 0) AS watch_ratio_at_5,
  coalesce(avg(w.utility::DOUBLE), 0) AS utility_at_5,
  coalesce(avg(CASE WHEN w.item_id IS NOT NULL THEN ln(1 + coalesce(c.cnt, 0)) END), 0) AS average_log_popularity_at_5
FROM (SELECT user_id, sum(label_complete) AS pos FROM panel GROUP BY 1) u
LEFT JOIN walked w ON w.user_id = u.user_id AND w.label_complete IS NOT NULL AND w.good <= 5
LEFT JOIN pop_count c ON c.item_id = w.item_id
GROUP BY u.user_id, u.pos""",
)


def panel_evaluation(w: World):
    feedback = cut_lineage(dense_panel(w))
    ranked = embedding_lists(w)
    catalog = feedback.select("item_id").distinct()
    return E.dense_panel_metrics(ranked, feedback, catalog, 5, popularity(w.train))


@register(
    "dense_panel_users",
    query(["panel_users"], f"SELECT user_id, recommended_count, {r6(*[f'{m}_at_5' for m in PANEL_METRICS])} FROM panel_users"),
)
def dense_panel_users(spark, folder):
    return panel_evaluation(World(spark, folder, prepared=True))[1]


@register(
    "dense_panel_eval",
    query(
        ["panel_users", "walked", "panel"],
        f"""
SELECT {', '.join(rx(f'avg({m})', m) for m in ['recommended_count'] + [f'{m}_at_5' for m in PANEL_METRICS])},
  count(*) AS evaluated_users,
  {rx('(SELECT count(DISTINCT item_id) FROM walked WHERE label_complete IS NOT NULL AND good <= 5) / (SELECT count(DISTINCT item_id) FROM panel)', 'coverage_at_5')},
  (SELECT count(DISTINCT item_id) FROM panel) AS catalog_size, (SELECT count(*) FROM panel) AS evaluated_pairs,
  {rx('(SELECT count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) FROM panel)', 'matrix_density')},
  (SELECT count(*) FROM walked WHERE NOT inside AND good < 5) AS invalid_recommendations,
  (SELECT count(*) FROM walked WHERE inside AND label_complete IS NULL AND good < 5) AS unobserved_recommendation_pairs
FROM panel_users""",
    ),
)
def dense_panel_eval(spark, folder):
    return panel_evaluation(World(spark, folder, prepared=True))[0]


def replay_sql(policy: str, source: str, k: int) -> str:
    return f"""
SELECT {', '.join(rx(f'avg({m})', m) for m in (f'recall_at_{k}', f'ndcg_at_{k}', f'hit_rate_at_{k}'))},
  count(*) AS evaluated_users, count(*) AS evaluated_groups,
  {rx(f'(SELECT count(DISTINCT item_id) FROM {source} WHERE rank <= {k} AND user_id IN (SELECT user_id FROM sample_{policy} WHERE label_complete = 1)) / (SELECT count(DISTINCT item_id) FROM panel)', f'coverage_at_{k}')},
  (SELECT count(*) FROM sample_{policy}) AS observed_pairs,
  (SELECT count(DISTINCT user_id) FROM sample_{policy}) AS observed_users,
  (SELECT sum(label_complete)::BIGINT FROM sample_{policy}) AS observed_positive_pairs,
  {rx(f'(SELECT avg(label_complete) FROM sample_{policy})', 'observed_positive_rate')}
FROM (
  SELECT t.user_id, count(*) FILTER (rank <= {k}) / count(*) AS recall_at_{k},
    coalesce(sum({GAIN}) FILTER (rank <= {k}), 0) / {ideal_sql('count(*)', k)} AS ndcg_at_{k},
    (count(*) FILTER (rank <= {k}) > 0)::INT::DOUBLE AS hit_rate_at_{k}
  FROM sample_{policy} t LEFT JOIN {source} l ON l.user_id = t.user_id AND l.item_id = t.item_id
  WHERE t.label_complete = 1 GROUP BY 1
)"""


@register("sparse_replay", query(["sample_uniform", "emb_list", "panel"], replay_sql("uniform", "emb_list", 10)))
def sparse_replay(spark, folder):
    w = World(spark, folder, prepared=True)
    size = dense_panel(w).agg(F.countDistinct("item_id")).scalar()
    return E.sparse_replay(cut_lineage(embedding_lists(w)), cut_lineage(sampled_panel(w, "uniform")), size, 10)


# Rank consistency: three models (channels) under full and sampled exposure of the panel.
MODELS = {"itemcf": "cf_list", "content": "cat_list", "tower": "emb_list"}


def _summary_row(model: str, source: str, truth: str, kind: str, policy: str, density: str) -> str:
    return f"""
SELECT '{model}' AS experiment_id, '{kind}' AS evaluation, {policy} AS policy, {density} AS density,
  avg(r) AS recall_at_10, avg(n) AS ndcg_at_10 FROM (
  SELECT count(*) FILTER (rank <= 10) / count(*) AS r,
    coalesce(sum({GAIN}) FILTER (rank <= 10), 0) / {ideal_sql('count(*)', 10)} AS n
  FROM {truth} t LEFT JOIN {source} l ON l.user_id = t.user_id AND l.item_id = t.item_id
  WHERE t.label_complete = 1 GROUP BY t.user_id)"""


fragment(
    "summary",
    ["panel", *MODELS.values(), *[f"sample_{p}" for p in POLICIES]],
    " UNION ALL ".join(
        [_summary_row(m, s, "panel", "full_exposure", "NULL", "NULL") for m, s in MODELS.items()]
        + [
            _summary_row(m, s, f"sample_{p}", "sparse_replay", f"'{p}'", str(d))
            for p, (_, d) in POLICIES.items()
            for m, s in MODELS.items()
        ]
    ),
)


def exposure_summary(w: World):
    lists = channel_lists(w)
    feedback = cut_lineage(dense_panel(w))
    samples = {p: cut_lineage(sampled_panel(w, p)) for p in POLICIES}
    rows = None
    for model, ranked in lists.items():
        for policy in [None, *POLICIES]:
            truth = E.panel_truth(feedback if policy is None else samples[policy])
            row = (
                E.recall_by_group(ranked, truth, 10, ["user_id"])
                .agg(F.avg("recall_at_10").alias("recall_at_10"), F.avg("ndcg_at_10").alias("ndcg_at_10"))
                .select(
                    F.lit(model).alias("experiment_id"),
                    F.lit("full_exposure" if policy is None else "sparse_replay").alias("evaluation"),
                    F.lit(policy).cast("string").alias("policy"),
                    F.lit(None if policy is None else POLICIES[policy][1]).cast("double").alias("density"),
                    "recall_at_10",
                    "ndcg_at_10",
                )
            )
            rows = row if rows is None else rows.unionByName(row)
    return rows


@register(
    "rank_consistency",
    query(
        ["summary"],
        f"""
SELECT policy, density, count(*) AS models, {rx('corr(ra, rb)', 'spearman_recall')}, {rx('corr(na, nb)', 'spearman_ndcg')},
  arg_max(experiment_id, fr) AS full_best_recall, arg_max(experiment_id, sr) AS sparse_best_recall,
  arg_max(experiment_id, fn) AS full_best_ndcg, arg_max(experiment_id, sn) AS sparse_best_ndcg
FROM (
  SELECT *, rank() OVER (PARTITION BY policy ORDER BY fr) AS ra, rank() OVER (PARTITION BY policy ORDER BY sr) AS rb,
    rank() OVER (PARTITION BY policy ORDER BY fn) AS na, rank() OVER (PARTITION BY policy ORDER BY sn) AS nb
  FROM (
    SELECT s.experiment_id, s.policy, s.density, f.recall_at_10 AS fr, s.recall_at_10 AS sr, f.ndcg_at_10 AS fn, s.ndcg_at_10 AS sn
    FROM summary s JOIN summary f ON f.experiment_id = s.experiment_id AND f.evaluation = 'full_exposure'
    WHERE s.evaluation = 'sparse_replay'
  )
) GROUP BY ALL""",
    ),
)
def rank_consistency(spark, folder):
    return E.rank_consistency(cut_lineage(exposure_summary(World(spark, folder, prepared=True))), 10)


# --- scored rows --------------------------------------------------------------------------------

fragment("scored", ["log"], "SELECT l.*, least(floor((watch_ratio / 12 + (l.event_id % 10) / 20) * 100 + 1e-6) / 100, 1) AS score FROM log l")


def scored_log(w: World):
    """Every log row with a coarse score, so that ties occur."""
    noise = (F.col("event_id") % 10) / 20
    coarse = F.floor((F.col("watch_ratio") / 12 + noise) * 100 + 1e-6) / 100
    return w.log.withColumn("score", F.least(coarse, F.lit(1.0)))


def auc_sql(source: str, score: str, label: str, where: str = "true") -> str:
    return f"""
SELECT CASE WHEN p * n > 0 THEN (s - p * (p + 1) / 2.0::DOUBLE) / (p * n) END FROM (
  SELECT sum({label}) AS p, sum(1 - {label}) AS n, sum(rk * {label}) AS s FROM (
    SELECT {label}, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS rk
    FROM {source} WHERE {where}))"""


GAUC = """
SELECT sum(a * m) / sum(m) AS gauc, count(*) AS gauc_users FROM (
  SELECT user_id, count(*) AS m, (sum(rk * label_complete) - sum(label_complete) * (sum(label_complete) + 1) / 2.0::DOUBLE)
    / (sum(label_complete) * sum(1 - label_complete)) AS a
  FROM (
    SELECT *, rank() OVER (PARTITION BY user_id ORDER BY score) + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0::DOUBLE AS rk FROM scored
  ) GROUP BY 1 HAVING sum(label_complete) > 0 AND sum(1 - label_complete) > 0
)"""
LOSS = """
SELECT avg(-ln(CASE WHEN label_complete = 1 THEN p ELSE 1 - p END)) FROM (
  SELECT label_complete, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM scored)"""
fragment(
    "logged",
    ["scored"],
    f"""
SELECT user_id, date, sum(label_complete) AS positives,
  coalesce(sum(label_complete / log2(r + 1)) FILTER (r <= 10), 0) / {ideal_sql('sum(label_complete)', 10)} AS ndcg
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY score DESC, event_id) AS r FROM scored) GROUP BY ALL""",
)


@register(
    "ranking_metrics",
    query(
        ["scored", "logged"],
        f"""
SELECT {rx('(' + auc_sql('scored', 'score', 'label_complete') + ')', 'auc')}, {rx('(' + LOSS + ')', 'log_loss')},
  {rx('(SELECT gauc FROM (' + GAUC + '))', 'gauc')}, {rx('(SELECT avg(ndcg) FROM logged WHERE positives > 0)', 'ndcg_at_10')},
  {rx('avg(label_complete)', 'complete_rate_at_10')}, {rx('avg(label_strong)', 'strong_rate_at_10')},
  {rx('avg(label_short)', 'short_rate_at_10')},
  {rx('avg(label_complete + 0.5::DOUBLE * label_strong - 0.5::DOUBLE * label_short)', 'utility_at_10')}
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY score DESC, event_id) AS r FROM scored) WHERE r <= 10""",
    ),
)
def ranking_metrics(spark, folder):
    return SC.ranking_metrics(scored_log(World(spark, folder)), tie=["event_id"])


@register("gauc", query(["scored"], f"SELECT gauc_users, {r6('gauc')} FROM ({GAUC})"))
def gauc(spark, folder):
    return SC.gauc(scored_log(World(spark, folder)))


@register(
    "logged_ndcg",
    query(["logged"], f"SELECT user_id, date, positives::BIGINT AS positives, {rx('CASE WHEN positives > 0 THEN ndcg ELSE 0 END', 'ndcg_at_10')} FROM logged"),
)
def logged_ndcg(spark, folder):
    return SC.ranking_by_group(scored_log(World(spark, folder)), tie=["event_id"])


@register(
    "label_auc",
    f"""
WITH d AS MATERIALIZED (SELECT n_chars AS s, quality, toxic FROM documents JOIN labels USING (doc_id))
SELECT {rx('(' + auc_sql('d', 's', 'quality') + ')', 'auc_quality')}, {rx('(' + auc_sql('d', 's', 'toxic') + ')', 'auc_toxic')}""",
)
def label_auc(spark, folder):
    docs = D.table(spark, folder, "documents").join(D.table(spark, folder, "labels"), "doc_id")
    docs = docs.select("n_chars", "quality", "toxic")
    first = SC.auc(docs, "n_chars", "quality").select(F.col("auc").alias("auc_quality"))
    return first.withColumn("auc_toxic", SC.auc(docs, "n_chars", "toxic").select("auc").scalar())


@register(
    "per_task_auc",
    query(
        ["scored"],
        f"""
SELECT {rx('(' + auc_sql('scored', 'score', 'label_complete') + ')', 'auc_complete')},
  {rx('(' + auc_sql('scored', 'watch_ratio', 'label_strong') + ')', 'auc_strong')},
  {rx('(' + auc_sql('scored', 'play_duration', 'label_short') + ')', 'auc_short')}, {rx('(' + LOSS + ')', 'log_loss_complete')}""",
    ),
)
def per_task_auc(spark, folder):
    return SC.per_task_metrics(
        scored_log(World(spark, folder)),
        {"label_complete": "score", "label_strong": "watch_ratio", "label_short": "play_duration"},
    )


# --- candidate frame: fusion, reranking, cutoffs ------------------------------------------------

KEYS = "user_id, date"
fragment(
    "rrf_rows",
    ["cand"],
    f"""
SELECT *, 0.6::DOUBLE / (60 + ra) + 0.4::DOUBLE / (60 + rb) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY round(itemcf_rank_score::FLOAT::DOUBLE, 9) DESC, item_id) AS ra,
    row_number() OVER (PARTITION BY {KEYS} ORDER BY round(tower_rank_score::FLOAT::DOUBLE, 9) DESC, item_id) AS rb
  FROM cand
)""",
)
WEIGHTS = {"itemcf_rank_score": 0.6, "tower_rank_score": 0.4}


def fused_frame(w: World):
    frame, truth = candidate_frame(w)
    return RR.rrf(frame, WEIGHTS, 60, out="score"), truth


@register("rrf_fusion", query(["rrf_rows"], f"SELECT user_id, date, item_id, {rx('score', 'rrf_score')} FROM rrf_rows"))
def rrf_fusion(spark, folder):
    rows, _ = fused_frame(World(spark, folder, prepared=True))
    return rows.select("user_id", "date", "item_id", F.col("score").alias("rrf_score"))


@register(
    "rank_sweep",
    query(
        ["rrf_rows"],
        f"""
SELECT grid_id, user_id, date, item_id, {rx('wa / (k + ra) + wb / (k + rb)', 'score')} FROM rrf_rows,
  (VALUES (1, 0.5::DOUBLE, 0.5::DOUBLE, 60), (2, 0.7::DOUBLE, 0.3::DOUBLE, 60), (3, 0.6::DOUBLE, 0.4::DOUBLE, 20)) g(grid_id, wa, wb, k)""",
    ),
)
def rank_sweep(spark, folder):
    frame, _ = candidate_frame(World(spark, folder, prepared=True))
    grid = spark.createDataFrame(
        [(1, 0.5, 0.5, 60.0), (2, 0.7, 0.3, 60.0), (3, 0.6, 0.4, 20.0)],
        "grid_id int, w_first double, w_second double, rrf_k double",
    )
    out = RR.sweep(frame, "itemcf_rank_score", "tower_rank_score", grid)
    return out.select("grid_id", "user_id", "date", "item_id", "score")


def mmr_sql(source: str, lam: float) -> str:
    """Greedy selection as a recursive query over each group's sorted candidate list."""
    return f"""
rel AS MATERIALIZED (
  SELECT user_id, date, list({{'i': item_id, 'c': first_category, 'a': author_id_hash, 'r':
    CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END}} ORDER BY round(score, 12) DESC, item_id) AS rest
  FROM (SELECT *, min(score) OVER (PARTITION BY {KEYS}) AS lo, max(score) OVER (PARTITION BY {KEYS}) AS hi FROM {source})
  GROUP BY ALL
),
walk AS (
  SELECT user_id, date, 1 AS step, rest[1].i AS item_id, rest[2:] AS rest, [rest[1].c] AS cs, [rest[1].a] AS aus,
    [{{'c': rest[1].c, 'a': rest[1].a}}] AS cells FROM rel
  UNION ALL
  SELECT user_id, date, step + 1, best.i, list_filter(rest, lambda x: x.i <> best.i), list_append(cs, best.c),
    list_append(aus, best.a), list_append(cells, {{'c': best.c, 'a': best.a}})
  FROM (
    SELECT *, list_sort(list_transform(rest, lambda x: {{'v': -round({lam}::DOUBLE * x.r - (1 - {lam}::DOUBLE) * (CASE
      WHEN list_contains(cells, {{'c': x.c, 'a': x.a}}) THEN 1.0::DOUBLE WHEN list_contains(cs, x.c) THEN 0.6::DOUBLE
      WHEN list_contains(aus, x.a) THEN 0.4::DOUBLE ELSE 0 END), 12), 'i': x.i, 'c': x.c, 'a': x.a}}))[1] AS best
    FROM walk WHERE len(rest) > 0
  )
)
SELECT user_id, date, item_id, CAST(step AS INTEGER) AS mmr_rank FROM walk"""


def recursive(needs: list[str], tail: str) -> str:
    return query(needs, "").replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + tail.strip()


@register("mmr_rerank", recursive(["rrf_rows"], mmr_sql("rrf_rows", 0.9)))
def mmr_rerank(spark, folder):
    rows, _ = fused_frame(World(spark, folder, prepared=True))
    out = RR.mmr_rerank(rows, "score", "mmr", 0.9)
    return out.select("user_id", "date", "item_id", "mmr_rank")


fragment(
    "panel_cells",
    ["panel", "items"],
    """
SELECT p.user_id, 20240131 AS date, p.item_id, i.first_category, i.author_id AS author_id_hash,
  round(p.watch_ratio_clipped / 5, 6) AS score FROM panel p JOIN items i ON i.item_id = p.item_id""",
)


@register("mmr_rerank_panel", recursive(["panel_cells"], mmr_sql("panel_cells", 0.7)))
def mmr_rerank_panel(spark, folder):
    """Whole panel lists, about fifty rows per user, with a stronger diversity share."""
    w = World(spark, folder)
    items = w.items.select("item_id", "first_category", F.col("author_id").alias("author_id_hash"))
    rows = dense_panel(w).join(items, "item_id").withColumn("score", F.round(F.col("watch_ratio_clipped") / 5, 6))
    out = RR.mmr_rerank(rows, "score", "mmr", 0.7)
    return out.select("user_id", "date", "item_id", "mmr_rank")


CUTS = [3, 10]
fragment(
    "ranked_cand",
    ["rrf_rows"],
    f"SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY round(score, 9) DESC, item_id) AS rank FROM rrf_rows",
)
group_fragment("cand_groups", "ranked_cand", "truth", CUTS)


def _cut_sql(k: int) -> str:
    top = f"FROM ranked_cand WHERE rank <= {k}"
    value = "label_complete + 0.5::DOUBLE * label_strong - 0.5::DOUBLE * label_short"
    return ", ".join(
        [
            *[rx(f"avg({m}_at_{k})", f"{m}_at_{k}") for m in ("recall", "ndcg", "hit_rate")],
            rx(f"(SELECT count(DISTINCT item_id) {top}) / (SELECT n FROM size)", f"coverage_at_{k}"),
            rx(f"(SELECT sum(label_complete) {top}) / (count(*) * {k})", f"precision_at_{k}"),
            *[rx(f"(SELECT avg(label_{m}) {top})", f"{m}_rate_at_{k}") for m in ("complete", "strong", "short")],
            rx(f"(SELECT avg({value}) {top})", f"utility_at_{k}"),
            rx("0", f"cold_recall_at_{k}"),
        ]
    )


@register(
    "multi_k_eval",
    query(
        ["cand_groups", "ranked_cand", "items", "log"],
        f"""SELECT {', '.join(_cut_sql(k) for k in CUTS)}, count(DISTINCT user_id) AS evaluated_users, count(*) AS evaluated_groups,
        0 AS cold_evaluated_users, 0 AS cold_evaluated_groups FROM cand_groups""",
        extra={"size": "SELECT count(*) AS n FROM items WHERE first_seen_date <= (SELECT max(date) FROM log WHERE split = 'test')"},
    ),
)
def multi_k_eval(spark, folder):
    w = World(spark, folder, prepared=True)
    rows, truth = fused_frame(w)
    size = catalog_size(w.items, w.log, "test").scalar()
    known = w.train.select("item_id").distinct()
    return E.ranked_metrics_at(cut_lineage(rows), truth, known, size, CUTS)[0]


@register(
    "channel_rates",
    query(
        ["ranked_cand"],
        "SELECT "
        + ", ".join(
            rx(f"avg(tower_present) FILTER (rank <= {k})", f"tower_selected_rate_at_{k}")
            + ", "
            + rx(
                f"avg((tower_present = 1 AND itemcf_present = 0 AND content_present = 0)::INT) FILTER (rank <= {k})",
                f"tower_unique_selected_rate_at_{k}",
            )
            for k in CUTS
        )
        + " FROM ranked_cand",
    ),
)
def channel_rates(spark, folder):
    rows, _ = fused_frame(World(spark, folder, prepared=True))
    return E.channel_rates(rows, CUTS)


for _name, _source in MODELS.items():
    daily_fragment(f"{_name}_daily", _source, "", 10)


@register(
    "channel_overlap",
    query(
        ["itemcf_daily", "content_daily", "tower_daily", "truth"],
        f"""
SELECT count(*) AS evaluated_groups, {rx('avg(both_n / greatest(either_n, 1))', 'mean_jaccard')},
  {rx('avg(only_n / greatest(cand_n, 1))', 'mean_unique_item_rate')}, {rx('avg(bh / pos)', 'base_oracle_recall_at_10')},
  {rx('avg(uh / pos)', 'union_oracle_recall_at_10')}, {rx('avg(uh / pos) - avg(bh / pos)', 'incremental_oracle_recall_at_10')},
  count(*) FILTER (uh > bh) AS groups_with_new_hit
FROM (
  SELECT user_id, date, count(*) FILTER (b AND c) AS both_n, count(*) FILTER (b OR c) AS either_n,
    count(*) FILTER (c AND NOT b) AS only_n, count(*) FILTER (c) AS cand_n, count(*) FILTER (t) AS pos,
    count(*) FILTER (b AND t) AS bh, count(*) FILTER ((b OR c) AND t) AS uh
  FROM (
    SELECT user_id, date, item_id, bool_or(k = 'b') AS b, bool_or(k = 'c') AS c, bool_or(k = 't') AS t FROM (
      SELECT user_id, date, item_id, 'b' AS k FROM itemcf_daily UNION ALL SELECT user_id, date, item_id, 'b' FROM content_daily
      UNION ALL SELECT user_id, date, item_id, 'c' FROM tower_daily UNION ALL SELECT user_id, date, item_id, 't' FROM truth
    ) GROUP BY ALL
  ) GROUP BY ALL
)""",
    ),
)
def channel_overlap(spark, folder):
    w = World(spark, folder, prepared=True)
    lists = channel_lists(w)
    return E.channel_overlap([lists["itemcf"], lists["content"]], lists["tower"], w.truth, w.items, 10)


@register(
    "oov_metrics",
    query(
        ["ranked_cand", "cand", "truth"],
        f"""
SELECT {rx('coalesce(avg(r), 0)', 'oov_recall_at_10')}, count(DISTINCT user_id) AS oov_evaluated_users, count(*) AS oov_evaluated_groups,
  {rx('(SELECT avg((item_id NOT IN (SELECT item_id FROM cand WHERE date < 20240127))::INT) FROM cand WHERE date >= 20240127)', 'oov_row_rate')}
FROM (
  SELECT t.user_id, t.date, count(*) FILTER (c.rank <= 10) / count(*) AS r FROM truth t
  LEFT JOIN ranked_cand c USING (user_id, date, item_id)
  WHERE t.date >= 20240127 AND t.item_id NOT IN (SELECT item_id FROM cand WHERE date < 20240127) GROUP BY ALL
)""",
    ),
)
def oov_metrics(spark, folder):
    rows, truth = fused_frame(World(spark, folder, prepared=True))
    rows = cut_lineage(rows)
    early, late = rows.filter("date < 20240127"), rows.filter("date >= 20240127")
    ranked = E.rank_within(late, "score", 10)
    return E.oov_metrics(ranked, truth.filter("date >= 20240127"), late, early.select("item_id"), 10)


# --- comparisons --------------------------------------------------------------------------------

group_fragment("cf_groups", "itemcf_daily", "truth", [10])
PAIRED = {
    "paired": """
SELECT user_id, b.m - a.m AS diff FROM (SELECT user_id, avg(recall_at_10) AS m FROM pop_groups GROUP BY 1) a
JOIN (SELECT user_id, avg(recall_at_10) AS m FROM cf_groups GROUP BY 1) b USING (user_id)""",
    "paired_pos": "SELECT diff, row_number() OVER (ORDER BY user_id) - 1 AS slot FROM paired",
    "boot": f"""
SELECT b, avg(p.diff) AS m FROM (
  SELECT b, {hash32(2026, 'b', 'slot')} % (SELECT count(*) FROM paired) AS pos FROM paired_pos, (SELECT unnest(generate_series(0, 199)) AS b)
) d JOIN paired_pos p ON p.slot = d.pos GROUP BY 1""",
}


def compared(w: World):
    lists = itemcf(w, K)
    daily = E.available_on_date(lists.select("user_id", "item_id", "rank"), w.truth, w.items, 10)
    return cut_lineage(E.recall_by_group(popular_daily(w), w.truth, 10)), cut_lineage(E.recall_by_group(daily, w.truth, 10))


@register(
    "paired_bootstrap",
    query(
        ["pop_groups", "cf_groups"],
        f"""
SELECT count(*) AS paired_users, {rx('avg(diff)', 'mean_difference')},
  {rx('(SELECT quantile_cont(m, 0.025) FROM boot)', 'ci_95_low')}, {rx('(SELECT quantile_cont(m, 0.975) FROM boot)', 'ci_95_high')}
FROM paired""",
        extra=PAIRED,
    ),
)
def paired_bootstrap(spark, folder):
    """Item CF against popularity on Recall@10, 200 resamples."""
    a, b = compared(World(spark, folder, prepared=True))
    return E.paired_bootstrap(a, b, "recall_at_10", 200, poisson=False)


def poisson_boot_sql(diffs: str, samples: int = 200) -> str:
    """Resampled means with Poisson(1) weights read off the same hash as the engine's."""
    cases = " ".join(f"WHEN h < {edge} THEN {count}" for count, edge in E.POISSON_STEPS)
    return f"""
SELECT b, sum(w * diff) / nullif(sum(w), 0) AS m FROM (
  SELECT b, diff, CASE {cases} ELSE {len(E.POISSON_STEPS)} END AS w FROM (
    SELECT b, diff, {hash32(2026, 'b', 'user_id')} AS h FROM {diffs}, (SELECT unnest(generate_series(0, {samples - 1})) AS b)
  )
) GROUP BY 1"""


@register(
    "paired_bootstrap_poisson",
    query(
        ["pop_groups", "cf_groups"],
        f"""
SELECT count(*) AS paired_users, {rx('avg(diff)', 'mean_difference')},
  {rx('(SELECT quantile_cont(m, 0.025) FROM boot)', 'ci_95_low')}, {rx('(SELECT quantile_cont(m, 0.975) FROM boot)', 'ci_95_high')}
FROM paired""",
        extra={"paired": PAIRED["paired"], "boot": poisson_boot_sql("paired")},
    ),
)
def paired_bootstrap_poisson(spark, folder):
    a, b = compared(World(spark, folder, prepared=True))
    return E.paired_bootstrap(a, b, "recall_at_10", 200, poisson=True)


daily_fragment("emb_daily", "emb_list", "", 10)
group_fragment("emb_groups", "emb_daily", "truth", [10])
CHALLENGERS = {"itemcf": "cf_groups", "embedding": "emb_groups"}
for _name, _groups in CHALLENGERS.items():
    for _metric in ("recall", "ndcg"):
        fragment(
            f"{_name}_{_metric}_diff",
            ["pop_groups", _groups],
            f"""
SELECT user_id, b.m - a.m AS diff FROM (SELECT user_id, avg({_metric}_at_10) AS m FROM pop_groups GROUP BY 1) a
JOIN (SELECT user_id, avg({_metric}_at_10) AS m FROM {_groups} GROUP BY 1) b USING (user_id)""",
        )
        fragment(f"{_name}_{_metric}_boot", [f"{_name}_{_metric}_diff"], poisson_boot_sql(f"{_name}_{_metric}_diff"))


@register(
    "challenger_gate",
    query(
        [*CHALLENGERS.values(), *[f"{name}_{metric}_boot" for name in CHALLENGERS for metric in ("recall", "ndcg")]],
        f"""
SELECT experiment_id, {rx('recall', 'recall')}, eligible,
  coalesce((SELECT arg_max(experiment_id, recall) FROM c WHERE eligible), 'popular') AS winner FROM c""",
        extra={
            "c": " UNION ALL ".join(
                f"""
SELECT '{name}' AS experiment_id, (SELECT avg(recall_at_10) FROM {groups}) AS recall,
  (SELECT quantile_cont(m, 0.025) FROM {name}_recall_boot) > 0 AND (SELECT quantile_cont(m, 0.975) FROM {name}_ndcg_boot) >= 0 AS eligible"""
                for name, groups in CHALLENGERS.items()
            )
        },
    ),
)
def challenger_gate(spark, folder):
    """Item CF and embeddings against popularity, on the intervals of their paired bootstraps."""
    w = World(spark, folder, prepared=True)
    base = cut_lineage(E.recall_by_group(popular_daily(w), w.truth, 10))
    rows = None
    for name, lists in (("itemcf", itemcf(w, K)), ("embedding", embedding_lists(w))):
        daily = E.available_on_date(lists.select("user_id", "item_id", "rank"), w.truth, w.items, 10)
        groups = cut_lineage(E.recall_by_group(daily, w.truth, 10))
        low = E.paired_bootstrap(base, groups, "recall_at_10", 200).select("ci_95_low").scalar()
        high = E.paired_bootstrap(base, groups, "ndcg_at_10", 200).select("ci_95_high").scalar()
        row = groups.agg(F.avg("recall_at_10").alias("recall")).select(
            F.lit(name).alias("experiment_id"), "recall", low.alias("recall_ci_low"), high.alias("ndcg_ci_high")
        )
        rows = row if rows is None else rows.unionByName(row)
    return E.challenger_gate(cut_lineage(rows), "popular").select("experiment_id", "recall", "eligible", "winner")


for _name in MODELS:
    group_fragment(f"{_name}_gate_groups", f"{_name}_daily", "truth", [10])
    fragment(
        f"{_name}_gate",
        [f"{_name}_gate_groups", f"{_name}_daily", "itemcf_daily", "truth", "items", "log"],
        f"""
SELECT (SELECT avg(recall_at_10) FROM {_name}_gate_groups) AS recall,
  (SELECT count(DISTINCT item_id) FROM {_name}_daily) / (SELECT count(*) FROM items
    WHERE first_seen_date <= (SELECT max(date) FROM log WHERE split = 'test')) AS coverage,
  (SELECT avg(uh / pos) - avg(bh / pos) FROM (
    SELECT user_id, date, count(*) AS pos, count(b.item_id) AS bh, count(coalesce(b.item_id, c.item_id)) AS uh
    FROM truth LEFT JOIN itemcf_daily b USING (user_id, date, item_id) LEFT JOIN {_name}_daily c USING (user_id, date, item_id)
    GROUP BY ALL)) AS gain""",
    )


@register(
    "quota_gate",
    query(
        [f"{name}_gate" for name in MODELS],
        " UNION ALL ".join(
            f"""
SELECT '{name}' AS experiment_id, c.recall >= 0.98::DOUBLE * b.recall AND c.coverage >= 1.05::DOUBLE * b.coverage AND c.gain > 0 AS passed
FROM {name}_gate c, itemcf_gate b"""
            for name in MODELS
            if name != "itemcf"
        ),
    ),
)
def quota_gate(spark, folder):
    """The other channels against item CF: recall, catalog coverage and what they add to its oracle recall."""
    w = World(spark, folder, prepared=True)
    lists = channel_lists(w)
    size = catalog_size(w.items, w.log, "test").scalar()
    facts = {}
    for name in MODELS:
        daily = cut_lineage(E.available_on_date(lists[name], w.truth, w.items, 10))
        facts[name] = cut_lineage(E.recall_metrics(daily, w.truth, None, size, [10]).select("recall_at_10", "coverage_at_10"))
    rows = None
    for name in MODELS:
        if name == "itemcf":
            continue
        gain = E.channel_overlap([lists["itemcf"]], lists[name], w.truth, w.items, 10).select("incremental_oracle_recall_at_10").scalar()
        row = facts[name].select(
            F.lit(name).alias("experiment_id"),
            F.col("recall_at_10").alias("recall"),
            F.col("coverage_at_10").alias("coverage"),
            gain.alias("oracle_gain"),
            facts["itemcf"].select("recall_at_10").scalar().alias("base_recall"),
            facts["itemcf"].select("coverage_at_10").scalar().alias("base_coverage"),
        )
        rows = row if rows is None else rows.unionByName(row)
    return E.quota_gate(rows).select("experiment_id", "passed")
