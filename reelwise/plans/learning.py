"""Queries of the learned rankers, all on the candidate frame or the log."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwise import schema as S
from reelwise.operators import candidates as C
from reelwise.operators import rankers as R
from reelwise.operators import scoring_metrics as SC
from reelwise.operators.lambda_rank import fit_lambda_rank
from reelwise.operators.rerank import blend_scores
from reelwise.operators.stats import pointwise_frame, strict_past_stats
from reelwise.plans.candidating import TOP, WEIGHTS, candidate_frame, channel_lists
from reelwise.plans.evaluating import auc_sql
from reelwise.plans.preparing import past_sql
from reelwise.plans.registry import register
from reelwise.plans.sql import fragment, query, rx
from reelwise.plans.world import World, stored

TRAIN_DAYS, FEATURE_END = 20240120, 20240105


def pointwise(w: World):
    """Log rows with strictly earlier statistics and item attributes: (train, test, columns)."""

    def build():
        frame = pointwise_frame(strict_past_stats(w.log), w.items)
        # No history stays NULL here: the linear ranker imputes medians, trees set the gap apart.
        return frame.withColumns({"hour": F.hour("timestamp"), "weekday": F.weekday("timestamp")})

    frame = stored(w, "pointwise_rows", build)
    columns = S.pointwise_columns(["F0", "F1", "F2", "F3", "F5"])
    train = frame.filter((F.col("date") <= TRAIN_DAYS) & (F.col("date") > FEATURE_END))
    return train, frame.filter("split = 'test'"), columns


def _scored(spark, folder, fit):
    train, test, columns = pointwise(World(spark, folder))
    out = R.predict(fit(train, columns), test, columns)
    return out.select("event_id", "user_id", "date", "item_id", "label_complete", "score")


NEWTON_STEPS = 9


def newton_sql(name: str, columns: list[str], label: str, ridge: float = 1.0, steps: int = NEWTON_STEPS) -> None:
    """Fragments of a logistic fit on `pointwise_sql`: `name`_theta with the weights (the last one is the intercept)."""
    n = len(columns) + 1
    stats = ", ".join(
        f"avg(coalesce({c}, m{i})) AS a{i}, stddev_pop(coalesce({c}, m{i})) AS s{i}, any_value(m{i}) AS m{i}" for i, c in enumerate(columns)
    )
    middle = ", ".join(f"coalesce(median({c}::DOUBLE), 0) AS m{i}" for i, c in enumerate(columns))
    train = f"(SELECT * FROM pointwise_sql WHERE date <= {TRAIN_DAYS} AND date > {FEATURE_END} AND {label} IS NOT NULL)"
    fragment(f"{name}_mid", ["pointwise_sql"], f"SELECT {middle} FROM {train}")
    fragment(f"{name}_st", [f"{name}_mid"], f"SELECT {stats}, count(*) AS n, sum({label}) AS p FROM {train}, {name}_mid")
    x = ", ".join(f"CASE WHEN s{i} > 0 THEN (coalesce({c}, m{i}) - a{i}) / s{i} ELSE 0 END" for i, c in enumerate(columns))
    standard = f"SELECT event_id, {label}::DOUBLE AS y, [{x}, 1.0]::DOUBLE[] AS x, n, p FROM {{rows}}, {name}_st"
    fragment(f"{name}_x", [f"{name}_st"], standard.format(rows=train))
    fragment(f"{name}_test", [f"{name}_st"], standard.format(rows="(SELECT * FROM pointwise_sql WHERE split = 'test')"))
    fragment(f"{name}_t0", [f"{name}_x"], f"SELECT {[0.0] * n}::DOUBLE[] AS t")
    for step in range(steps):
        # Rows of the system: the Hessian with the ridge, then the gradient; eliminated one pivot at a time.
        fragment(
            f"{name}_m{step}",
            [f"{name}_x", f"{name}_t{step}"],
            f"""
SELECT list(line ORDER BY i) AS m, any_value(t) AS t FROM (
  SELECT i, any_value(t) AS t, list_append(list(v ORDER BY j), any_value(g) + CASE WHEN i < {n} THEN {ridge}::DOUBLE * any_value(t)[i] ELSE 0 END) AS line FROM (
    SELECT i, j, any_value(t) AS t, sum(c * q * (1 - q) * x[i] * x[j]) + CASE WHEN i = j AND i < {n} THEN {ridge}::DOUBLE ELSE 0 END AS v, sum(c * (q - y) * x[i]) AS g FROM (
      SELECT x, y, t, 1 / (1 + exp(-list_dot_product(x, t))) AS q, CASE WHEN y = 1 THEN n / (2 * p) ELSE n / (2 * (n - p)) END AS c FROM {name}_x, {name}_t{step}
    ), (SELECT unnest(generate_series(1, {n})) AS i) a, (SELECT unnest(generate_series(1, {n})) AS j) b GROUP BY i, j
  ) GROUP BY i
)""",
        )
        fragment(
            f"{name}_e{step}",
            [f"{name}_m{step}"],
            f"""
SELECT 0 AS k, m, t FROM {name}_m{step}
UNION ALL
SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / m[k + 1][k + 1])
  ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END), t
FROM {name}_e{step} WHERE k < {n}""",
        )
        fragment(
            f"{name}_t{step + 1}", [f"{name}_e{step}"], f"SELECT list_transform(t, lambda v, i: v - m[i][{n + 1}]) AS t FROM {name}_e{step} WHERE k = {n}"
        )
    fragment(
        f"{name}_score",
        [f"{name}_test", f"{name}_t{steps}"],
        f"SELECT event_id, 1 / (1 + exp(-list_dot_product(x, t))) AS score FROM {name}_test, {name}_t{steps}",
    )


for _name, _sql in past_sql("true").items():
    fragment(_name, ["log"], _sql)
fragment(
    "pointwise_sql",
    ["log", "items", "user_past", "item_past"],
    """
SELECT l.event_id, l.user_id, l.item_id, l.date, l.split, l.label_complete, l.label_strong, l.label_short, l.video_duration,
  hour(l.timestamp) AS hour, isodow(l.timestamp) - 1 AS weekday, i.author_id, i.first_category,
  u.* EXCLUDE (user_id, date), p.* EXCLUDE (item_id, date)
FROM log l LEFT JOIN items i ON i.item_id = l.item_id
LEFT JOIN user_past u ON u.user_id = l.user_id AND u.date = l.date LEFT JOIN item_past p ON p.item_id = l.item_id AND p.date = l.date""",
)
POINTWISE = S.pointwise_columns(["F0", "F1", "F2", "F3", "F5"])
for _label in S.LABELS:
    newton_sql(f"lr_{_label}", POINTWISE, _label)


def recursive_query(needs: list[str], select: str) -> str:
    return query(needs, select).replace("WITH ", "WITH RECURSIVE ", 1)


@register(
    "logistic_scores",
    recursive_query(
        ["lr_label_complete_score"],
        f"SELECT event_id, user_id, date, item_id, label_complete, {rx('score', 'score')} FROM lr_label_complete_score JOIN pointwise_sql USING (event_id)",
    ),
)
def logistic_scores(spark, folder):
    return _scored(spark, folder, R.fit_logistic)


@register("gbt_scores")
def gbt_scores(spark, folder):
    return _scored(spark, folder, lambda train, columns: R.fit_boosted(train, columns, trees=10))


@register("fm_scores")
def fm_scores(spark, folder):
    train, test, columns = pointwise(World(spark, folder, prepared=True))
    # Factorisation has no notion of a gap.
    model = R.fit_factorization(train.na.fill(0.0, columns), columns)
    out = R.predict(model, test.na.fill(0.0, columns), columns)
    return out.select("event_id", "user_id", "date", "item_id", "label_complete", "score")


@register("feature_importance")
def feature_importance(spark, folder):
    train, _, columns = pointwise(World(spark, folder))
    return R.importance_table(train, R.fit_boosted(train, columns, trees=5), columns)


@register(
    "label_blend",
    recursive_query(
        [f"lr_{label}_score" for label in S.LABELS],
        f"""
SELECT event_id, {rx('a.score', 'blend_complete')}, {rx('0.7 * a.score + 0.3 * b.score', 'blend_strong')},
  {rx('0.6 * a.score + 0.3 * b.score + 0.1 * (1 - c.score)', 'blend_short')}
FROM lr_label_complete_score a JOIN lr_label_strong_score b USING (event_id) JOIN lr_label_short_score c USING (event_id)""",
    ),
)
def label_blend(spark, folder):
    """One head per label, blended into the three serving scores."""
    train, test, columns = pointwise(World(spark, folder))
    heads = R.label_heads(train, columns, S.LABELS)
    for label, model in heads.items():
        test = R.predict(model, test, columns, f"p_{label}")
    blends = blend_scores(*[f"p_{label}" for label in S.LABELS])
    return test.select("event_id", *[expr.alias(name) for name, expr in blends.items()])


def candidate_frames(w: World):
    """Candidates of the validation days to learn from and of the test days to score, and the features."""
    channels = channel_lists(w)
    valid = stored(w, "candidates_valid", lambda: C.build_candidates(w.log, w.items, "valid", channels, TOP, WEIGHTS)[0])
    return valid, candidate_frame(w)[0], S.FEATURES


@register("pairwise_ranker")
def pairwise_ranker(spark, folder):
    """Linear pairwise ranker over the candidates of each user and day."""
    valid, test, columns = candidate_frames(World(spark, folder, prepared=True))
    coefficients = R.fit_pairwise(valid, columns, n_neg=2)
    return R.score_linear(test, coefficients).select("user_id", "date", "item_id", "score")


LAMBDA_COLUMNS = ["itemcf_rank_score", "content_rank_score", "channel_count", "item_complete_rate", "category_affinity", "item_age_days"]
LAMBDA_STEPS, LAMBDA_K, LAMBDA_RATE = 3, 10, 5.0


def lambda_sql() -> None:
    """Fragments of the first LambdaRank steps on the candidates: `lam_w<step>` with the standardised weights as a list."""
    n = len(LAMBDA_COLUMNS)
    facts = ", ".join(f"avg({c}::FLOAT::DOUBLE) AS a{i}, stddev_pop({c}::FLOAT::DOUBLE) AS s{i}" for i, c in enumerate(LAMBDA_COLUMNS))
    x = ", ".join(f"CASE WHEN s{i} > 0 THEN ({c}::FLOAT::DOUBLE - a{i}) / s{i} ELSE 0 END" for i, c in enumerate(LAMBDA_COLUMNS))
    fragment("lam_st", ["cand"], f"SELECT {facts} FROM cand")
    fragment(
        "lam_x",
        ["lam_st"],
        f"""
SELECT *, (SELECT sum(1 / log2(q + 1)) FROM range(1, least(p, {LAMBDA_K})::BIGINT + 1) t(q)) AS idcg FROM (
  SELECT user_id, date, item_id, label::INT AS y, [{x}]::DOUBLE[] AS x, sum(label::INT) OVER (PARTITION BY user_id, date) AS p,
    count(*) OVER (PARTITION BY user_id, date) AS c FROM cand, lam_st
) WHERE p > 0 AND p < c""",
    )
    fragment("lam_w0", ["lam_x"], f"SELECT {[0.0] * n}::DOUBLE[] AS w")
    for step in range(LAMBDA_STEPS):
        fragment(
            f"lam_r{step}",
            ["lam_x", f"lam_w{step}"],
            f"""
SELECT *, CASE WHEN r <= {LAMBDA_K} THEN 1 / log2(r + 1) ELSE 0 END AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, date ORDER BY -round(s, 9), item_id) AS r FROM (
    SELECT *, list_dot_product(x, w) AS s FROM lam_x, lam_w{step}))""",
        )
        force = "abs(a.d - b.d) / a.idcg / (1 + exp(a.s - b.s))"
        pulls = ", ".join(f"sum({force} * (a.x[{i}] - b.x[{i}]))" for i in range(1, n + 1))
        fragment(
            f"lam_w{step + 1}",
            [f"lam_r{step}"],
            f"""
SELECT list_transform(w, lambda v, i: v + {LAMBDA_RATE}::DOUBLE * g[i] / n) AS w FROM lam_w{step}, (
  SELECT [{pulls}] AS g FROM lam_r{step} a JOIN lam_r{step} b ON a.user_id = b.user_id AND a.date = b.date AND a.y = 1 AND b.y = 0
), (SELECT count(DISTINCT (user_id, date)) AS n FROM lam_x)""",
        )


lambda_sql()


@register(
    "lambda_steps",
    query(
        [f"lam_w{LAMBDA_STEPS}"],
        f"""
SELECT feature, {rx('w / s', 'coefficient')} FROM (
  SELECT unnest({LAMBDA_COLUMNS}) AS feature, unnest(w) AS w, unnest([{', '.join(f's{i}' for i in range(len(LAMBDA_COLUMNS)))}]) AS s
  FROM lam_w{LAMBDA_STEPS}, lam_st)""",
    ),
)
def lambda_steps(spark, folder):
    """Coefficients after the first steps of the group-wise ranker."""
    w = World(spark, folder, prepared=True)
    coefficients, _ = fit_lambda_rank(candidate_frame(w)[0], LAMBDA_COLUMNS, k=LAMBDA_K, steps=LAMBDA_STEPS, rate=LAMBDA_RATE)
    return spark.createDataFrame(list(coefficients.items()), "feature string, coefficient double")


@register("lambda_ranker")
def lambda_ranker(spark, folder):
    """Group-wise ranker over the candidates of each user and day: learned on the validation days, scored on the test days."""
    valid, test, columns = candidate_frames(World(spark, folder, prepared=True))
    coefficients, _ = fit_lambda_rank(valid, columns, steps=5)
    return R.score_linear(test, coefficients).select("user_id", "date", "item_id", "score")


@register("ablation_sources")
def ablation_sources(spark, folder):
    """The candidate ranker with all channels and features, without what only the tower found, and without each feature group."""
    valid, test, columns = candidate_frames(World(spark, folder, prepared=True))
    keep = lambda df: df
    runs = [("all", keep, columns), ("no_tower", C.without_tower_only, S.features(prefix="tower_"))]
    runs += [(f"no_{group}", keep, S.features(without=[group])) for group in S.FEATURE_GROUPS]
    rows = None
    for name, source, used in runs:
        scored = R.predict(R.fit_logistic(source(valid), used), source(test), used)
        row = SC.auc(scored).select("auc", "rows").withColumn("source", F.lit(name))
        rows = row if rows is None else rows.unionByName(row)
    return rows


NESTED = {"context": ["F0"], "context_user": ["F0", "F1", "F3"], "all": ["F0", "F1", "F2", "F3", "F5"]}
for _set in ("context", "context_user"):
    newton_sql(f"lr_{_set}", S.pointwise_columns(NESTED[_set]), "label_complete")
_FITS = {"context": "lr_context", "context_user": "lr_context_user", "all": "lr_label_complete"}
for _set, _fit in _FITS.items():
    fragment(f"ab_{_set}", [f"{_fit}_score"], f"SELECT score AS s, label_complete AS y FROM {_fit}_score JOIN pointwise_sql USING (event_id)")


@register(
    "ablation_sweep",
    recursive_query(
        [f"ab_{name}" for name in NESTED],
        " UNION ALL ".join(
            f"SELECT '{name}' AS feature_set, {rx('(' + auc_sql(f'ab_{name}', 's', 'y') + ')', 'auc')}, (SELECT count(*) FROM ab_{name}) AS rows" for name in NESTED
        ),
    ),
)
def ablation_sweep(spark, folder):
    """The same logistic ranker on nested feature groups, AUC of each on the test days."""
    train, test, _ = pointwise(World(spark, folder))
    sets = {name: S.pointwise_columns(groups) for name, groups in NESTED.items()}
    return R.ablation(train, test, sets, lambda scored: SC.auc(scored).select("auc", "rows"))
