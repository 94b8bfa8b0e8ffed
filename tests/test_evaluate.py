import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwise.operators import evaluate as E
from reelwise.operators import rerank as RR
from reelwise.operators import scoring_metrics as SC


def ranked(spark, rows):
    return spark.createDataFrame(rows, "user_id long, date int, item_id long, rank int")


def test_truth_excludes_seen(spark, make_log):
    log = make_log([(1, 10, 20240101, 1.0), (1, 10, 20240120, 1.0), (1, 11, 20240120, 1.0), (1, 12, 20240120, 0.5)])
    seen = spark.createDataFrame([(1, 10)], "user_id long, item_id long")
    assert [tuple(r) for r in E.ground_truth(log, "test", exclude=seen).collect()] == [(1, 20240120, 11)]
    assert E.ground_truth(log, "test", keys=["user_id"]).count() == 2


def test_recall_numbers_and_empty_lists(spark):
    truth = spark.createDataFrame(
        [(1, 1, 10), (1, 1, 11), (2, 1, 20), (2, 2, 21)], "user_id long, date int, item_id long"
    )
    lists = ranked(spark, [(1, 1, 10, 1), (1, 1, 99, 2), (1, 1, 11, 3), (2, 1, 98, 1), (3, 1, 10, 1)])
    pop = spark.createDataFrame([(10, 3), (98, 1)], "item_id long, cnt long")
    row = E.recall_metrics(lists, truth, pop, F.lit(10), [1, 3]).first()
    assert row.recall_at_1 == pytest.approx(0.5 / 3) and row.recall_at_3 == pytest.approx(1 / 3)
    ndcg = (1 + 0.5) / (1 + 1 / math.log2(3))
    assert row.ndcg_at_3 == pytest.approx(ndcg / 3) and row.hit_rate_at_3 == pytest.approx(1 / 3)
    assert (row.evaluated_users, row.evaluated_groups) == (2, 3)
    assert row.coverage_at_3 == 0.4  # user 3 has no truth group
    assert row.average_log_popularity_at_3 == pytest.approx((math.log(4) + math.log(2)) / 4)
    cold = E.cold_recall(lists, truth, spark.createDataFrame([(10,), (20,)], "item_id long"), 3).first()
    assert (cold.cold_recall_at_3, cold.cold_evaluated_groups) == (0.5, 2)


def test_future_items_are_filtered(spark):
    items = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "item_id long, first_seen_date int")
    lists = spark.createDataFrame([(7, 2, 1), (7, 3, 2), (7, 1, 3), (7, 4, 4)], "user_id long, item_id long, rank int")
    truth = spark.createDataFrame([(7, 6, 1), (7, 9, 1)], "user_id long, date int, item_id long")
    got = {(r.date, r.item_id): r["rank"] for r in E.available_on_date(lists, truth, items, 5).collect()}
    assert got == {(6, 1): 1, (9, 2): 1, (9, 1): 2}


FEEDBACK = (
    "user_id long, item_id long, label_complete int, label_strong int, label_short int, "
    "watch_ratio_clipped double, utility double"
)


def test_dense_panel_walk(spark):
    feedback = spark.createDataFrame(
        [(1, 10, 1, 0, 0, 1.0, 1.0), (1, 11, 0, 0, 1, 0.1, -0.5), (1, 12, 1, 1, 0, 2.0, 1.5), (2, 10, 0, 0, 0, 0.5, 0.0)],
        FEEDBACK,
    )
    catalog = spark.createDataFrame([(10,), (11,), (12,), (13,)], "item_id long")
    rows = [(1, 99, 1), (1, 10, 2), (1, 13, 3), (1, 10, 4), (1, 11, 5), (1, 98, 6), (1, 12, 7), (2, 97, 1), (5, 10, 1)]
    lists = spark.createDataFrame(rows, "user_id long, item_id long, rank int")
    metrics, users = E.dense_panel_metrics(lists, feedback, catalog, 2)
    by = {r.user_id: r for r in users.collect()}
    assert (by[1].recommended_count, by[1].precision_at_2, by[1].recall_at_2) == (2, 0.5, 0.5)
    assert by[2].recommended_count == 0 and by[2].recall_at_2 == 0 and by[2].ndcg_at_2 == 0
    row = metrics.first()
    assert row.invalid_recommendations == 2  # 99 and user 2's 97; 98 comes after the second usable item
    assert row.unobserved_recommendation_pairs == 1
    assert (row.evaluated_users, row.catalog_size, row.evaluated_pairs) == (2, 4, 4)
    assert row.matrix_density == 0.5 and row.coverage_at_2 == 0.5


def scored(spark, n=3000, seed=5):
    """A third of the rows belong to one user; scores have ties."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 1 / 3 else rng.randrange(1, 40)
        label = int(rng.random() < 0.4)
        rows.append((user, rng.randrange(3), i, label, 0, 0, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * label, 0.2))), 2)))
    return spark.createDataFrame(
        rows,
        "user_id long, date int, item_id long, label_complete int, label_strong int, label_short int, score double",
    )


def plain_auc(labels, scores):
    pos, neg = scores[labels == 1], scores[labels == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_auc_family_against_brute_force(spark):
    df = scored(spark)
    pdf = df.toPandas()
    row = SC.ranking_metrics(df).first()
    assert row.auc == pytest.approx(plain_auc(pdf.label_complete.values, pdf.score.values))
    total = weight = 0
    for _, g in pdf.groupby("user_id"):
        if g.label_complete.nunique() == 2:
            total += len(g) * plain_auc(g.label_complete.values, g.score.values)
            weight += len(g)
    assert row.gauc == pytest.approx(total / weight)
    p = pdf.score.clip(1e-7, 1 - 1e-7)
    loss = -np.where(pdf.label_complete == 1, np.log(p), np.log(1 - p)).mean()
    assert row.log_loss == pytest.approx(loss)
    values = []
    for _, g in pdf.groupby(["user_id", "date"]):
        g = g.sort_values(["score", "item_id"], ascending=[False, True])
        top, ideal = g.label_complete.values[:10], np.sort(g.label_complete.values)[::-1][:10]
        d = 1 / np.log2(np.arange(2, len(top) + 2))
        if ideal.sum():
            values.append((top * d).sum() / (ideal * d).sum())
    assert row.ndcg_at_10 == pytest.approx(np.mean(values))


def test_one_class_users_do_not_count(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.3)], "user_id long, label_complete int, score double")
    assert SC.gauc(df).first().gauc == 0.0


def plain_mmr(rows, lam, weights):
    """rows: (item, category, author, score), in row order; returns items in pick order."""
    scores = np.array([r[3] for r in rows], dtype=float)
    span = scores.max() - scores.min()
    rel = (scores - scores.min()) / span if span > 0 else np.ones(len(rows))
    near, left, out = np.zeros(len(rows)), set(range(len(rows))), []
    while left:
        value = rel if not out else lam * rel - (1 - lam) * near
        best = min(left, key=lambda i: (-round(value[i], 12), rows[i][0]))
        out.append(rows[best][0])
        left.discard(best)
        same = [weights[0] * (r[1] == rows[best][1]) + weights[1] * (r[2] == rows[best][2]) for r in rows]
        near = np.maximum(near, np.array(same) / sum(weights))
    return out


@pytest.mark.parametrize("lam", [0.0, 0.5, 0.9, 1.0])
def test_mmr_equals_the_greedy_walk(spark, lam):
    rng = random.Random(int(lam * 10) + 1)
    rows = []
    for group in range(12):
        size = 1 if group == 0 else 400 if group == 1 else rng.randrange(2, 40)  # one hot group
        for item in range(size):
            rows.append((group, 1, item, rng.randrange(4), rng.randrange(5), round(rng.random(), 6)))
    df = spark.createDataFrame(
        rows, "user_id long, date int, item_id long, first_category int, author_id_hash int, score double"
    )
    got = RR.mmr_rerank(df, "score", "m", lam).toPandas().sort_values(["user_id", "m_rank"])
    for user, g in got.groupby("user_id"):
        mine = [(r[2], r[3], r[4], r[5]) for r in rows if r[0] == user]
        assert g.item_id.tolist() == plain_mmr(mine, lam, (0.6, 0.4))
        assert (g.m == 1 / g.m_rank).all()


def test_mmr_arguments(spark):
    df = spark.createDataFrame([], "user_id long, date int, item_id long, first_category int, score double")
    assert RR.mmr_rerank(df, "score").count() == 0
    with pytest.raises(ValueError):
        RR.mmr_rerank(df, "score", lam=1.5)
    with pytest.raises(KeyError):
        RR.mmr_rerank(df, "other")


def test_rrf_formula(spark):
    df = spark.createDataFrame(
        [(1, 1, 10, 0.9, 0.1), (1, 1, 11, 0.5, 0.8), (1, 1, 12, 0.5, 0.9)],
        "user_id long, date int, item_id long, a double, b double",
    )
    got = {r.item_id: r.rrf_score for r in RR.rrf(df, {"a": 0.6, "b": 0.4}).collect()}
    assert got[10] == pytest.approx(0.6 / 61 + 0.4 / 63)
    assert got[11] == pytest.approx(0.6 / 62 + 0.4 / 62)  # tied in a, the lower item leads
    assert got[12] == pytest.approx(0.6 / 63 + 0.4 / 61)


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    a = [(u, 1, float(x)) for u, x in enumerate(rng.random(80))]
    b = [(u, 1, float(x + 0.1 + rng.normal() * 0.05)) for u, _, x in a if u != 3]
    schema = "user_id long, date int, m double"
    fa, fb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    diff = np.array([y[2] - a[y[0]][2] for y in b])
    for poisson in (False, True):
        row = E.paired_bootstrap(fa, fb, "m", 300, poisson=poisson).first()
        assert row.paired_users == 79 and row.mean_difference == pytest.approx(diff.mean())
        half = 1.96 * diff.std() / math.sqrt(79)
        assert row.ci_95_low == pytest.approx(diff.mean() - half, abs=half / 2)
        assert row.ci_95_high == pytest.approx(diff.mean() + half, abs=half / 2)


def test_gates(spark):
    rows = [("a", 0.3, 0.01, 0.2), ("b", 0.4, -0.01, 0.2), ("c", 0.35, 0.02, -0.1)]
    df = spark.createDataFrame(rows, "experiment_id string, recall double, recall_ci_low double, ndcg_ci_high double")
    got = E.challenger_gate(df, "base").collect()
    assert {r.winner for r in got} == {"a"} and [r.eligible for r in got] == [True, False, False]
    assert E.challenger_gate(df.filter("recall_ci_low < 0"), "base").first().winner == "base"


def test_rank_consistency(spark):
    rows = [("full_exposure", None, None, m, v, v) for m, v in zip("abc", (0.1, 0.2, 0.3))]
    rows += [("sparse_replay", "uniform", 0.1, m, v, -v) for m, v in zip("abc", (1.0, 2.0, 3.0))]
    df = spark.createDataFrame(
        rows,
        "evaluation string, policy string, density double, experiment_id string, recall_at_10 double, ndcg_at_10 double",
    )
    row = E.rank_consistency(df, 10).first()
    assert (row.spearman_recall, row.spearman_ndcg) == (pytest.approx(1.0), pytest.approx(-1.0))
    assert (row.full_best_ndcg, row.sparse_best_ndcg, row.models) == ("c", "a", 3)


def test_cutoffs():
    assert E.eval_cutoffs(100) == [10, 100] and E.eval_cutoffs(500) == [10, 200, 500]
