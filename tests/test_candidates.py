import pytest
from pyspark.sql import functions as F

from reelwise import schema as S
from reelwise.operators import candidates as C
from reelwise.operators import history as H


@pytest.fixture
def world(spark, make_log):
    log = make_log(
        [
            (1, 10, 20240101, 2.0),
            (1, 11, 20240102, 1.0),
            (1, 11, 20240102, 1.0),
            (2, 12, 20240103, 0.5),
            (1, 20, 20240120, 1.5),  # positive, recalled
            (1, 21, 20240120, 0.2),  # exposed negative, recalled
            (1, 22, 20240120, 0.2),  # exposed, not recalled
        ]
    )
    items = spark.createDataFrame(
        [(10, 3, 7, 9.0, 20240101), (11, 3, 8, 9.0, 20240101), (12, 4, 7, 9.0, 20240101), (20, 3, 7, 9.0, 20240110)]
        + [(21, 4, -1, None, 20240101), (22, 4, 8, 9.0, 20240101), (23, 3, 7, 9.0, 20240101), (30, 3, 7, 9.0, 20240125)],
        "item_id long, first_category int, author_id long, video_duration double, first_seen_date int",
    )
    ranked = lambda ids: spark.createDataFrame(
        [(1, item, n + 1) for n, item in enumerate(ids)], "user_id long, item_id long, rank int"
    )
    channels = {"itemcf": ranked([30, 20, 23]), "content": ranked([23, 21, 20]), "tower": ranked([21])}
    return log, items, channels


def build(world, **options):
    log, items, channels = world
    return C.build_candidates(log, items, "test", channels, options.pop("top", 10), **options)


def test_unexposed_candidates_vanish(world):
    frame, truth = build(world)
    rows = {r.item_id: r for r in frame.collect()}
    # 23 was recalled but never shown; 30 is not available yet; 22 was shown but not recalled
    assert set(rows) == {20, 21}
    assert (rows[20].label, rows[21].label) == (1, 0)
    assert [tuple(r) for r in truth.collect()] == [(1, 20240120, 20)]


def test_ranks_follow_the_availability_filter(world):
    rows = {r.item_id: r for r in build(world)[0].collect()}
    assert rows[20].itemcf_rank_score == 1.0  # item 30 does not use up a rank
    assert rows[20].content_rank_score == pytest.approx(1 / 3)
    assert rows[20].channel_count == 2 and rows[21].channel_count == 2
    assert rows[21].author_id_hash == 255 and rows[21].video_duration == 0


def test_cross_features_are_products(world):
    for r in build(world)[0].collect():
        assert r.category_item_complete_cross == pytest.approx(r.category_affinity * r.item_complete_rate)
        assert r.author_item_complete_cross == pytest.approx(r.author_affinity * r.item_complete_rate)
        assert r.channel_item_complete_cross == pytest.approx(r.channel_count * r.item_complete_rate)
        assert r.cold_content_cross == r.is_cold_item * r.content_present
        assert r.tower_age_cross == r.tower_present * r.item_age_days
        assert r.is_cold_item == 1.0
    rows = {r.item_id: r for r in build(world)[0].collect()}
    assert rows[20].category_affinity == 1.0 and rows[20].author_affinity == pytest.approx(1 / 3)
    assert rows[20].item_age_days == 10 and rows[20].user_interactions == 3


def test_channel_depth(world):
    frame, _ = build(world, top=1, weights={"tower": 0.01})
    rows = {r.item_id: r for r in frame.collect()}
    assert rows[20].content_present == 0 and rows[20].itemcf_present == 1
    assert rows[21].tower_present == 1


def test_types(world):
    kinds = dict(build(world)[0].dtypes)
    assert {kinds[name] for name in S.FEATURES} == {"float"}
    assert {kinds[name] for name in ["label", *S.LABELS]} == {"tinyint"} and kinds["date"] == "int"


def test_encoder(spark):
    fit = spark.createDataFrame([(5, 1.0), (3, 3.0), (5, None)], "item_id long, x double").withColumn("flat", F.lit(2.0))
    new = spark.createDataFrame([(3, 4.0, 2.0), (9, None, 3.0)], "item_id long, x double, flat double")
    vocab, stats = C.fit_encoder(fit, ["item_id"], ["x", "flat"])
    rows = C.encode(new, vocab, stats, ["item_id"], ["x", "flat"]).collect()
    assert [r.item_id_code for r in rows] == [1, 0]
    assert [r.x_z for r in rows] == [2.0, 0.0]  # population std 1, missing becomes 0
    assert [r.flat_z for r in rows] == [0.0, 1.0]  # a constant column keeps scale 1


def test_histories_are_strictly_earlier(spark, make_log):
    rows = [(1, i, 20240101 + i % 5, [0.1, 1.0, 2.5][i % 3], int(i % 3 == 0)) for i in range(40)]
    log = make_log(rows)
    items = spark.createDataFrame([(i, i % 2, i * 100) for i in range(39)], "item_id long, first_category int, author_id long")
    targets = spark.createDataFrame([(1, 20240101), (1, 20240103), (1, 20240110), (2, 20240103)], "user_id long, date int")
    got = {(r.user_id, r.date): r.history for r in H.history_as_of(log, targets, items, 6).collect()}
    pdf = log.toPandas().sort_values(["date", "timestamp", "event_id"])
    for (user, date), history in got.items():
        past = pdf[(pdf.user_id == user) & (pdf.date < date)].tail(6)
        assert [e.item_id for e in history] == past.item_id.tolist()
    assert got[1, 20240101] == [] and got[2, 20240103] == []
    newest = got[1, 20240110][-1]
    assert newest.item_id == 39 and newest.first_category == -1 and newest.author_id_hash == 255
    assert newest.behaviour == 1 + 4 and newest.watch == pytest.approx(0.02)
    positives = {(r.user_id, r.date): r.history for r in H.history_as_of(log, targets, items, 3, True).collect()}
    assert all(e.behaviour in (2, 4) for h in positives.values() for e in h)


def test_missing_histories_are_refused(spark):
    rows = spark.createDataFrame([(1, 20240101)], "user_id long, date int")
    tables = spark.createDataFrame([(1, 20240102)], "user_id long, date int")
    assert H.require_histories(tables, tables).count() == 1
    with pytest.raises(Exception, match="no histories"):
        H.require_histories(rows, tables).collect()


def test_lambda_rank_raises_ndcg(spark, monkeypatch):
    import math
    import random

    import numpy as np

    from reelwise.functions import ordering
    from reelwise.operators.lambda_rank import fit_lambda_rank, lambda_gradient, training_groups
    from reelwise.operators.rankers import score_linear

    rng = random.Random(5)
    rows = []
    for user in range(60):
        for item in range(rng.randint(2, 30)):
            good, noise = rng.gauss(0, 1), rng.gauss(0, 3)
            rows.append((user, 1, item, good, noise, 7.0, int(good + rng.gauss(0, 0.7) > 0.8)))
    df = spark.createDataFrame(rows, "user_id long, date int, item_id long, a double, b double, c double, label int")
    weights, course = fit_lambda_rank(df, ["a", "b", "c"], steps=6, k=5)
    assert course[-1] > course[0] + 0.15 and weights["a"] > 5 * abs(weights["b"]) and weights["c"] == 0.0
    assert score_linear(df, weights).count() == len(rows)

    # one gradient against all pairs
    data, _, _ = training_groups(df, ["a", "b", "c"], "label", 5, ("user_id", "date"))
    w = np.array([0.3, -0.2, 0.0])
    want, groups, quality = np.zeros(3), 0, 0.0
    pdf = data.toPandas()
    for _, g in pdf.groupby("user_id"):
        x, y = g[["x0", "x1", "x2"]].to_numpy(), g.y.to_numpy()
        s = x @ w
        r = np.empty(len(g), int)
        r[np.lexsort((g.item_id, -np.round(s, 9)))] = np.arange(1, len(g) + 1)
        d = np.where(r <= 5, 1 / np.log2(r + 1), 0)
        ideal = sum(1 / math.log2(q + 1) for q in range(1, min(y.sum(), 5) + 1))
        groups, quality = groups + 1, quality + (d * y).sum() / ideal
        for i in np.flatnonzero(y == 1):
            for j in np.flatnonzero(y == 0):
                want += abs(d[i] - d[j]) / ideal / (1 + math.exp(s[i] - s[j])) * (x[i] - x[j])
    got, ndcg = lambda_gradient(data, w, 5)
    assert np.allclose(got, want / groups) and ndcg == pytest.approx(quality / groups)
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 10)  # groups too large for one window
    assert np.allclose(lambda_gradient(data, w, 5)[0], want / groups)
    none, flat = fit_lambda_rank(df.filter("label = 0"), ["a"], steps=2)
    assert none == {"a": 0.0} and flat == [0.0, 0.0]


def test_newton_matches_a_plain_fit(spark):
    import random

    import numpy as np

    from reelwise.operators.newton import fit_newton

    rng = random.Random(3)
    rows = []
    for i in range(900):
        a, b = rng.gauss(5, 2), rng.choice([None, rng.gauss(0, 1)])
        rows.append((i, a, b, 4.0, int(rng.random() < 1 / (1 + np.exp(3 - a + 0.5 * (b or 0))))))
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, y int")
    model = fit_newton(df.repartition(5), ["a", "b", "c"], "y")
    again = fit_newton(df.repartition(3, "a"), ["a", "b", "c"], "y")
    assert np.allclose(model.weights, again.weights, atol=1e-9)
    raw = np.array([[r[1], np.nan if r[2] is None else r[2]] for r in rows], float)
    raw = np.where(np.isnan(raw), np.nanmedian(raw, axis=0), raw)
    x = np.column_stack([(raw - raw.mean(0)) / raw.std(0), np.zeros(len(raw)), np.ones(len(raw))])
    y = np.array([r[4] for r in rows])
    cost = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    theta = np.append(model.weights, model.intercept)
    p = 1 / (1 + np.exp(-x @ theta))
    gradient = x.T @ (cost * (p - y)) + np.append(model.weights, 0)
    assert np.abs(gradient).max() < 1e-6
    scores = [r.s for r in df.select("i", model.probability().alias("s")).orderBy("i").collect()]
    assert np.allclose(scores, p)
    assert fit_newton(df.filter("y = 1"), ["a"], "y").weights.tolist() == [0.0]
