from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from reelwise.operators import sampling as SM


def users(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "user_id long")


def test_hash_split_matches_the_formula_and_is_stable(spark):
    got = {r.user_id: r.panel for r in SM.hash_split(users(spark, range(300)), 2026, 0.3).collect()}
    for user, panel in got.items():
        score = int.from_bytes(sha256(f"2026:{user}".encode()).digest()[:8], "big") / 2**64
        assert panel == ("full_val" if score < 0.3 else "full_test")
    more = {r.user_id: r.panel for r in SM.hash_split(users(spark, range(600)), 2026, 0.3).collect()}
    assert all(more[user] == panel for user, panel in got.items())


@pytest.mark.parametrize("fraction", [0.0, 1.0])
def test_hash_split_never_leaves_a_side_empty(spark, fraction):
    rows = SM.hash_split(users(spark, range(20)), 1, fraction).groupBy("panel").count().collect()
    assert sorted(r["count"] for r in rows) == [1, 19]


def test_hash_split_needs_two_users(spark):
    with pytest.raises(Exception, match="two users"):
        SM.hash_split(users(spark, [1]), 1).collect()


def test_profile_users_mix(spark):
    everyone, panel = users(spark, range(100)), users(spark, range(30))
    chosen = {r.user_id for r in SM.profile_users(everyone, panel, 40, 0.5, 1).collect()}
    assert len(chosen) == 40 and len(chosen & set(range(30))) == 20
    few = {r.user_id for r in SM.profile_users(everyone, users(spark, range(3)), 40, 0.5, 1).collect()}
    assert len(few) == 40 and {0, 1, 2} <= few


def test_complete_users_stay_whole(spark, make_log):
    log = make_log([(u, i, 20240101, 1.0) for u in range(20) for i in range(u % 5 + 1)])
    kept = SM.cap_complete_users(log, 30, 5)
    whole = {r.user_id: r["count"] for r in log.groupBy("user_id").count().collect()}
    got = {r.user_id: r["count"] for r in kept.groupBy("user_id").count().collect()}
    assert len(got) == int(20 * 30 / log.count())
    assert all(whole[user] == n for user, n in got.items())
    assert SM.cap_complete_users(log, 10_000, 5).count() == log.count()


@pytest.mark.parametrize("policy", ["uniform", "popularity_biased", "positive_biased"])
def test_exposure_sizes_and_bias(spark, policy):
    feedback = spark.range(2000).select(
        F.col("id").alias("user_id"), (F.col("id") % 10).alias("item_id"), (F.col("id") % 4 == 0).cast("int").alias("label_complete")
    )
    popularity = spark.createDataFrame([(0, 10_000)], "item_id long, cnt long")
    got = SM.sample_exposure(feedback, policy, 0.1, popularity, 3).toPandas()
    assert len(got) == 200 and got.user_id.is_unique
    if policy == "popularity_biased":
        assert (got.item_id == 0).mean() > 0.9
    elif policy == "positive_biased":
        assert got.label_complete.mean() > 0.45
    else:
        assert 0.15 < got.label_complete.mean() < 0.35


def test_hard_negatives(spark):
    known = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(99, 7)], "item_id long, first_category int")
    positives = spark.createDataFrame([(u, i) for u in range(8) for i in [0, 1, 2, 5, 99]], "user_id long, item_id long")
    rows = SM.draw_negatives(positives, known, 4).collect()
    assert len(rows) == 40
    for r in rows:
        assert r.negative_id != r.item_id
        if r.item_id != 99:
            assert r.negative_id % 3 == r.item_id % 3 and r.negative_id < 30


def test_negative_cap_keeps_positives(spark):
    rows = [(1, 20240101, i, int(i < 3)) for i in range(20)] + [(2, 20240101, i, int(i < 9)) for i in range(12)]
    df = spark.createDataFrame(rows, "user_id long, date int, item_id long, label int")
    got = SM.cap_negatives(df, 8, 1).groupBy("user_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    assert {(r.user_id, r.p, r.n) for r in got} == {(1, 3, 8), (2, 9, 9)}


def candidates(spark):
    rows = []
    for user in range(4):
        for item in range(12):
            label = int(item < 3 and user < 3)
            rows.append((user, 20240101, item, label, item / 20, 0.0, 0.0))
    return spark.createDataFrame(
        rows,
        "user_id long, date int, item_id long, label_complete int, itemcf_rank_score double, content_rank_score double, tower_rank_score double",
    )


def test_pairs_stay_in_their_group(spark):
    rows = SM.pairwise_samples(candidates(spark), 4, 9).toPandas()
    assert len(rows) == 3 * 3 * 4 and set(rows.user_id) == {0, 1, 2}  # user 3 has no positive
    assert (rows.positive_id < 3).all() and (rows.negative_id >= 3).all()
    hard = rows[rows.draw < 2]
    assert (hard.negative_id >= 6).all()  # the 2 * 3 strongest negatives
    assert not hard.duplicated(["user_id", "positive_id", "negative_id"]).any()


def test_uniform_draws_are_no_neighbours_in_score_order(spark):
    rows = [(1, 1, i, int(i < 3), float(i), 0.0, 0.0) for i in range(300)]
    df = spark.createDataFrame(
        rows, "user_id long, date int, item_id long, label_complete int, itemcf_rank_score double, content_rank_score double, tower_rank_score double"
    )
    out = SM.pairwise_samples(df, 8, 5).toPandas()
    far = out[out.draw >= 4].sort_values("draw").groupby("positive_id").negative_id.apply(list)
    steps = [abs(a - b) for items in far for a, b in zip(items, items[1:])]
    assert len(steps) == 9 and sum(step == 1 for step in steps) <= 1
    assert not out[out.draw >= 4].duplicated(["positive_id", "negative_id"]).any()


def test_listwise_targets_sum_to_one(spark):
    rows = SM.listwise_targets(candidates(spark)).toPandas()
    assert set(rows.user_id) == {0, 1, 2}
    assert rows.groupby("user_id").target.sum().round(9).eq(1).all()
