from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelwise.operators import recall as RC
from reelwise.operators.tiles import linked_topk
from reelwise.session import cut_lineage


def history(spark, rng, users=40, items=25):
    rows = [(u, int(i), p, float(rng.choice([0.5, 1.0, 2.0]))) for u in range(users) for p, i in enumerate({0} | set(rng.integers(1, items, 6).tolist()))]
    return spark.createDataFrame([*rows, (3, None, 9, 1.0)], "user_id long, item_id long, pos int, weight double"), rows


@pytest.mark.parametrize("held", [100_000, 2])
def test_similarity_with_much_held_items(spark, monkeypatch, held):
    monkeypatch.setattr(RC, "MUCH_HELD", held)
    df, rows = history(spark, np.random.default_rng(3))
    tails, count, co = defaultdict(dict), defaultdict(int), defaultdict(float)
    for u, i, _, w in rows:
        tails[u][i] = w
    for u, tail in tails.items():
        for i, w in tail.items():
            count[i] += 1
            for j, x in tail.items():
                if i != j:
                    co[i, j] += (w * x) ** 0.5 / np.log(len(tail) + (u == 3) + 2)
    got = defaultdict(list)
    for r in RC.itemcf_similarity(df, 5).orderBy("item_id", "rn").collect():
        got[r.item_id].append((r.other_id, round(r.sim, 6)))
    for i in count:
        sims = {j: co[a, j] / (count[a] * count[j]) ** 0.5 for a, j in co if a == i}
        best = sorted(sims, key=lambda j: (-round(sims[j], 9), j))[:5]
        assert got[i] == [(j, round(sims[j], 6)) for j in best]


def test_similarity_shuffles_no_pairs(spark):
    df, _ = history(spark, np.random.default_rng(5))
    plan = RC.itemcf_similarity(df, 5)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("WindowGroupLimit")[0] if "WindowGroupLimit" in plan else plan
    assert "Join [other_id" not in plan and "hashpartitioning(item_id" in plan and below


def test_lists_meet_blocks_of_users(spark):
    rng = np.random.default_rng(1)
    tails = {u: {int(i): float(rng.random()) for i in rng.integers(0, 30, 5)} for u in range(50)}
    links = {i: {int(j): float(rng.random()) for j in rng.integers(100, 140, 8)} for i in range(25)}
    seen = {(u, int(j)) for u in range(50) for j in rng.integers(100, 140, 3 if u else 400)}
    packed = lambda d, key: spark.createDataFrame([(a, list(b), list(b.values())) for a, b in d.items()], f"{key} long, terms array<long>, weights array<double>")
    blocked = spark.createDataFrame([*seen, *list(seen)[:5], (7, 10**6), (10**6, 100)], "user_id long, item_id long")
    out = linked_topk(packed(tails, "user_id"), packed(links, "item_id"), blocked, 4, 10)
    got = defaultdict(list)
    for r in out.orderBy("user_id", "rank").collect():
        got[r.user_id].append((r.item_id, round(r.score, 6)))
    for u, tail in tails.items():
        total = defaultdict(float)
        for i, pull in tail.items():
            for j, w in links.get(i, {}).items():
                total[j] += pull * w
        best = sorted((j for j in total if (u, j) not in seen), key=lambda j: (-round(total[j], 9), j))[:4]
        assert got[u] == [(j, round(total[j], 6)) for j in best]
    assert linked_topk(packed(tails, "user_id").limit(0), packed(links, "item_id"), blocked, 4).count() == 0
    assert out.filter(F.col("rank") > 4).count() == 0


@pytest.mark.parametrize("users", [50, 1, 0])
def test_users_take_turns(spark, monkeypatch, users):
    """at a time, lists are shuffled for some of the blocks of users only."""
    from reelwise.operators import tiles

    monkeypatch.setattr(tiles, "ROUND_ENTRIES", 1)
    rounds = []

    def kept(df):
        out = cut_lineage(df)
        if "rank" in df.columns:
            rounds.append({r.user_id for r in out.select("user_id").collect()})
        return out

    monkeypatch.setattr(tiles, "cut_lineage", kept)
    rng = np.random.default_rng(2)
    tails = [(u, [int(i) for i in rng.choice(20, 4, replace=False)], [1.0, 0.5, 2.0, 0.25]) for u in range(users)]
    links = {i: {int(j): float(rng.random()) for j in rng.integers(100, 140, 8)} for i in range(18)}
    lists = spark.createDataFrame([(i, list(x), list(x.values())) for i, x in links.items()], "item_id long, terms array<long>, weights array<double>")
    seen = {(u, int(j)) for u in range(users + 1) for j in rng.integers(100, 140, 3)}
    df = spark.createDataFrame(tails, "user_id long, terms array<long>, weights array<double>")
    got = defaultdict(list)
    for r in linked_topk(df, lists, spark.createDataFrame(sorted(seen), "user_id long, item_id long"), 5, 4).orderBy("user_id", "rank").collect():
        got[r.user_id].append((r.item_id, round(r.score, 6)))
    assert len(rounds) == (4 if users == 50 else 1) and max(map(len, rounds)) <= 25
    assert sum(map(len, rounds)) == len(set().union(*rounds)) == len(got)
    for u, terms, pulls in tails:
        total = defaultdict(float)
        for i, pull in zip(terms, pulls):
            for j, w in links.get(i, {}).items():
                total[j] += pull * w
        assert got[u] == [(j, round(total[j], 6)) for j in sorted((j for j in total if (u, j) not in seen), key=lambda j: (-round(total[j], 9), j))[:5]]


def test_ids_far_apart_are_coded():
    import pyarrow as pa

    from reelwise.operators.tiles import linked_best

    far = [-(2**62), 5, 2**62]
    links = pa.table({"_a": [1, 2], "terms": pa.array([far, far[1:]]), "weights": pa.array([[0.5, 0.5, 0.25], [1.0, 0.25]])})
    people = pa.table({"_a": [7, 8], "terms": pa.array([[1, 2], [1]]), "weights": pa.array([[1.0, 1.0], [2.0]])})
    past = pa.table({"_a": [8, 8], "terms": pa.array([[5, 6], [2**61]]), "weights": pa.array([None, None], pa.list_(pa.float64()))})
    rows = [tuple(r.values()) for b in linked_best(people, past, links, 2) for r in b.to_pylist()]
    assert rows == [(7, 5, 1.5, 1), (7, far[0], 0.5, 2), (8, far[0], 1.0, 1), (8, 2**62, 0.5, 2)]
