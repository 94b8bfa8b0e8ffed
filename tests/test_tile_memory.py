"""What one task of the vector and item CF recall holds or receives."""

import tracemalloc

import numpy as np
import pyarrow as pa

from reelwise.operators import tiles
from reelwise.operators.vectors import mean_vectors


def vectors(spark, key, n, kind="double"):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(n)], f"{key} long, vector array<{kind}>")


def test_users_are_scored_by_strips(spark):
    def score(people, catalog):
        assert people.num_rows <= 128 and catalog.schema.field("vector").type == pa.list_(pa.field("element", pa.float32()))
        return tiles.dense_scores(people, catalog)

    users, items = vectors(spark, "user_id", 1300), vectors(spark, "item_id", 60, "float")
    seen = spark.createDataFrame([(u, i) for u in range(0, 1300, 3) for i in range(u % 60)], "user_id long, item_id long")
    got = {}
    for r in tiles.streamed(users, items, seen, 4, score, 5000, 25).collect():
        got.setdefault(r.user_id, []).append((-round(r.score, 9), r.item_id))
    own, catalog = (np.array([r.vector for r in df.orderBy(df.columns[0]).collect()]) for df in (users, items))
    for u in range(1300):
        scores = np.round(own[u] @ catalog.T, 9)
        best = sorted((-scores[i], i) for i in range(60) if u % 3 or i >= u % 60)[:4]
        assert sorted(got.get(u, []))[:4] == best


def test_items_go_to_few_user_blocks(spark):
    users, items = vectors(spark, "user_id", 6000), vectors(spark, "item_id", 6000)
    sent = tiles.streamed(users, items, None, 1, tiles.dense_scores, tiles.USER_BLOCK, 500)
    assert sent.count() <= 6000 * 2  # 8 partitions: six blocks of users, two chunks


def test_best_rows_match_a_full_sort():
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(30, 200)), 1) + rng.normal(size=(30, 200)) * 1e-12  # many ties
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    scores[0], scores[1, 5:] = -np.inf, -np.inf
    best = tiles.Best(30, 7)
    for low in range(0, 200, 40):
        best.add(np.arange(low, low + 40), scores[:, low : low + 40])
    for u in range(30):
        want = sorted((-round(scores[u, i], 9), i) for i in range(200) if scores[u, i] > -np.inf)[:7]
        assert best.item[best.row == u].tolist() == [i for _, i in want]


def test_mean_vectors_meet_each_vector_once_a_block(spark, monkeypatch):
    kept = []
    monkeypatch.setattr("reelwise.operators.vectors.cut_lineage", lambda df: kept.append(df.columns) or df)
    monkeypatch.setattr(tiles, "MEANS_ENTRIES", 7)
    tails = {u: [(u * j) % 11 for j in range(1, 1 + u % 6)] for u in range(40)}
    pairs = spark.createDataFrame([(u, i) for u, t in tails.items() for i in t] + [(3, None), (None, 4)], "user_id long, item_id long")
    found = {i: [float(i), float(i * i), 1.0] for i in range(9)}  # 9 and 10 have no vector, 8 two
    items = spark.createDataFrame([*found.items(), (8, [0.0, 0.0, 0.0]), (9, None)], "item_id long, vector array<float>")
    got = {r.user_id: r.vector for r in mean_vectors(pairs, items).collect()}
    want = {None: found[4]}
    for u, tail in tails.items():
        rows = [v for i in tail if i in found for v in ([found[i], [0.0] * 3] if i == 8 else [found[i]])]
        if rows:
            want[u] = np.mean(rows, axis=0).tolist()
    assert got.keys() == want.keys()
    assert all(np.allclose(got[u], want[u]) for u in want)
    assert ["user_id", "terms"] in kept  # a user's items travel as one row


def test_item_lists_of_a_block_are_not_coded_at_once():
    lists, width = 4000, 100
    terms = pa.ListArray.from_arrays(np.arange(lists + 1, dtype=np.int32) * width, pa.array(np.arange(lists * width) % 5000))
    links = pa.table({"_a": np.arange(lists), "terms": terms, "weights": pa.ListArray.from_arrays(terms.offsets, pa.array(np.ones(lists * width)))})
    people = pa.table({"_a": [1, 2], "terms": pa.array([[7], [8, 9]]), "weights": pa.array([[1.0], [1.0, 2.0]])})
    past = pa.table({"_a": [1], "terms": pa.array([[700]]), "weights": pa.array([None], pa.list_(pa.float64()))})
    tracemalloc.start()
    rows = [r for b in tiles.linked_best(people, past, links, 3) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["item_id"] for r in rows] == [701, 702, 703, 900, 901, 902]
    assert peak < 1_000_000  # the lists hold 3.2 MB of items
