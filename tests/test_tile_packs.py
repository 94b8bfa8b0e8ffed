"""Vectors travel in packs, and the product of all pairs is taken in floats without changing a list."""

import numpy as np
import pyarrow as pa

from reelwise.operators import tiles


def table(vectors, kind=pa.float64()):
    return pa.table({"_a": np.arange(len(vectors)), "vector": pa.array([list(v) for v in vectors], pa.list_(kind))})


def best_of(people, catalog, k, cut, masked=()):
    best = tiles.Best(people.num_rows, k)
    for low in range(0, catalog.num_rows, cut):
        ids, scores, slack, exact = tiles.dense_scores(people, catalog.slice(low, cut))
        for user, item in masked:
            if low <= item < low + cut:
                scores[user, item - low] = -np.inf
        best.add(ids, scores, slack, exact)
    return {u: best.item[best.row == u].tolist() for u in range(people.num_rows)}


def full_sort(left, right, k, masked=()):
    scores = np.round(left @ right.T, tiles.DIGITS)
    return {u: sorted((i for i in range(len(right)) if (u, i) not in masked), key=lambda i: (-scores[u, i], i))[:k] for u in range(len(left))}


def test_float_products_stay_within_their_slack():
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(50, 64)) * 10.0 ** rng.integers(-6, 6, 50)[:, None], rng.normal(size=(300, 64))
    got = tiles.dense_scores(table(left), table(right))
    assert got.scores.dtype == np.float32
    assert (np.abs(got.scores - left @ right.T) <= got.slack[:, None]).all()
    row, at = np.divmod(np.arange(50 * 300), 300)
    assert np.allclose(got.exact(row, at), (left @ right.T).ravel(), rtol=1e-12, atol=1e-12)


def test_lists_tell_apart_what_floats_cannot():
    rng = np.random.default_rng(2)
    left = rng.normal(size=(30, 16))
    # Copies of few vectors, moved by less than a float resolves; exact copies tie by item.
    right = rng.normal(size=(12, 16))[rng.integers(0, 12, 400)] * (1 + rng.integers(0, 5, 400)[:, None] * 1e-8)
    masked = {(u, i) for u in range(0, 30, 2) for i in range(u, 400, 7)}
    assert best_of(table(left), table(right), 9, 64, masked) == full_sort(left, right, 9, masked)
    assert best_of(table(left), table(right), 500, 64) == full_sort(left, right, 500)


def test_numbers_beyond_floats_are_multiplied_as_doubles():
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(5, 4)) * 1e30, rng.normal(size=(40, 4)) * 1e30
    assert best_of(table(left), table(right), 6, 16) == full_sort(left, right, 6)
    right[7, 1] = np.nan  # scores nothing
    assert all(7 not in found and len(found) == 6 for found in best_of(table(left / 1e30), table(right / 1e30), 6, 16).values())


def test_a_block_of_vectors_is_a_few_rows():
    n = 5000
    data = pa.table({"_block": pa.array(np.repeat([3, 4], n // 2), pa.int32()), **dict(zip(["_a", "vector"], table(np.ones((n, 64)), pa.float32()).columns))})
    rows = pa.Table.from_batches(list(tiles.packs(iter(data.to_batches(max_chunksize=700)))))
    assert rows.num_rows <= 4 and rows.column("_block").unique().to_pylist() == [3, 4]
    assert tiles.unpack(rows.column("_pack")).equals(data.drop_columns(["_block"]).combine_chunks())


def test_users_without_id_keep_a_list(spark):
    users = spark.createDataFrame([(None, [1.0, 0.0]), (2**53 + 1, [0.0, 1.0])], "user_id long, vector array<double>")
    items = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "item_id long, vector array<float>")
    seen = spark.createDataFrame([(None, 0), (2**53 + 1, 1)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id, r.rank) for r in tiles.dense_topk(users, items, seen, 1).collect()}
    assert got == {(None, 0, 1), (2**53 + 1, 0, 1)}


def test_places_of_a_mask():
    rng = np.random.default_rng(5)
    for shape in ((3, 5), (4, 8), (1, 1), (7, 33), (2, 0)):
        hit = rng.random(shape) < 0.2
        assert tiles.set_places(hit).tolist() == np.flatnonzero(hit).tolist()
