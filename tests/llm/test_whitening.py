"""Whitening against a dense eigendecomposition in memory."""

import math

import numpy as np
import pytest

from reelwise.llm.whitening import Centre, fit_whitening, jacobi_davidson, minres, summed, whiten, whole_vectors


def brute(vectors, components):
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    out = [[float(n * a - s) / n for a, s in zip(row, sums)] for row in x]
    deviations = [sum((n * a - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviations, np.array(out) @ basis / np.sqrt(values), values / (centred**2).sum() * n


def turned(a, b):
    """Columns of `a` with the signs of `b`."""
    return a * np.sign((a * b).sum(0))


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, row string, n int").repartition(3)


def test_matches_dense(spark):
    draw = np.random.default_rng(5)
    given = (draw.standard_normal((300, 20)) * np.linspace(4, 0.5, 20)).tolist()
    given += given[:40] + [given[0]] * 200  # copies and one hot vector
    bad = [None, [], [1.0] * 19 + [None], [math.nan] + [1.0] * 19, [math.inf] + [1.0] * 19, [1e300] * 20, [1.0, 2.0]]
    df = frame(spark, given + bad)
    model = fit_whitening(df, components=16)
    n, deviations, wanted, shares = brute(given, 16)
    rows = sorted(whiten(df, model).collect(), key=lambda r: r.vec_id)
    assert [r.vec_id for r in rows] == list(range(len(given)))
    assert {r.n for r in rows} == {n} == {300} and [r.deviation for r in rows] == deviations and {r.row for r in rows} == {"x"}
    got = np.array([r.whitened for r in rows])
    assert np.abs(turned(wanted, got) - got).max() < 1e-9
    assert np.abs(model.values / model.trace - shares).max() < 1e-12 and model.identity_error < 1e-10


def test_no_variance(spark):
    for given in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, []], []):
        df = frame(spark, given)
        model = fit_whitening(df)
        rows = whiten(df, model).collect()
        assert len(rows) == sum(bool(v) for v in given)
        assert all(r.whitened == [] and r.deviation == 0 for r in rows)


def test_few_directions(spark):
    given = [[float(i), 2.0 * i, 5.0] for i in range(9)]
    model = fit_whitening(frame(spark, given))
    assert len(model.values) == 1 and abs(model.values[0] / model.trace - 1) < 1e-12


def test_large_sums(spark):
    centre = Centre(3, [3 * 10**15 + 1])
    assert centre.deviations(np.array([[10**15], [10**15 + 5], [2 * 10**15]])) == [1, (3 * 5 - 1) ** 2, None]
    n, total = summed(whole_vectors(frame(spark, [[1.0, -0.01]] * 4), "embedding"), 2, 1, lambda x: x.sum(0)[:, None], "bigint")
    assert n == 4 and total[:, 0].tolist() == [4 * 1_000_064, 4 * 999_999]


@pytest.mark.parametrize("spectrum", ["clustered", "falling", "equal", "rank"])
def test_iteration(spectrum):
    draw = np.random.default_rng(3)
    width = 400
    basis, _ = np.linalg.qr(draw.standard_normal((width, width)))
    values = {
        "clustered": np.concatenate([10 + 1e-3 * np.arange(8), np.linspace(0, 9, width - 8)]),
        "falling": 1 / np.arange(1, width + 1) ** 2,
        "equal": np.concatenate([np.full(20, 2.0), np.ones(width - 20)]),
        "rank": np.concatenate([np.arange(1, 11), np.zeros(width - 10)]),
    }[spectrum]
    a = basis * values @ basis.T
    passes = []
    got, vectors = jacobi_davidson(lambda b: passes.append(b.shape[1]) or a @ b, width, 16, 1e-12)
    assert np.abs(got - np.sort(values)[::-1][:16]).max() < 1e-10 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(16)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * got).max() < 1e-11 * values.max()


def test_minres():
    draw = np.random.default_rng(4)
    a = draw.standard_normal((12, 12))
    a = a + a.T
    right = draw.standard_normal((12, 3))
    right[:, 1] = 0
    shifts = np.array([0.3, 0.0, -0.2])
    got = minres(lambda v: a @ v - shifts * v, right, 40)
    for j in range(3):
        assert np.abs((a - shifts[j] * np.eye(12)) @ got[:, j] - right[:, j]).max() < 1e-6
