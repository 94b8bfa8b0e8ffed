"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson iteration.

The covariance matrix is never formed: every step needs only products of it with a few vectors, and such a product is one
pass over the vectors in which each task centres its rows, multiplies, and returns dimension x block partial sums. The
driver holds a search space of a few dozen vectors. For every eigenpair that has not converged, the correction equation,
projected against the locked and the current vectors, is solved roughly by a few MINRES steps; the steps of all pairs
share their passes. A Rayleigh-Ritz step in the widened space follows, and pairs whose residual has reached double
precision are locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**46  # entries of this size or more have no exact whole-number form and count as not finite
INNER = 5  # MINRES steps per correction
ROUNDS = 200


@dataclass
class Centre:
    """Count and sums of the fit list; whole numbers, so rows are centred without rounding before the division."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], float) / self.n
        return (x - whole) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2 by row, exactly; None beyond the range of a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        moved = x - whole
        most = (int(np.abs(moved).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 2**63:
            d = moved * self.n - np.array(rest, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, rest)) for row in moved]
        return [v if v < 2**63 else None for v in exact]


@dataclass
class Whitening:
    """A fitted whitening: eigenvalues by falling size, unit eigenvectors as columns, and the trace of the covariance."""

    width: int
    centre: Centre | None
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Add `_x`, the vector as whole numbers, and drop rows whose vector is null, empty, or has a null or non-finite entry."""
    given = F.col("`" + vector.replace("`", "``") + "`").cast("array<double>")
    good = F.forall(given, lambda c: F.coalesce((F.abs(c) < LARGEST) & ~F.isnan(c), F.lit(False)))
    kept = df.filter(F.coalesce(good & (F.size(given) > 0), F.lit(False)))
    return kept.withColumn("_x", F.transform(given, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT)))


def summed(fit: DataFrame, width: int, columns: int, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> tuple[int, np.ndarray]:
    """(rows, sum over the fit list of `part`), where `part` maps a block of rows to a matrix with `columns` columns.

    Every task returns its own sums, one row per line of the matrix, and Spark adds them up.
    """
    number = np.int64 if kind == "bigint" else float

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), width)
                total, n = part(x) if total is None else total + part(x), n + len(x)
        if total is not None:
            lines = pa.array(np.arange(len(total), dtype=np.int32))
            values = pa.array(list(total.astype(number)), pa.list_(pa.int64() if kind == "bigint" else pa.float64()))
            yield pa.RecordBatch.from_arrays([lines, pa.array(np.full(len(total), n)), values], names=["line", "n", "v"])

    partial = fit.select("_x").mapInArrow(run, f"line int, n bigint, v array<{kind}>")
    added = partial.groupBy("line").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(columns)]).alias("v"))
    rows = sorted(added.collect(), key=lambda r: r.line)
    return (rows[0].n, np.array([r.v for r in rows], object if kind == "bigint" else float)) if rows else (0, np.zeros((0, columns)))


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `block` adds to the orthonormal columns `against`."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        v = column / size
        for _ in range(3):  # repeated, since one pass leaves rounding behind
            v = v - against @ (against.T @ v)
            v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of symmetric systems, one per column; `product` applies every column's own operator at once."""
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    scale = np.where(live, beta, 1.0)
    v, v_old = right / scale, np.zeros_like(right)
    w, w_old = np.zeros_like(right), np.zeros_like(right)
    out, eta = np.zeros_like(right), beta.copy()
    c, c_old = np.ones(len(beta)), np.ones(len(beta))
    s, s_old = np.zeros(len(beta)), np.zeros(len(beta))
    beta_now = np.zeros(len(beta))
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta_now * v_old
        beta_next = np.linalg.norm(p, axis=0)
        # Rotations of the tridiagonal matrix's new column.
        delta = c * alpha - c_old * s * beta_now
        rho2, rho3 = s * alpha + c_old * c * beta_now, s_old * beta_now
        rho1 = np.hypot(delta, beta_next)
        live = live & (rho1 > 1e-300)
        safe = np.where(live, rho1, 1.0)
        c_old, s_old, c, s = c, s, np.where(live, delta / safe, 1.0), np.where(live, beta_next / safe, 0.0)
        w, w_old = (v - rho3 * w_old - rho2 * w) / safe, w
        out = out + np.where(live, c * eta, 0.0) * w
        eta = np.where(live, -s * eta, 0.0)
        live = live & (beta_next > 1e-14 * scale)
        if not live.any():
            break
        v, v_old, beta_now = p / np.where(live, beta_next, 1.0) * live, v, np.where(live, beta_next, 0.0)
    return out


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, tolerance: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues and eigenvectors of a symmetric positive semidefinite operator.

    `product` multiplies the operator with the columns of a matrix. A pair is locked once its residual is at most
    `tolerance` times the largest Ritz value.
    """
    most = min(width, 6 * wanted)
    locked, values = np.zeros((width, 0)), np.zeros(0)
    space = orthonormal(np.random.default_rng(seed).standard_normal((width, wanted)), locked)
    image = product(space)
    largest = 0.0
    for _ in range(ROUNDS):
        # Rayleigh-Ritz in what is not locked yet.
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        largest = max(largest, theta[0], values.max(initial=0))
        need = min(wanted - len(values), len(theta))
        rest = image[:, :need] - theta[:need] * space[:, :need]
        done = np.linalg.norm(rest, axis=0) <= tolerance * max(largest, 1e-300)
        # A pair may be locked only if all larger ones are: a missing one could still appear between them.
        count = need if done.all() else int(np.argmin(done))
        locked, values = np.column_stack([locked, space[:, :count]]), np.append(values, theta[:count])
        space, image, theta, rest = space[:, count:], image[:, count:], theta[count:], rest[:, count:]
        if len(values) >= wanted or locked.shape[1] + space.shape[1] == 0:
            break
        if space.shape[1] + rest.shape[1] > most - locked.shape[1] and most < width:
            keep = max(rest.shape[1], min(2 * rest.shape[1], space.shape[1]))
            space, image = space[:, :keep], image[:, :keep]
        near, shifts = np.column_stack([locked, space[:, : rest.shape[1]]]), theta[: rest.shape[1]]

        def outside(v: np.ndarray) -> np.ndarray:
            return v - near @ (near.T @ v)

        def correction(v: np.ndarray) -> np.ndarray:
            v = outside(v)
            return outside(product(v) - shifts * v)

        steps = minres(correction, -outside(rest), INNER)
        fresh = orthonormal(np.column_stack([outside(steps), rest]), np.column_stack([locked, space]))[:, : max(1, rest.shape[1])]
        if not fresh.shape[1]:
            # The space is the whole of what is left (or invariant): what rounding leaves is the residual.
            if locked.shape[1] + space.shape[1] >= width:
                need = wanted - len(values)
                locked, values = np.column_stack([locked, space[:, :need]]), np.append(values, theta[:need])
                break
            fresh = orthonormal(np.random.default_rng(seed + space.shape[1]).standard_normal((width, 2)), np.column_stack([locked, space]))
        space, image = np.column_stack([space, fresh]), np.column_stack([image, product(fresh)])
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening:
    """Fit on the distinct whole-number vectors of `df`; see `whiten` for which rows count."""
    rows = whole_vectors(df, vector)
    widths = rows.groupBy(F.size("_x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    nothing = np.zeros(0)
    if not widths:
        return Whitening(0, None, nothing, np.zeros((0, 0)), 0.0, 0.0, 0)
    width = widths[0].width
    fit = cut_lineage(rows.filter(F.size("_x") == width).select("_x").distinct())
    n, sums = summed(fit, width, 1, lambda x: x.sum(0)[:, None], "bigint")
    centre = Centre(n, [int(v) for v in sums[:, 0]])
    _, squares = summed(fit, width, 1, lambda x: (centre.centred(x) ** 2).sum(0)[:, None])
    trace = float(squares.sum() / n)
    passes = 2

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return summed(fit, width, block.shape[1], part)[1] / n

    if not trace > 0:
        return Whitening(width, centre, nothing, np.zeros((width, 0)), trace, 0.0, passes)
    eps = float(np.finfo(float).eps)
    values, vectors = jacobi_davidson(product, width, min(components, width), 8 * max(width, 16) * eps)
    real = values > max(width, 16) * eps * values[0]  # directions in which the fit list does not vary cannot be whitened
    values, vectors = values[real], vectors[:, real]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1.0, 1.0)
    done = Whitening(width, centre, values, vectors, trace, 0.0, passes + 1)

    def square(x: np.ndarray) -> np.ndarray:
        z = done.project(x)
        return z.T @ z

    done.identity_error = float(np.abs(summed(fit, width, len(values), square)[1] / n - np.eye(len(values))).max())
    return done


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Add `n` (size of the fit list), `deviation` and `whitened` (array<double>, one value per component).

    Rows whose vector is null or empty, or holds a null, NaN or infinite entry (2^46 or more counts as infinite), or has
    another length than most vectors (of equally frequent lengths the longest counts), are dropped; every other row stays, repeated rows too,
    and whatever its id is. Each entry c becomes floor(64 * c) + 1000000. `deviation` is the exact sum over dimensions of
    (n * x - S)^2, null beyond the range of a long. Directions without any variance have no component, so equal vectors
    only, or one vector, give an empty array. Columns with the added names are replaced; an empty table gives an empty one.
    """
    added = ("n", "deviation", "whitened")
    own = [f.name for f in df.schema.fields if f.name not in added]
    quoted = [F.col("`" + name.replace("`", "``") + "`") for name in own]
    rows = whole_vectors(df, vector).filter(F.size("_x") == model.width)
    base = rows.select(F.struct(F.lit(0).alias("_"), *[c.alias(f"c{i}") for i, c in enumerate(quoted)]).alias("row"), "_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("_x"), model.width)
                n = pa.array(np.full(len(x), model.centre.n, np.int64))
                flat = pa.array(np.ascontiguousarray(model.project(x)).ravel())
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(model.values))
                whitened = pa.ListArray.from_arrays(ends, flat)
                yield pa.RecordBatch.from_arrays([batch.column("row"), n, pa.array(model.centre.deviations(x), pa.int64()), whitened], names=["row", *added])

    fields = [T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    done = base.mapInArrow(run, T.StructType([base.schema["row"], *fields]))
    return done.select(*[F.col(f"row.c{i}").alias(name) for i, name in enumerate(own)], *added)
