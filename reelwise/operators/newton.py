"""Logistic regression by Newton steps whose gradient and Hessian are one aggregation over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwise.functions.ordering import running_totals
from reelwise.session import cut_lineage

STEPS, CLOSE = 25, 1e-10


@dataclass
class Logistic:
    """A fitted model; `margin` gives its log odds as an expression over the raw columns."""

    columns: list[str]
    medians: np.ndarray
    means: np.ndarray
    spreads: np.ndarray
    weights: np.ndarray
    intercept: float

    def margin(self) -> Column:
        total = F.lit(float(self.intercept))
        for name, median, mean, spread, weight in zip(self.columns, self.medians, self.means, self.spreads, self.weights):
            if spread > 0:
                filled = F.coalesce(F.col(name).cast("double"), F.lit(float(median)))
                total = total + F.lit(float(weight)) * (filled - F.lit(float(mean))) / F.lit(float(spread))
        return total

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def medians_of(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Exact medians of the non-null values over all rows, 0 without any.

    Equal values of a column are counted first; the running counts then tell which values sit in the middle, so no task
    holds a whole column.
    """
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(each)).filter("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("c"))
    upto = running_totals(counts, ["i"], ["v"], {"hi": F.col("c")})
    sizes = upto.groupBy("i").agg(F.max("hi").alias("n"))
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    # One row, or the two on both sides of an even middle.
    middle = upto.join(sizes, "i").filter((F.col("hi") > low) & (F.col("hi") - F.col("c") <= high)).groupBy("i").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    out = np.zeros(len(columns))
    for r in middle.collect():
        out[r.i] = r.a if r.a == r.b else 0.5 * r.a + 0.5 * r.b
    return out


def fit_newton(
    train: DataFrame,
    columns: Sequence[str],
    label: str = "label_complete",
    ridge: float = 1.0,
) -> Logistic:
    """Median imputation, standardisation, and the minimum of ridge / 2 * |w|^2 + class-balanced log loss.

    Each step is one pass in which every task sums gradient and Hessian over its rows; Spark adds the tasks' sums and the
    driver solves a system of one row per feature. The result depends on the rows only, not on their number or partitioning.
    A label with one class gives a constant score.
    """
    columns = list(columns)
    data = cut_lineage(train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y")).filter("y IS NOT NULL"))
    names = [f"x{i}" for i in range(len(columns))]
    medians = medians_of(data, names)
    filled = [F.coalesce(F.col(c), F.lit(float(m))) for c, m in zip(names, medians)]
    facts = data.agg(
        F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("p"),
        *[f(x).alias(f"{tag}{i}") for i, x in enumerate(filled) for tag, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    n, p = facts.n, facts.p
    means = np.array([facts[f"m{i}"] or 0.0 for i in range(len(columns))])
    spreads = np.array([facts[f"s{i}"] or 0.0 for i in range(len(columns))])
    theta = np.zeros(len(columns) + 1)
    if 0 < p < n:
        rows = data.select(*names, "y")
        costs = n / (2 * (n - p)), n / (2 * p)
        penalty = np.append(np.full(len(columns), ridge), 0.0)
        for _ in range(STEPS):
            sums = step_sums(rows, theta, medians, means, spreads, costs)
            step = np.linalg.solve(sums[:, :-1] + np.diag(penalty), sums[:, -1] + penalty * theta)
            theta = theta - step
            if np.abs(step).max() < CLOSE:
                break
    else:
        share = min(max((p + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
        theta[-1] = np.log(share / (1 - share))
    return Logistic(columns, medians, means, spreads, theta[:-1], float(theta[-1]))


def step_sums(rows: DataFrame, theta: np.ndarray, medians: np.ndarray, means: np.ndarray, spreads: np.ndarray, costs: tuple[float, float]) -> np.ndarray:
    """The Hessian of the loss with the gradient as a last column, summed over all rows."""
    width = len(theta)
    scale = np.where(spreads > 0, spreads, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            raw = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(width - 1)]) if width > 1 else np.zeros((batch.num_rows, 0))
            x = np.where(spreads > 0, (np.where(np.isnan(raw), medians, raw) - means) / scale, 0.0)
            x = np.column_stack([x, np.ones(len(x))])
            y = batch.column(width - 1).to_numpy(zero_copy_only=False)
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
            cost = np.where(y == 1, costs[1], costs[0])
            total[:, :-1] += x.T @ (x * (cost * p * (1 - p))[:, None])
            total[:, -1] += x.T @ (cost * (p - y))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total))], names=["line", "v"])

    lines = rows.mapInArrow(run, "line int, v array<double>")
    added = lines.groupBy("line").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(width + 1)]).alias("v")).collect()
    return np.array([r.v for r in sorted(added, key=lambda r: r.line)])
