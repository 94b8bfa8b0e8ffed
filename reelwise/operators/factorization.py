"""Factorisation machine whose gradient is one aggregation over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwise.session import cut_lineage

# Spread of the first factors, and the decays, guard and tolerance of the AdamW steps, as in `pyspark.ml`.
INIT, BETAS, GUARD, CLOSE = 0.01, (0.9, 0.999), 1e-8, 1e-6


@dataclass
class Factorization:
    """A fitted model; `margin` gives its log odds as an expression over the raw columns."""

    columns: list[str]
    lows: np.ndarray
    highs: np.ndarray
    factors: np.ndarray  # columns x factors
    linear: np.ndarray
    intercept: float

    def margin(self) -> Column:
        scaled = [
            (F.col(name).cast("double") - F.lit(float(low))) * F.lit(float(1 / (high - low))) if high > low else F.lit(0.5)
            for name, low, high in zip(self.columns, self.lows, self.highs)
        ]
        dot = lambda weights, values: sum((F.lit(float(w)) * x for w, x in zip(weights, values)), F.lit(0.0))
        crossed = sum((F.pow(dot(line, scaled), F.lit(2.0)) for line in self.factors.T), F.lit(0.0))
        own = dot((self.factors**2).sum(1), [x * x for x in scaled])
        return F.lit(float(self.intercept)) + dot(self.linear, scaled) + F.lit(0.5) * (crossed - own)

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def fit_factors(train: DataFrame, columns: Sequence[str], label: str, factors: int, steps: int, rate: float, seed: int) -> Factorization:
    """Columns scaled to 0..1, then `steps` AdamW steps on the mean logistic loss of a second-order machine.

    Start, updates and the stop at small steps are those of `pyspark.ml`'s FMClassifier, whose weights come out. Each step
    is one pass in which every task sums the gradient over its rows by matrix products; Spark adds the tasks' sums.
    """
    columns = list(columns)
    names = [f"x{i}" for i in range(len(columns))]
    data = cut_lineage(train.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)], F.col(label).cast("double").alias("y")))
    gaps = F.greatest(F.lit(0), *[F.col(n).isNull().cast("int") for n in [*names, "y"]])
    facts = data.agg(F.count("*").alias("n"), F.coalesce(F.sum(gaps), F.lit(0)).alias("gaps"), *[f(n).alias(f"{tag}_{n}") for n in names for tag, f in (("low", F.min), ("high", F.max))]).first()
    if facts.n == 0 or facts.gaps:
        raise ValueError(f"factorisation needs rows without gaps: {facts.n} rows, {facts.gaps} with a gap")
    lows, highs = (np.array([facts[f"{tag}_{n}"] for n in names]) for tag in ("low", "high"))
    draw = train.sparkSession.sparkContext._jvm.java.util.Random(seed)
    width = len(columns) * factors
    theta = np.array([draw.nextGaussian() * INIT for _ in range(width)] + [0.0] * (len(columns) + 1))
    first, second = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, steps + 1):
        slope = gradient(data, theta, lows, highs, factors) / facts.n
        first = BETAS[0] * first + (1 - BETAS[0]) * slope
        second = BETAS[1] * second + (1 - BETAS[1]) * slope * slope
        before = theta
        theta = theta - rate * (first / (1 - BETAS[0] ** step)) / (np.sqrt(second / (1 - BETAS[1] ** step)) + GUARD)
        if step > 1 and np.linalg.norm(theta - before) < CLOSE * max(np.linalg.norm(theta), 1.0):
            break
    return Factorization(columns, lows, highs, theta[:width].reshape(-1, factors), theta[width:-1], float(theta[-1]))


def gradient(data: DataFrame, theta: np.ndarray, lows: np.ndarray, highs: np.ndarray, factors: int) -> np.ndarray:
    """The gradient of the logistic loss summed over all rows: factors by column, linear weights, intercept."""
    n = len(lows)
    spread = highs > lows
    scale = 1 / np.where(spread, highs - lows, 1.0)
    v, linear, intercept = theta[: n * factors].reshape(n, factors), theta[n * factors : -1], theta[-1]
    squares = (v**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(theta))
        for batch in batches:
            raw = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]) if n else np.zeros((batch.num_rows, 0))
            x = np.where(spread, (raw - lows) * scale, 0.5)
            sums, xx = x @ v, x * x
            margin = intercept + x @ linear + 0.5 * ((sums**2).sum(1) - xx @ squares)
            miss = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - batch.column(n).to_numpy(zero_copy_only=False)
            total[: n * factors] += (x.T @ (sums * miss[:, None]) - v * (xx.T @ miss)[:, None]).ravel()
            total[n * factors : -1] += x.T @ miss
            total[-1] += miss.sum()
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

    added = data.mapInArrow(run, "v array<double>").agg(F.array(*[F.sum(F.get("v", F.lit(j))) for j in range(len(theta))]).alias("v"))
    return np.array(added.first().v)
