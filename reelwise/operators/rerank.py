"""Rank fusion and diversity reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwise.functions.columns import steady
from reelwise.functions.ordering import group_ranks

KEYS = ("user_id", "date")


def with_rank(df: DataFrame, score: str, out: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add the 1-based position by descending score within the group, ties by item."""
    return group_ranks(df, list(keys), {out: -steady(score)})


def rrf(
    df: DataFrame,
    weights: dict[str, float],
    k: float = 60,
    keys: Sequence[str] = KEYS,
    out: str = "rrf_score",
) -> DataFrame:
    """Reciprocal-rank fusion: sum of weight / (k + rank) over the score columns, all ranked in one pass."""
    df = group_ranks(df, list(keys), {f"{score}_rank": -steady(score) for score in weights})
    fused = sum(
        (F.lit(float(w)) / (F.lit(float(k)) + F.col(f"{score}_rank")) for score, w in weights.items()),
        F.lit(0.0),
    )
    return df.withColumn(out, fused)


def blend_scores(complete: str, strong: str, short: str) -> dict[str, Column]:
    """The three serving blends of the per-label heads (fixed weights)."""
    c, s, q = F.col(complete), F.col(strong), F.col(short)
    return {
        "blend_complete": c,
        "blend_strong": 0.7 * c + 0.3 * s,
        "blend_short": 0.6 * c + 0.3 * s + 0.1 * (1 - q),
    }


def mmr_rerank(
    df: DataFrame,
    score: str,
    out: str = "mmr_score",
    lam: float = 0.9,
    weights: dict[str, float] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Greedy maximal marginal relevance per group; adds `<out>_rank` and `<out>` = 1 / rank.

    Similarity only looks at the attributes in `weights` that `df` has (default first_category 0.6,
    author_id_hash 0.4), so rows with equal attributes form a cell and a cell is used up in relevance
    order. Once its first row is picked, a cell's other rows all have similarity 1. Only the cells'
    first rows therefore need the sequential greedy pass; the pick score of every other row is known,
    and since pick scores never rise the final order is a sort. A group of any size costs the greedy
    pass one entry per distinct cell.
    """
    if not 0.0 <= lam <= 1.0:
        raise ValueError("lam must lie between 0 and 1")
    if score not in df.columns:
        raise KeyError(f"no score column {score}")
    weights = weights or {"first_category": 0.6, "author_id_hash": 0.4}
    used = {name: weight for name, weight in weights.items() if name in df.columns}
    total = sum(used.values())
    keys = list(keys)

    bounds = df.groupBy(*keys).agg(
        F.min(score).alias("_lo"),
        F.max(score).alias("_hi"),
        F.min(F.struct((-F.col(score)).alias("s"), F.col("item_id").alias("i"))).alias("_top"),
    )
    span = F.col("_hi") - F.col("_lo")
    rows = df.join(bounds, keys).withColumn(
        "_rel", F.when(span > 0, (F.col(score) - F.col("_lo")) / span).otherwise(1.0)
    )
    # The group's most relevant row opens its cell; elsewhere the first row is the one with the best
    # weighted relevance, the lowest item on ties (all of them when lam is 0).
    first = F.struct(
        (F.col("item_id") != F.col("_top.i")).alias("t"),
        (-steady(F.lit(lam) * F.col("_rel"), 12)).alias("w"),
        F.col("item_id").alias("i"),
        F.col("_rel").alias("r"),
    )
    cells = rows.groupBy(*keys, *used).agg(F.min(first).alias("_head"))
    heads = F.array_sort(
        F.collect_list(F.struct(F.col("_head.i").alias("i"), F.col("_head.r").alias("r"), *used))
    )

    @F.pandas_udf("array<double>")
    def pick_scores(groups: pd.Series) -> pd.Series:
        return pd.Series([_first_picks(group, used, total, lam) for group in groups], dtype=object)

    gathered = cells.groupBy(*keys).agg(heads.alias("_heads"))
    picked = (
        gathered.withColumn("_picks", pick_scores("_heads"))
        .select(*keys, F.explode(F.arrays_zip("_heads", "_picks")).alias("e"))
        .select(*keys, F.col("e._heads.i").alias("item_id"), F.col("e._picks").alias("_pick"))
    )
    rest = F.lit(lam) * F.col("_rel") - F.lit((1 - lam) * (1.0 if total else 0.0))
    scored = rows.join(picked, [*keys, "item_id"], "left").withColumn(
        "_order", -steady(F.coalesce("_pick", rest), 12)
    )
    columns = df.columns
    return group_ranks(scored.select(*columns, "_order"), keys, {f"{out}_rank": F.col("_order")}).select(
        *columns,
        F.col(f"{out}_rank").cast("int").alias(f"{out}_rank"),
        (1.0 / F.col(f"{out}_rank")).alias(out),
    )


def _first_picks(heads, used: dict[str, float], total: float, lam: float) -> list[float]:
    """Score at which each cell's first row is picked; the very first pick gets infinity.

    Two cells agree on some set of attributes, so similarity to the picked rows takes few values. It never falls, hence
    a queue ordered by possibly outdated values is enough: the front is looked at again and either picked or moved back.
    """
    names = [tuple(s) for size in range(len(used), 0, -1) for s in combinations(used, size)]
    levels = sorted(((sum(used[n] for n in s) / total, s) for s in names), reverse=True) if total else []
    met: list[set] = [set() for _ in levels]
    cells = [[tuple(head[n] for n in s) for _, s in levels] for head in heads]

    def value(j: int) -> float:
        near = next((level for (level, _), seen, own in zip(levels, met, cells[j]) if own in seen), 0.0)
        return lam * heads[j]["r"] - (1 - lam) * near

    def pick(j: int, score: float) -> None:
        picks[j] = score
        for seen, own in zip(met, cells[j]):
            seen.add(own)

    picks = [math.nan] * len(heads)
    front = min(range(len(heads)), key=lambda j: (-round(heads[j]["r"], 12), j))
    pick(front, math.inf)
    queue = [(-round(value(j), 12), j) for j in range(len(heads)) if j != front]
    heapq.heapify(queue)
    while queue:
        shown, j = queue[0]
        now = value(j)
        if -round(now, 12) > shown:
            heapq.heapreplace(queue, (-round(now, 12), j))
        else:
            heapq.heappop(queue)
            pick(j, now)
    return picks


def sweep(
    df: DataFrame, first: str, second: str, grid: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Fused score per grid row (grid_id, w_first, w_second, rrf_k); ranks are computed once.

    `grid` lists run arguments, a handful of rows that are replicated to every candidate.
    """
    ranked = group_ranks(df, list(keys), {"_ra": -steady(first), "_rb": -steady(second)})
    points = grid.agg(F.collect_list(F.struct("grid_id", "w_first", "w_second", "rrf_k"))).scalar()
    return (
        ranked.withColumn("_g", F.explode(points))
        .withColumn("grid_id", F.col("_g.grid_id"))
        .withColumn(
            "score",
            F.col("_g.w_first") / (F.col("_g.rrf_k") + F.col("_ra"))
            + F.col("_g.w_second") / (F.col("_g.rrf_k") + F.col("_rb")),
        )
        .drop("_g", "_ra", "_rb")
    )
