"""Connected components of a pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwise.llm.batches import settle


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected pairs (a, b); the component is its smallest node.

    Alternates two steps until nothing changes. First every node sends its larger neighbours to its
    smallest one, then every node sends all its smaller neighbours to the smallest; both keep
    connectivity, and in the end every node points at its component. Each round is one aggregation per
    step and is written to the shared folder; no component is ever gathered in a task. Self pairs,
    repeated pairs and empty tables are fine.
    """
    edges = settle(pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small_least, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            small_least.select("a", F.col("m").alias("b"))
        )
        edges = settle(small.filter("a <> b").distinct())
        # A fixed point is a set of stars; its edge count and sums then stay the same.
        state = edges.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
