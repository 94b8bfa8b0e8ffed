"""Ranks, running totals and quantiles that stay distributed when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.session import cut_lineage

# Spark reduces `row_number() <= n` to n rows per map task before the shuffle, but only below its
# default windowGroupLimitThreshold. Larger n get an explicit first round on salted sub-groups.
GROUP_LIMIT = 1000
SALTS = 32
# Rows a bucket of a running total should hold; inputs up to this size need no buckets.
BUCKET_ROWS = 250_000


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First `n` rows of every group, with their 1-based position. `order` must end in a unique key."""
    if n >= GROUP_LIMIT and keys:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        inner = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_pos", F.row_number().over(inner))
            .filter(F.col("_pos") <= n)
            .drop("_salt", "_pos")
        )
    position = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position).filter(F.col(rank) <= n)


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    bucket: Column | None = None,
    settle: bool = True,
) -> DataFrame:
    """Inclusive running sums within `keys` in ascending `order` without one task per group.

    Rows are range-partitioned by (keys, order) into as many buckets as the row count asks for. A running sum inside
    each (keys, bucket) plus the total of the group's earlier buckets gives the exact result, so a group with a third
    of all rows is spread over many tasks, and their number grows with the data. Up to BUCKET_ROWS rows a plain window
    gives the same. A caller that orders by dense integers can pass its own monotone `bucket`. (keys, order) should be
    unique.

    The input is read more than once, so it is written first unless `settle` is off, which suits a frame that comes
    straight from a table.
    """
    if settle:
        df = cut_lineage(df)
    if bucket is None:
        rows = df.count()
        if rows <= BUCKET_ROWS:
            upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
            return df.withColumns({name: F.sum(expr).over(upto) for name, expr in sums.items()})
        cut = df.repartitionByRange(-(-rows // BUCKET_ROWS), *keys, *order)
        marked = cut_lineage(cut.withColumn("_bucket", F.spark_partition_id()))
        bucket = F.col("_bucket")
    else:
        marked = df
    values = {f"_v_{name}": expr for name, expr in sums.items()}
    marked = marked.withColumns({"_bucket": bucket, **values})
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "_bucket")
        .agg(*[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums])
        .select(
            *[F.col(key).alias(f"_k_{key}") for key in keys],
            F.col("_bucket").alias("_b"),
            *[
                F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
                for name in sums
            ],
        )
    )
    match = F.col("_bucket") == F.col("_b")
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    running = marked.withColumns(
        {f"_r_{name}": F.sum(f"_v_{name}").over(inside) for name in sums}
    ).join(offsets, match, "inner")
    return running.select(
        *df.columns, *[(F.col(f"_r_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums]
    )


def ordinal(
    df: DataFrame,
    order: list[str],
    name: str = "ordinal",
    keys: list[str] | None = None,
    settle: bool = True,
) -> DataFrame:
    """Exact 1-based position in ascending `order`, over the whole frame or within `keys`."""
    return running_totals(df, keys or [], order, {name: F.lit(1).cast("long")}, settle=settle)


def group_ranks(df: DataFrame, keys: list[str], orders: dict[str, Column], unique: str = "item_id") -> DataFrame:
    """Add one 1-based position per entry of `orders` (name to ascending order value) within `keys`, ties by `unique`.

    One small count per group tells how large groups get. While they stay within BUCKET_ROWS rows all positions come from
    windows over one shuffle by `keys`, and nothing is written. Larger groups are ranked by buckets on a narrow copy that
    holds only keys, `unique` and the order values; the positions are joined back, so the other columns are never
    written. (keys, unique) identify a row.
    """
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= BUCKET_ROWS:
        return df.withColumns({name: F.row_number().over(W.partitionBy(*keys).orderBy(order, F.asc(unique))) for name, order in orders.items()})
    narrow = cut_lineage(df.select(*keys, unique, *[order.alias(f"_o{i}") for i, order in enumerate(orders.values())]))
    for i, name in enumerate(orders):
        ranks = ordinal(narrow.select(*keys, unique, f"_o{i}"), [f"_o{i}", unique], name, keys, settle=False)
        df = df.join(ranks.select(*keys, unique, name), [*keys, unique])
    return df


def smallest(df: DataFrame, order: list[str], n: Column) -> DataFrame:
    """The `n` rows that come first in ascending `order`; `n` may be a scalar subquery and large."""
    return ordinal(df, order, "_ord").filter(F.col("_ord") <= n).drop("_ord")


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row with exact, linearly interpolated quantiles of the non-null values.

    Equal values are counted first; the cumulative count then tells which value sits at each rank, so
    no task ever holds the whole column.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranked = running_totals(counts, [], ["v"], {"hi": F.col("c")})
    total = df.agg(F.count(value)).scalar()
    picks = []
    for name, q in probabilities.items():
        position = (total - 1) * F.lit(q)
        low = F.floor(position)
        for side, index in (("l", low), ("h", F.ceil(position))):
            inside = (F.col("hi") - F.col("c") <= index) & (index < F.col("hi"))
            picks.append(F.max(F.when(inside, F.col("v"))).alias(f"{name}_{side}"))
        picks.append(F.max(position - low).alias(f"{name}_f"))
    return ranked.agg(*picks).select(
        *[
            (F.col(f"{name}_l") + (F.col(f"{name}_h") - F.col(f"{name}_l")) * F.col(f"{name}_f")).alias(name)
            for name in probabilities
        ]
    )
