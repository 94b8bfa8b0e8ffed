"""Shared pieces of the registered queries."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.operators.evaluate import ground_truth
from reelwise.operators.ranked import seen_pairs
from reelwise.session import cut_lineage
from reelwise.sources import driver_tables as D


def stored(w: World, name: str, build) -> DataFrame:
    """A written stage result (channel lists, candidate frame) of one run; several stages read it again."""
    if name not in w.stages:
        w.stages[name] = cut_lineage(build())
    return w.stages[name]


class World:
    """The log, items, history and truth one query works on, built from one folder of tables.

    A prepared world writes each of these frames once, when it is first asked for: several stages read them again.
    """

    def __init__(self, spark: SparkSession, folder: str, kind: str = "events", prepared: bool = False):
        self.spark, self.folder, self.kind, self.prepared = spark, folder, kind, prepared
        self.stages: dict[str, DataFrame] = {}
        if kind == "events":
            self.log, self.opened = D.events_log(spark, folder), D.CATALOG_OPENED
        elif kind == "orders":
            self.log, self.opened = D.orders_log(spark, folder), None
        else:
            self.log, self.opened = D.orders_log(spark, folder, D.EARLY_TRAIN_END, D.EARLY_VALID_END), None
        if prepared or kind != "events":
            # A log that is read several times is prepared once, like any log that goes through the preparation stage.
            self.log = cut_lineage(self.log)
        self.train = self.log.filter(F.col("split") == "train")

    def _kept(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.prepared else df

    @cached_property
    def items(self) -> DataFrame:
        return self._kept(D.part_items(self.spark, self.folder, self.log, self.opened))

    @cached_property
    def seen(self) -> DataFrame:
        return self._kept(seen_pairs(self.log))

    @cached_property
    def truth(self) -> DataFrame:
        return self._kept(ground_truth(self.log, "test", exclude=self.seen))

    @cached_property
    def users(self) -> DataFrame:
        return self._kept(self.log.select("user_id").distinct())

    def table(self, name: str) -> DataFrame:
        return D.table(self.spark, self.folder, name)


# Means of decimal inputs often end in an exact half at the 7th digit, where sums of doubles added in
# another order would round apart. The nudge moves such values off the edge, in both engines.
NUDGE = 1.7e-10


def rounded(df: DataFrame) -> DataFrame:
    """Doubles and floats to 6 digits, without negative zero."""
    return df.select(
        *[
            (F.round(F.col(f.name).cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )
