"""The registered queries and, where SQL can say it, their reference answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelwise.plans.world import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: rounded(build(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep
