"""Bounded, deterministic samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit(""))), F.lit(divisor)).cast("int")


def sample_labels(labels: DataFrame, label: str, max_rows: int, keep: Column, doc: str = "doc_id") -> DataFrame:
    """At most `max_rows` (doc_id, label) rows that meet `keep`, those with the smallest id hashes; one row per id.

    An id labelled twice takes the larger label. Null ids and null labels are no labels.
    """
    one = labels.select(F.col(doc).alias("doc_id"), F.col(label).alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL").filter(keep)
    return one.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
