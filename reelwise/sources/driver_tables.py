"""Projections of the benchmark parquet tables onto the engine's tables.

`events` is the main interaction log, `orders` joined with `lineitem` a larger one, `part` the item
dimension, `customer` the user dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwise.functions.columns import split_of, with_labels

# Date splits of the two logs (see SURVEY 7.2) and an early split that leaves part of
# the items unseen in training.
EVENT_TRAIN_END, EVENT_VALID_END = 20240120, 20240125
ORDER_TRAIN_END, ORDER_VALID_END = 19991231, 20001231
EARLY_TRAIN_END, EARLY_VALID_END = 19950630, 19951231
CATALOG_OPENED = 20240101


# Declared schemas: reading needs no job to look into the files first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def day_number(ts: str):
    return F.date_format(ts, "yyyyMMdd").cast("int")


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event; the item is the number inside `props`."""
    durations = table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), (200 * F.col("p_size")).alias("video_duration")
    )
    rows = table(spark, folder, "events").select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        day_number("ts").alias("date"),
        F.col("ts").alias("timestamp"),
        (F.col("value") / 50).alias("watch_ratio"),
        (100 * F.col("value")).alias("play_duration"),
    )
    log = with_labels(rows.join(durations, "item_id", "left"))
    return log.withColumn("split", split_of(F.col("date"), EVENT_TRAIN_END, EVENT_VALID_END))


def orders_log(
    spark: SparkSession, folder: str, train_end: int = ORDER_TRAIN_END, valid_end: int = ORDER_VALID_END
) -> DataFrame:
    """One row per customer, part and ship day, with the largest quantity of the day."""
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.col("l_partkey").alias("item_id"),
        day_number("l_shipdate").alias("date"),
        "l_quantity",
    )
    durations = table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"), (200 * F.col("p_size")).alias("video_duration")
    )
    rows = (
        lines.join(orders, "o_orderkey")
        .groupBy("user_id", "item_id", "date")
        .agg(F.max("l_quantity").alias("_q"))
        .join(durations, "item_id", "left")
        .select(
            F.col("item_id").alias("event_id"),
            "user_id",
            "item_id",
            "date",
            F.col("date").alias("timestamp"),
            (F.col("_q") / 20).alias("watch_ratio"),
            (100 * F.col("_q")).alias("play_duration"),
            "video_duration",
        )
    )
    return with_labels(rows).withColumn("split", split_of(F.col("date"), train_end, valid_end))


def part_items(spark: SparkSession, folder: str, log: DataFrame, opened: int | None = CATALOG_OPENED) -> DataFrame:
    """Item dimension; parts missing from the log were listed when the catalog `opened`."""
    first = log.groupBy("item_id").agg(F.min("date").alias("_first"))
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    items = table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        brand.alias("first_category"),
        F.col("p_size").cast("long").alias("author_id"),
        (200.0 * F.col("p_size")).alias("video_duration"),
        F.concat_ws(" ", "p_name", "p_type").alias("content_text"),
    )
    seen = F.col("_first") if opened is None else F.coalesce("_first", F.lit(opened))
    return items.join(first, "item_id", "left").withColumn("first_seen_date", seen).drop("_first")


def part_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The item columns that text recall reads; nothing of the log."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("first_category"),
        F.concat_ws(" ", "p_name", "p_type").alias("content_text"),
    )


def document_items(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts as item texts."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("text").alias("content_text")
    )


def embedding_items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
    )


def customer_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """User dimension with the profile columns of the feature recall."""
    c = table(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        (F.col("c_acctbal") < 0).cast("double").alias("is_lowactive_period"),
        F.lit(0.0).alias("is_live_streamer"),
        (F.col("c_nationkey") == 0).cast("double").alias("is_video_author"),
        F.col("c_nationkey").cast("double").alias("follow_user_num"),
        F.col("c_acctbal").alias("fans_user_num"),
        F.lit(0.0).alias("friend_user_num"),
        F.col("c_custkey").cast("double").alias("register_days"),
        F.col("c_mktsegment").alias("user_active_degree"),
    )
