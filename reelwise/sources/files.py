"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise import schema as S
from reelwise.operators.ranked import from_lists, to_lists


def read_csv(spark: SparkSession, path: str, schema: T.StructType, *columns: str) -> DataFrame:
    """CSV with a declared schema; only the asked columns are parsed."""
    # The header decides which file column feeds which schema column.
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return df.select(*columns) if columns else df


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose file may have more columns, or another order, than the declared schema."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        *[F.expr(f"try_cast(`{field.name}` as {field.dataType.simpleString()})").alias(field.name) for field in schema]
    )


def read_tolerant_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with quoted multi-line texts; malformed records are skipped."""
    return (
        spark.read.option("header", True)
        .option("mode", "DROPMALFORMED")
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("maxCharsPerColumn", -1)
        .schema(schema)
        .csv(path)
    )


def read_interactions(spark: SparkSession, path: str, users: DataFrame | None = None) -> DataFrame:
    """Raw log rows, of the given users only; the file's item column becomes `item_id`."""
    raw = read_csv_by_name(spark, path, S.RAW_LOG).withColumnRenamed("video_id", "item_id")
    return raw if users is None else raw.join(users.select("user_id"), "user_id", "left_semi")


def write_prepared(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet with the prepared version in every row, optionally one folder per `partition` value."""
    writer = df.withColumn("prepared_version", F.lit(S.PREPARED_VERSION)).write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_prepared(spark: SparkSession, path: str, version: int = S.PREPARED_VERSION) -> DataFrame:
    """Prepared parquet; rows of another version fail the read when they are reached."""
    df = spark.read.parquet(path)
    if "prepared_version" not in df.columns:
        raise ValueError(f"{path} has no prepared_version; prepare it again")
    stale = F.raise_error(F.lit(f"stale prepared data in {path}; prepare it again")).cast("boolean")
    fresh = F.when(F.col("prepared_version") == version, True).otherwise(stale)
    return df.filter(fresh).drop("prepared_version")


def write_summary_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_ranked_json(ranked: DataFrame, path: str) -> None:
    """One JSON line per user: {"user_id": u, "items": [best, ...]}."""
    to_lists(ranked).write.mode("overwrite").json(path)


def read_ranked_json(spark: SparkSession, path: str) -> DataFrame:
    return from_lists(spark.read.schema("user_id long, items array<bigint>").json(path))


def append_run(df: DataFrame, path: str, version: int = S.RUN_RECORD_VERSION) -> None:
    """Add run records with their schema version; earlier records are never rewritten."""
    stamped = df.withColumns(
        {
            "schema_version": F.lit(version),
            "run_id": F.concat_ws("_", F.date_format(F.current_timestamp(), "yyyyMMdd'T'HHmmss"), F.substring(F.uuid(), 1, 8)),
            "created_at_utc": F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
        }
    )
    stamped.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str, version: int = S.RUN_RECORD_VERSION) -> DataFrame:
    """Records of the current version; columns a record lacks are NULL."""
    runs = spark.read.option("mergeSchema", True).parquet(path)
    return runs.filter(F.col("schema_version") == version)
