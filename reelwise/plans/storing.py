"""Queries that write given tables through the sinks into the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.operators.recall import popular_scores, popularity, recommend_ranked
from reelwise.plans.recalling import K
from reelwise.plans.registry import register
from reelwise.plans.sql import query, r6
from reelwise.plans.world import World
from reelwise.session import shared_folder
from reelwise.sources import driver_tables as D
from reelwise.sources import files


def place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "csv_interactions",
    query(
        ["log"],
        f"SELECT user_id, item_id, date, trunc(play_duration)::BIGINT AS play_duration, {r6('watch_ratio')} FROM log WHERE user_id IN (SELECT user_id FROM log WHERE split = 'valid')",
    ),
)
def csv_interactions(spark, folder):
    """The log as raw CSV with its columns in another order and one more, read by name for the users of one split."""
    w = World(spark, folder)
    path = place(spark, "raw")
    raw = w.log.select(
        "watch_ratio", F.col("item_id").alias("video_id"), "date", "split", "user_id", F.col("play_duration").cast("long").alias("play_duration"), "video_duration"
    ).withColumns({"time": F.lit(None).cast("string"), "timestamp": F.lit(None).cast("double")})
    raw.write.option("header", True).csv(path)
    users = w.log.filter("split = 'valid'").select("user_id").distinct()
    out = files.read_interactions(spark, path, users)
    return out.select("user_id", "item_id", F.col("date").cast("int").alias("date"), "play_duration", "watch_ratio")


@register("csv_columns", "SELECT p_partkey, p_size FROM part")
def csv_columns(spark, folder):
    """Two columns of a wider CSV file."""
    path = place(spark, "part")
    part = D.table(spark, folder, "part")
    files.write_summary_csv(part, path)
    return files.read_csv(spark, path, part.schema, "p_partkey", "p_size")


@register("csv_texts", "SELECT doc_id, md5(text) AS digest, length(text)::BIGINT AS chars FROM documents WHERE text <> ''")
def csv_texts(spark, folder):
    """Whole texts with quotes and line breaks through a quoted CSV."""
    path = place(spark, "texts")
    texts = D.table(spark, folder, "documents").filter("text <> ''").select("doc_id", "text")
    writer = texts.write.option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    back = files.read_tolerant_csv(spark, path, schema)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"))


@register("prepared_roundtrip", query(["log"], f"SELECT event_id, user_id, item_id, date, split, label_complete, {r6('watch_ratio')} FROM log"))
def prepared_roundtrip(spark, folder):
    """The prepared log, one folder per split, with its version checked on the way back."""
    path = place(spark, "prepared")
    files.write_prepared(World(spark, folder).log, path, "split")
    return files.read_prepared(spark, path).select("event_id", "user_id", "item_id", "date", "split", "label_complete", "watch_ratio")


@register(
    "ranked_json",
    query(
        ["pop_all", "users", "seen"],
        f"""
SELECT user_id, item_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT u.user_id, s.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(s.score, 9) DESC, s.item_id) AS r
  FROM users u CROSS JOIN pop_all s WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_id = u.user_id AND x.item_id = s.item_id)
) WHERE r <= {K}""",
    ),
)
def ranked_json(spark, folder):
    """Popularity lists as one JSON line per user."""
    w = World(spark, folder)
    path = place(spark, "lists")
    files.write_ranked_json(recommend_ranked(popular_scores(w.train), w.users, w.seen, K), path)
    return files.read_ranked_json(spark, path)


@register(
    "run_records",
    query(
        ["train"],
        """
SELECT 'popularity' AS experiment_id, count(DISTINCT item_id)::BIGINT AS items, NULL::BIGINT AS rows FROM train
UNION ALL SELECT 'log', NULL, count(*)::BIGINT FROM train""",
    ),
)
def run_records(spark, folder):
    """Two records with different columns, appended one after the other."""
    train = World(spark, folder).train
    path = place(spark, "runs")
    files.append_run(popularity(train).agg(F.count("*").alias("items")).withColumn("experiment_id", F.lit("popularity")), path)
    files.append_run(train.agg(F.count("*").alias("rows")).withColumn("experiment_id", F.lit("log")), path)
    return files.read_runs(spark, path).select("experiment_id", "items", "rows")
