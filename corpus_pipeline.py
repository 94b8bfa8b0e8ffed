"""A cleaning run over `documents`: toxicity, line dedup, near-duplicates, decontamination, tokenization.

Every stage is written and read again before the next one, so a lost executor costs one stage at most. Stages read the columns
of `documents` only; others are dropped, so no name can clash. An empty table stays empty. A null or empty text has no
words, lines or tokens: it shares the toxicity rate of such texts, is no copy and holds no benchmark window, and stays unless
that rate rejects it. Rows given twice are judged alike; rows of one id cannot be told apart by id, so all of them stay or go
together. Ties among copies go to the smallest id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelwise.llm.contamination import contamination
from reelwise.llm.lines import dedup_lines
from reelwise.llm.neardups import near_duplicates
from reelwise.llm.sentencepieces import encode, read_model
from reelwise.llm.toxicity import toxicity
from reelwise.session import shared_folder

TOKENIZER = "piece_bpe_32k.model"
CACHE = 60_000  # small, and dropped with its task, since workers outlive the last stage and serve the next run's stages
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours do not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels).filter("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a larger document id keeps; n_chars follows the text."""
    done = dedup_lines(docs, min_chars=40, min_docs=5)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: the smallest id."""
    done = near_duplicates(docs, shingle=5, percent=80)
    return done.filter("kept").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items, window=10).filter("NOT contaminated").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """Token ids of every remaining document, their number, and whether they decode to the text."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(TOKENIZER)
    coded = encode(docs.select("doc_id", "lang", "source", "text"), read_model(model), cache=CACHE, keep=False)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

# Neighbour votes and the tokenizer have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
