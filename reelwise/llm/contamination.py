"""Benchmark passages in training documents, found through a positional inverted index.

The documents' tokens are stored once. Their test terms are counted, the rarest terms of every test window get
stored postings (term, document, position), and the lists of a window's two rarest terms, moved by their offsets
in the window, are intersected. Only the starts that survive are compared in full. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.llm.batches import settle
from reelwise.session import cut_lineage

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_ID = -(2**63)


def words_of(text: Column) -> Column:
    """Runs of letters, digits and non-ASCII characters after lowering A-Z only; none for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    small = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, SMALL))
    return F.array_remove(F.split(small, SEPARATORS), "")


def test_windows(items: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """(item, phrase, words): every `window` consecutive words of an item; a shorter item is one window."""
    words = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    cut = words.select("item", "all", F.explode(starts).alias("s")).select("item", F.slice("all", F.col("s") + 1, window).alias("words"))
    return cut.select("item", F.array_join("words", " ").alias("phrase"), "words").distinct()


def stored_tokens(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, row, words) of every document, written once; equal ids are told apart by their text's hash."""
    return cut_lineage(
        docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("row"), words_of(F.col(text)).alias("words"))
    )


def anchored(stored: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every phrase with its two rarest terms and their offsets; terms that no document has come first."""
    placed = phrases.select("phrase", F.posexplode("words").alias("offset", "term"))
    terms = settle(placed.select("term").distinct())
    counts = stored.select(F.explode("words").alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))
    order = W.partitionBy("phrase").orderBy("n", "offset")
    ranked = (
        placed.join(settle(counts), "term", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(order)).filter("rank <= 2")
    )
    pick = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    pairs = ranked.groupBy("phrase").agg(
        pick(1, "term").alias("term1"), pick(1, "offset").alias("offset1"), pick(2, "term").alias("term2"), pick(2, "offset").alias("offset2"),
        F.min("n").alias("least"),
    )
    found = pairs.filter("least > 0").drop("least")
    return settle(
        found.withColumns({"term2": F.coalesce("term2", "term1"), "offset2": F.coalesce("offset2", "offset1")}).join(phrases, "phrase")
    )


def postings(stored: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc, row, pos) of the given terms, written once."""
    listed = stored.select("doc", "row", F.posexplode("words").alias("pos", "term"))
    return cut_lineage(listed.join(terms, "term").select("term", "doc", "row", "pos"))


def phrase_matches(docs: DataFrame, stored: DataFrame, items: DataFrame, window: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(doc, row, phrase, start, length, exact) of all matches, and the items' windows.

    Exact matches hold the window's words in order from `start` on. With `slop` above 0 there are also proximity
    matches: all words of the window, in any order, among the `length + slop` words before and after its rarest term.
    """
    cut = settle(test_windows(items, window, item, "text"))
    phrases = cut.select("phrase", "words").distinct()
    anchors = anchored(stored, phrases)
    terms = settle(anchors.select(F.col("term1").alias("term")).unionByName(anchors.select(F.col("term2").alias("term"))).distinct())
    index = postings(stored, terms)
    first = index.join(anchors, index["term"] == anchors["term1"]).select(
        "doc", "row", "phrase", (F.col("pos") - F.col("offset1")).alias("start"), "term2", "offset2", "pos", "words"
    )
    second = index.select(F.col("term").alias("term2"), "doc", "row", F.col("pos").alias("pos2"))
    both = first.filter("start >= 0").withColumn("pos2", F.col("start") + F.col("offset2")).join(second, ["term2", "doc", "row", "pos2"])
    found = both.select("doc", "row", "phrase", "start", "words", F.lit(True).alias("exact"))
    if slop:
        near = first.select("doc", "row", "phrase", F.col("pos").alias("start"), "words", F.lit(False).alias("exact"))
        found = found.unionByName(near)
    found = settle(found.distinct())
    texts = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    whole = texts.join(found.select("doc", "row").distinct(), ["doc", "row"]).select("doc", "row", words_of(F.col("text")).alias("all"))
    size = F.size("words")
    low = F.greatest(F.col("start") - size - slop, F.lit(0))
    around = F.slice("all", low + 1, F.col("start") + size + slop - low)
    holds = F.when(F.col("exact"), F.slice("all", F.col("start") + 1, size) == F.col("words")).otherwise(F.size(F.array_except("words", around)) == 0)
    matches = whole.join(found, ["doc", "row"]).filter(holds)
    return settle(matches.select("doc", "row", "phrase", "start", size.alias("length"), "exact").distinct()), cut


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Add `n_words`, `n_hit`, `n_items` (long), `items` (sorted ids as strings) and `contaminated` (n_hit > 0).

    A test window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. A
    document word inside any exact occurrence of a window is hit. Words are read after lowering A-Z. Null and blank
    texts have no words and no hits; items without words match nothing; an item with a null id hits words but is not
    listed. Every document row stays, repeated rows too; long texts are read whole; columns with the added names are
    replaced; empty documents or items give no hits.
    """
    added = ("n_words", "n_hit", "n_items", "items", "contaminated")
    own = [f.name for f in docs.schema.fields if f.name not in added]
    quoted = [F.col("`" + name.replace("`", "``") + "`") for name in own]
    items = items.select(F.col(item).alias("item_id"), F.col(text).alias("text"))
    stored = stored_tokens(docs, doc, text)
    matches, cut = phrase_matches(docs, stored, items, window, doc, text, "item_id")
    places = matches.select("doc", "row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    hit = places.groupBy("doc", "row").agg(F.count("*").alias("n_hit"))
    held = matches.select("doc", "row", "phrase").distinct().join(cut.select("phrase", "item"), "phrase").select("doc", "row", "item").distinct()
    listed = held.groupBy("doc", "row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    n_words = stored.select("doc", "row", F.size("words").cast("long").alias("n_words"))
    facts = n_words.dropDuplicates(["doc", "row"]).join(hit, ["doc", "row"], "left").join(listed, ["doc", "row"], "left")
    rows = docs.select(
        *[c.alias(f"c{i}") for i, c in enumerate(quoted)], F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.col(text)).alias("row")
    )
    none = F.array().cast("array<string>")
    return rows.join(facts, ["doc", "row"]).select(
        *[F.col(f"c{i}").alias(name) for i, name in enumerate(own)],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
