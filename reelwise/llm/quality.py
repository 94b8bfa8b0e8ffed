"""Quality rules and hashed n-gram importance weights, with DataFrame functions only.

A document's score is the mean log-likelihood ratio of its hashed n-grams (every word, the last three characters of
every word, and every pair of neighbouring words) under two multinomials: one of trusted documents, one of the whole
corpus. A threshold learned from labelled rows decides every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.llm.batches import settle

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
BUCKETS = 1 << 15
SMOOTHING = 10.0  # counts added on both sides, in proportion to the raw corpus: rare buckets stay near 0
BIN = 500  # threshold candidates per unit of score
NO_ID = -(2**63)


def base_counts(df: DataFrame, text: str = "_text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a non-null text column; `_words` holds its words, `_hash` their hashes."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(F.col(text), SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    four = "transform(_hash, (x, i) -> xxhash64(x, get(_hash, i + 1), get(_hash, i + 2), get(_hash, i + 3)))"
    df = df.withColumn("_h", F.expr(f"slice({four}, 1, greatest(size(_hash) - 3, 0))"))
    eight = "slice(transform(_h, (x, i) -> xxhash64(x, get(_h, i + 4))), 1, greatest(size(_h) - 4, 0))"
    # The second of two equal 8-word windows repeats five 4-word windows, which few texts do.
    some = F.size("_h") - F.size(F.array_distinct("_h")) >= 5
    return df.withColumn("n_repeat_words", F.when(some, repeated(eight, 8)).otherwise(F.lit(0).cast("long"))).drop("_h")


def repeated(hashes: str, length: int) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array of window hashes."""
    # Sorted (hash, start) pairs put equal windows side by side.
    ordered = f"sort_array(transform({hashes}, (h, i) -> struct(h, i)))"
    starts = (
        f"transform(array({ordered}), s -> array_sort(filter(transform(s, (x, k) -> "
        "if(coalesce(get(s, k - 1).h = x.h, false) OR coalesce(get(s, k + 1).h = x.h, false), x.i, NULL)), x -> x IS NOT NULL)))[0]"
    )
    return F.expr(
        f"aggregate(transform(array({starts}), r -> zip_with(r, slice(r, 2, size(r)), (a, b) -> "
        f"CAST(least({length}, coalesce(b - a, {length})) AS BIGINT)))[0], 0L, (t, x) -> t + x)"
    )


def with_words(docs: DataFrame) -> DataFrame:
    """Add `_words` and `_hash`, the words of `_text` and their hashes."""
    words = F.array_remove(F.split("_text", BLANKS), "")
    return docs.withColumn("_words", words).withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))


WORD = f"CAST(pmod(x, {BUCKETS}) AS INT)"  # buckets of a word hash x,
ENDING = f"CAST(pmod(xxhash64(3, substring(w, -3)), {BUCKETS}) AS INT)"  # of the ending of a word w
PAIR = f"CAST(pmod(xxhash64(x, get(_hash, i + 1)), {BUCKETS}) AS INT)"  # and of the words i and i + 1


def weights(docs: DataFrame, trusted: DataFrame, may: Column) -> DataFrame:
    """One row with the log ratio of every bucket; counts cover every document, of which those that meet `may` can be trusted."""
    may = F.coalesce(may, F.lit(False))
    flags = trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_t")).hint("shuffle_hash")
    # Only texts that can be trusted are shuffled to their labels.
    texts = docs.select("_doc", "_text")
    met = texts.filter(may).join(flags, F.col("_doc") == F.col("_id"), "left").select("_text", "_t")
    flagged = met.unionByName(texts.filter(~may).select("_text", F.lit(None).cast("int").alias("_t")))
    pairs = f"slice(transform(_hash, (x, i) -> {PAIR}), 1, greatest(size(_hash) - 1, 0))"
    grams = F.expr(f"concat(transform(_hash, x -> {WORD}), transform(_words, w -> {ENDING}), {pairs})")
    counts = with_words(flagged).select(F.explode(grams).alias("bucket"), "_t").groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_t").alias("good"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    total = settle(every)
    good, raw = (total.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n")).scalar() for c in ("good", "raw"))
    expected = F.col("raw") * good / F.nullif(raw, F.lit(0))
    ratio = total.select("bucket", F.coalesce(F.log((F.col("good") + SMOOTHING) / (expected + SMOOTHING)), F.lit(0.0)).alias("w"))
    return settle(ratio.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))), lambda x: x["w"]).alias("table")))


def scored(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Add `score`, the mean log ratio over the n-grams of `_words`, 0 without any; drops `_words` and `_hash`."""
    # Words and pairs in one pass; the last word has no pair.
    each = f"transform(_hash, (x, i) -> _table[{WORD}] + if(i + 1 < size(_hash), _table[{PAIR}], 0D))"
    total = F.expr(f"aggregate({each}, 0D, (t, x) -> t + x) + aggregate(_words, 0D, (t, w) -> t + _table[{ENDING}])")
    score = F.when(F.size("_words") > 0, total / (F.lit(3) * F.size("_words") - 1)).otherwise(F.lit(0.0))
    return docs.withColumn("_table", table.scalar()).withColumn("score", score).drop("_words", "_hash", "_table")


def threshold(labelled: DataFrame) -> DataFrame:
    """One row: the smallest score bin that best parts the rows of quality 1 (at or above) from those of 0.

    Labels with one class only give no threshold (every document passes).
    """
    bins = labelled.groupBy(F.floor(F.col("score") * BIN).alias("bin")).agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    below = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rates = bins.select(
        "bin",
        (
            F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.nullif(F.sum("bad").over(whole), F.lit(0))
            - F.coalesce(F.sum("good").over(below), F.lit(0)) / F.nullif(F.sum("good").over(whole), F.lit(0))
        ).alias("gain"),
    )
    return settle(rates.filter("gain IS NOT NULL").agg((F.min_by("bin", F.struct(-F.col("gain"), F.col("bin"))) / BIN).alias("least")))


def quality_rules(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the base counts, `base_failed`, `score`, `held_out` and `kept`.

    Labels are read from all rows of `labels` (doc_id, quality) whose crc32 of the id as text, mod 5, is not 0: remainders
    1 to 3 make the trusted multinomial, remainder 4 the threshold. Only texts of these remainders are shuffled to meet
    them, at any size. Everything else covers all documents. A document fails the base rules if it has fewer than 20 words
    or if over 30 % of its words lie in repeated 8-word windows. A null text has no words. Ids may repeat; every row
    stays. Without labels of both kinds every document that meets the base rules is kept. Scores that tie with the threshold
    pass; an empty table gives an empty one; columns with the added names are replaced.
    """
    added = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "held_out", "score", "kept")
    own = [f.name for f in df.schema.fields if f.name not in added]
    quoted = [F.col("`" + name.replace("`", "``") + "`") for name in own]
    docs = df.select(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(quoted)]).alias("_row"), F.col(doc).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    known = settle(
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    )
    # The threshold comes from rows that the trusted multinomial has not seen.
    share, own_share = (F.pmod(F.crc32(F.col(c).cast("string")), F.lit(5)) for c in ("doc_id", "_doc"))
    table = weights(docs, known.filter((F.col("quality") == 1) & (share < 4)), own_share.between(1, 3))
    facts = known.filter(share == 4).select(F.col("doc_id").alias("_id"), "quality").hint("shuffle_hash")
    judged = docs.select("_doc", "_text").filter(own_share == 4).join(facts, F.col("_doc") == F.col("_id"))
    least = threshold(scored(with_words(judged), table).select("score", "quality"))
    done = scored(base_counts(with_words(docs)), table).withColumn("_least", least.scalar())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return done.withColumn("base_failed", failed).select(
        *[F.col(f"_row.c{i}").alias(name) for i, name in enumerate(own)],
        *added[:6],
        (F.pmod(F.crc32(F.coalesce(F.col("_doc").cast("string"), F.lit(""))), F.lit(5)) == 0).alias("held_out"),
        "score",
        (~F.col("base_failed") & (F.col("_least").isNull() | (F.floor(F.col("score") * BIN) / BIN >= F.col("_least")))).alias("kept"),
    )
