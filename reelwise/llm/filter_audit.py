"""What filters remove in every order: counts by one pass of a byte transducer, then sums over sets of failing filters.

Each text goes once through a table of transitions, (state, byte) to (marks), with the states between words and inside
a word; the marks are word starts, word ends, code points, capitals and symbols. Words are spans of the text; they are
inserted into an open-addressing hash table whose hits are verified byte by byte, so equal hashes never merge two words.
Which filters a document fails does not depend on their order, so documents collapse to counts per set of failing
filters, and every order follows from those few counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.llm.batches import slices
from reelwise.llm.wordhash import BYTES, LONGEST, POWERS, WHITE, mix
from reelwise.session import cut_lineage

START, END, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"
GROUP_BYTES = 1 << 21  # words are hashed and compared in groups of about so many bytes


def transitions(symbols: bytes = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(next state of a byte, marks of state * 256 + byte); state 1 is inside a word.

    A UTF-8 continuation byte (10xxxxxx) never is a code point of its own, and no byte above 127 separates words, so
    two states carry a whole character.
    """
    byte = np.arange(256)
    state = np.ones(256, np.uint8)
    state[list(WHITE)] = 0
    marks = np.zeros((2, 256), np.uint8)
    marks[:, (byte & 0xC0) != 0x80] |= POINT
    marks[:, (byte >= 65) & (byte <= 90)] |= CAPITAL
    marks[:, list(symbols)] |= SYMBOL
    marks[0, state == 1] |= START
    marks[1, state == 0] |= END
    return state, marks.ravel()


def run_transducer(data: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts of code points, capitals and symbols by text, word starts, word ends); every text begins between words."""
    next_state, marks = tables
    state = next_state[data]
    before = np.zeros(len(data) + 1, np.uint8)
    before[1:] = state
    last = offsets[1:][np.diff(offsets) > 0]
    open_ends = last[before[last] == 1]  # a text that ends inside a word ends that word
    before[offsets] = 0
    marked = marks[before[:-1].astype(np.uint16) << 8 | data]
    full = np.flatnonzero(np.diff(offsets) > 0)
    counts = np.zeros((3, len(offsets) - 1), np.int64)
    if len(full):
        for k, bit in enumerate((POINT, CAPITAL, SYMBOL)):
            counts[k, full] = np.add.reduceat((marked & bit) > 0, offsets[full], dtype=np.int64)
    ends = np.concatenate([np.flatnonzero(marked & END), open_ends])
    ends.sort()
    return counts, np.flatnonzero(marked & START), ends


def word_groups(lengths: np.ndarray) -> Iterator[slice]:
    """Runs of words of about GROUP_BYTES bytes; a longer word is alone."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    low = 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(total, total[low] + GROUP_BYTES, side="right")) - 1)
        yield slice(low, high)
        low = high


def places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte places of spans, one span after another, and where each span begins in them."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum())), first


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for part in word_groups(lengths):
        where, first = places(starts[part], lengths[part])
        inside = (np.arange(len(where)) - np.repeat(first, lengths[part])) % LONGEST
        with np.errstate(over="ignore"):
            total = np.add.reduceat(BYTES[data[where]] * POWERS[inside], first)
            out[part] = mix(total + lengths[part].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans from `a` and from `b` on hold equal bytes."""
    out = np.zeros(len(a), bool)
    for part in word_groups(lengths):
        where, first = places(a[part], lengths[part])
        other, _ = places(b[part], lengths[part])
        out[part] = np.logical_and.reduceat(data[where] == data[other], first)
    return out


def first_occurrences(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each word is the first of its bytes in its row, by a hash table with linear probing and verified hits."""
    n = len(starts)
    first = np.zeros(n, bool)
    if not n:
        return first
    hashes = span_hashes(data, starts, lengths)
    with np.errstate(over="ignore"):
        keys = mix(hashes + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    size = 1 << (2 * n - 1).bit_length()
    table = np.full(size, -1, np.int64)
    slot = (keys & np.uint64(size - 1)).astype(np.int64)
    waiting = np.arange(n)
    while len(waiting):
        at = slot[waiting]
        free = table[at] < 0
        table[at[free][::-1]] = waiting[free][::-1]  # of several words at one free slot the first one takes it
        holder = table[at]
        own = holder == waiting
        first[waiting[own]] = True
        alike = ~own & (rows[holder] == rows[waiting]) & (hashes[holder] == hashes[waiting]) & (lengths[holder] == lengths[waiting])
        check = np.flatnonzero(alike)
        alike[check] = same_bytes(data, starts[holder[check]], starts[waiting[check]], lengths[waiting[check]])
        waiting = waiting[~own & ~alike]
        slot[waiting] = (slot[waiting] + 1) & (size - 1)
    return first


COUNTS = ("n_words", "n_distinct", "n_points", "n_capitals", "n_symbols")


def text_counts(df: DataFrame, text: str = "text", symbols: bytes = SYMBOLS) -> DataFrame:
    """Replace the text column by n_words, n_distinct, n_points, n_capitals, n_symbols (long) and `digest` (16 bytes).

    Words are maximal runs without blanks (0x20, 0x09-0x0D), told apart by case. A null text counts as empty, and an
    empty one has zeros everywhere. Every row stays, repeated rows too; whole texts are read, a very long one in groups
    of words; columns that carry one of the added names are replaced; an empty table gives an empty one.
    """
    added = (*COUNTS, "digest")
    own = [f.name for f in df.schema.fields if f.name not in added and f.name != text]
    quoted = [F.col("`" + name.replace("`", "``") + "`") for name in own]
    base = df.select(F.struct(F.lit(0).alias("_"), *[c.alias(f"c{i}") for i, c in enumerate(quoted)]).alias("row"), F.col("`" + text.replace("`", "``") + "`").alias("text"))
    tables = transitions(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                (points, capitals, marks), starts, ends = run_transducer(data, offsets, tables)
                owner = np.searchsorted(offsets, starts, side="right") - 1
                n = rows.num_rows
                first = first_occurrences(data, owner, starts, ends - starts)
                counts = [np.bincount(owner, minlength=n), np.bincount(owner[first], minlength=n), points, capitals, marks]
                view = memoryview(data)
                digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("row"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.binary())], names=["row", *added]
                )

    fields = [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("digest", T.BinaryType())]
    done = base.mapInArrow(run, T.StructType([base.schema["row"], *fields]))
    return done.select(*[F.col(f"row.c{i}").alias(name) for i, name in enumerate(own)], *added)


def order_audit(cells: DataFrame, names: str) -> DataFrame:
    """What each filter removes at each step of every order.

    `cells` has (part, mask, n, good, toxic): documents by the set of filters they fail, bit i of `mask` for letter i
    of `names`. One row per part, `filter_order` and `step`; a part without documents has none.
    """
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order):
            steps.append(f"named_struct('o', '{''.join(names[k] for k in order)}', 's', {step + 1}, 'b', {1 << i}, 'e', {before})")
            before |= 1 << i
    each = cells.select("part", "mask", "n", "good", "toxic", F.inline(F.expr(f"array({', '.join(steps)})")))
    fails, early = F.expr("mask & b <> 0"), F.expr("mask & e <> 0")
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    summed = each.groupBy("part", "o", "s", "b").agg(
        total(~fails & ~early).alias("kept"),
        total(fails & ~early).alias("removed"),
        total(fails & early).alias("redundant"),
        total(F.expr("mask = b")).alias("unique_fails"),
        total(fails & ~early, "good").alias("good_lost"),
        total(fails & ~early, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(W.partitionBy("part", "b")).cast("long")
    return summed.select(
        "part", F.col("o").alias("filter_order"), F.col("s").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley")
    )


def failing_mask() -> Column:
    """Bits of the filters on the counts of one text: A short, B repetitive, C capitals, D symbols."""
    tests = ["n_words < 200", "100 * n_distinct < 50 * n_words", "100 * n_capitals > 3 * n_points", "n_symbols > 0"]
    return F.expr(" + ".join(f"IF({t}, {1 << i}, 0)" for i, t in enumerate(tests)))


def filter_audit(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Interaction of five filters over `df`: what each removes, repeats and removes alone, in all 120 orders.

    A fails under 200 words, B with 100 * distinct words < 50 * words, C with 100 * capitals A-Z > 3 * code points, D
    with any of #$%&*|, E if a smaller id in the whole table has the same text. Rows are per value of `part` (null: the
    empty string), order and step, zeros included. `labels` (doc_id, quality, toxic) may list an id twice (the larger
    value counts) or hold nulls (no label). A null text is the empty text, without words. Repeated rows all count, and
    rows of equal id do not fail E for each other; a row without id neither fails E nor makes others fail it, and has no
    labels. Other columns are not read, so their names cannot clash. An empty table gives no rows.
    """
    quote = lambda name: F.col("`" + name.replace("`", "``") + "`")
    docs = df.select(quote(doc).alias("doc_id"), F.coalesce(quote(part).cast("string"), F.lit("")).alias("part"), quote(text).alias("text"))
    counted = cut_lineage(text_counts(docs).select("doc_id", "part", "digest", failing_mask().alias("mask")))
    # Texts that occur under two ids or more: the smallest one is spared.
    ids = counted.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    copies = cut_lineage(ids.filter("least < most").select("digest", "least"))
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = counted.join(copies, "digest", "left").select("doc_id", "part", F.expr("mask + IF(doc_id > least, 16, 0)").alias("mask"))
    flagged = rows.join(marked, "doc_id", "left")
    one = lambda test: F.sum(F.when(F.expr(test), 1).otherwise(0)).alias
    cells = flagged.groupBy("part", "mask").agg(F.count("*").alias("n"), one("quality = 1")("good"), one("toxic = 1")("toxic"))
    return order_audit(cells, "ABCDE")
