"""Removal of word sequences that occur more than once in a corpus.

Windows are compared at two lengths, the second twice the first. At the short length only anchors are
compared: of the short windows inside each full window, the one with the smallest hash. Equal full
windows choose equal anchors, so a full window whose anchor occurs once is unique and goes no further;
the others are extended to the full length and compared whole. Nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.llm.batches import settle, slices, stream_groups
from reelwise.llm.wordhash import Tokens, fits, moved, tokens, windows

PLACE = np.uint64((1 << 26) - 1)  # low bits of an anchor's sort key: its place, so that the leftmost wins
HOT = 4000  # occurrences of one anchor in a task from which its windows are counted one by one


def short_length(window: int) -> int:
    return (window + 1) // 2


def anchors(found: Tokens, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first, last): each anchor with the full windows `first..last` that chose it."""
    short = short_length(window)
    starts = np.flatnonzero(fits(found.bounds, window))
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    hashes = windows(found.hashes, short)
    key = (hashes & ~PLACE) | (np.arange(len(hashes), dtype=np.uint64) & PLACE)
    span = window - short + 1
    least, size = key, 1
    while size * 2 <= span:
        least = np.minimum(least, moved_high(least, size))
        size *= 2
    if size < span:
        least = np.minimum(least, moved_high(least, span - size))
    chosen = starts + ((least[starts] - starts.astype(np.uint64)) & PLACE).astype(np.int64)
    rows = np.searchsorted(found.bounds, starts, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (rows[1:] != rows[:-1])]))
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return hashes[chosen[first]].view(np.int64), rows[first], starts[first], starts[last]


def moved_high(values: np.ndarray, by: int) -> np.ndarray:
    out = moved(values, by)
    out[max(0, len(values) - by) :] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out


def text_key(text: str):
    """Equal for equal texts, with the length as a second check against clashes."""
    return F.struct(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.coalesce(F.length(text), F.lit(0)).alias("n"))


def repeated_windows(texts: DataFrame, window: int) -> DataFrame:
    """(key, spans) of texts with repeated windows; a span is (first start, bits of later starts).

    `texts` has `key` and `text`. Equal texts are compared once: their spans hold what other texts or the text itself
    repeat, and a caller that counts copies knows that all their windows are repeated.
    """
    bits = window - short_length(window) + 1
    if bits > 62:
        raise ValueError("windows of up to 123 words are supported")
    key_type = texts.schema["key"].dataType

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                found = tokens(data, offsets)
                hashes, row, first, _ = anchors(found, window)
                at = np.searchsorted(row, np.arange(rows.num_rows))  # anchors of a row are numbered from 0
                number = (np.arange(len(row)) - at[row]).astype(np.int32)
                keys = rows.column("key").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), keys, pa.array(number)], names=["anchor", "key", "number"])

    listed = texts.mapInArrow(find_anchors, T.StructType([T.StructField("anchor", T.LongType()), T.StructField("key", key_type), T.StructField("number", T.IntegerType())]))
    ordered = listed.repartitionByRange("anchor", "key", "number").sortWithinPartitions("anchor", "key", "number")

    def find_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose anchor has equal neighbours.

        State 1: repeated; 2: repeated, perhaps very often; 3: alone here, but at the task's border, where the next
        task may hold its equal; 4: no row, tells that the anchor at a border is repeated.
        """
        held: pa.RecordBatch | None = None
        run = 0  # length of the run that the held row ends
        begun = False  # whether an earlier anchor came before that run in this task

        def put(rows, state):
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(state.astype(np.int8))], names=["anchor", "key", "number", "state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            before = max(0, run - 1)
            values = rows.column("anchor").to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            sizes = np.diff(np.concatenate([heads, [len(values)]]))
            whole = sizes.copy()
            whole[0] += before
            border = np.zeros(len(heads), bool)
            border[-1] = True
            border[0] |= not begun or before > 0
            state = np.where(whole == 1, np.where(border, 3, 0), np.where(border | (whole > HOT), 2, 1))
            each = np.repeat(state, sizes)
            run, begun = int(whole[-1]), begun or len(heads) > 1
            held = rows.slice(len(values) - 1)
            chosen = np.flatnonzero(each[:-1] > 0)
            yield put(rows.take(pa.array(chosen)), each[chosen])
            told = heads[border & (whole > 1)]
            yield put(rows.take(pa.array(told)), np.full(len(told), 4))
        if held is not None:
            yield put(held, np.array([3 if run == 1 else 2]))

    decided = settle(ordered.mapInArrow(find_repeats, T.StructType([*listed.schema.fields, T.StructField("state", T.ByteType())])), 3)
    several = (
        decided.filter("state >= 3").groupBy("anchor").agg(F.sum(F.when(F.col("state") == 4, 2).otherwise(1)).alias("c")).filter("c > 1").select("anchor")
    )
    repeats = decided.filter("state < 3").select("key", "number", (F.col("state") == 2).alias("hot")).unionByName(
        decided.filter("state = 3").join(several, "anchor").select("key", "number", F.lit(True).alias("hot"))
    )
    per_text = repeats.groupBy("key").agg(
        F.collect_set(F.when(~F.col("hot"), F.col("number"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("number"))).alias("hot")
    )
    extended = texts.dropDuplicates(["key"]).join(per_text, "key").select("key", "text", "cold", "hot")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The full windows of each repeated anchor, as (anchor, key, first start, hashes)."""
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                found = tokens(data, offsets)
                hashes, row, first, last = anchors(found, window)
                full = windows(found.hashes, window)
                at = np.searchsorted(row, np.arange(rows.num_rows))
                picked, hot = [], []
                for name, flag in (("cold", False), ("hot", True)):
                    lists = rows.column(name)
                    owner = np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                    numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    picked.append(at[owner] + numbers)
                    hot.append(np.full(len(numbers), flag))
                pick, flags = np.concatenate(picked), np.concatenate(hot)
                counts = (last - first + 1)[pick]
                ends = np.cumsum(counts)
                which = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(first[pick], counts)
                values = pa.array(full[which].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[pick]),
                        rows.column("key").take(pa.array(row[pick])),
                        pa.array((first[pick] - found.bounds[row[pick]]).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values),
                        pa.array(flags),
                    ],
                    names=["anchor", "key", "first", "hashes", "hot"],
                )

    fields = [
        T.StructField("anchor", T.LongType()),
        T.StructField("key", key_type),
        T.StructField("first", T.IntegerType()),
        T.StructField("hashes", T.ArrayType(T.LongType())),
        T.StructField("hot", T.BooleanType()),
    ]
    candidates = settle(extended.mapInArrow(extend, T.StructType(fields)), 3)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, "anchor"):
            group = group.combine_chunks()
            lists = group.column("hashes").combine_chunks()
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            order = np.argsort(flat, kind="stable")
            ranked = flat[order]
            same = np.zeros(len(flat), bool)
            equal = ranked[1:] == ranked[:-1]
            same[order[1:]] |= equal
            same[order[:-1]] |= equal
            ends = np.cumsum(sizes)
            place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
            marks = np.add.reduceat(np.where(same, np.int64(1) << place, 0), ends - sizes)
            keep = pa.array(np.flatnonzero(marks))
            yield pa.RecordBatch.from_arrays(
                [group.column("key").combine_chunks().take(keep), group.column("first").combine_chunks().take(keep), pa.array(marks[marks != 0])],
                names=["key", "first", "marks"],
            )

    marked = [T.StructField("key", key_type), T.StructField("first", T.IntegerType()), T.StructField("marks", T.LongType())]
    cold = (
        candidates.filter("NOT hot")
        .select("anchor", "key", "first", "hashes")
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(compare, T.StructType(marked))
    )
    # Frequent anchors: occurrences with all windows alike are counted together before anything is spread out.
    frequent = candidates.filter("hot").select("key", "first", "hashes")
    alike = frequent.groupBy("hashes").agg(F.count("*").alias("c"), F.min(F.struct("key", "first")).alias("one"))
    copied = frequent.join(alike.filter("c > 1").select("hashes"), "hashes").select("key", "first", F.expr("shiftleft(1L, size(hashes)) - 1L").alias("marks"))
    spread = alike.select("c", "one.key", "one.first", F.posexplode("hashes").alias("place", "hash"))
    twice = spread.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    partly = spread.filter("c = 1").join(twice, "hash").select("key", "first", F.expr("shiftleft(1L, place)").alias("marks"))
    hot = copied.unionByName(partly)
    return cold.unionByName(hot).groupBy("key").agg(F.collect_set(F.struct("first", "marks")).alias("spans"))


def remove_repeats(df: DataFrame, window: int = 35, text: str = "text") -> DataFrame:
    """Remove every word that lies in a window of `window` words occurring more than once.

    Adds `n_words`, `n_removed` (long) and `kept`, the remaining words joined by one blank. Words are runs
    of anything but blank, tab, line feed, vertical tab, form feed and carriage return. Windows are
    judged on the input. A null, empty or short text has no window and loses nothing; a row given twice
    repeats itself; long texts are read whole; an empty table gives an empty one; columns with these names are replaced.
    """
    added = ("n_words", "n_removed", "kept")
    own = [f for f in df.schema.fields if f.name not in added]
    base = df.select(
        F.struct(*[F.col("`" + f.name.replace("`", "``") + "`").alias(f"c{i}") for i, f in enumerate(own)]).alias("row"),
        F.col(text).alias("text"),
        text_key(text).alias("key"),
    )
    spans = repeated_windows(base.select("key", "text"), window)
    copies = base.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.lit(True).alias("copied"))
    known = settle(spans.join(copies, "key", "full").select("key", "spans", F.coalesce("copied", F.lit(False)).alias("copied")))
    joined = base.join(known, "key", "left").select("row", "text", "spans", "copied")
    schema = T.StructType(
        [joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                found = tokens(data, offsets)
                total = len(found.hashes)
                lists = rows.column("spans")
                owner = np.repeat(np.arange(rows.num_rows), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
                flat = lists.flatten()
                first = flat.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
                marks = flat.field("marks").to_numpy(zero_copy_only=False).astype(np.int64)
                steps = np.zeros(total + 1, np.int64)
                # Every window of a text with copies occurs again in them.
                copied = pc.fill_null(rows.column("copied"), False).to_numpy(zero_copy_only=False)
                long = copied & (np.diff(found.bounds) >= window)
                steps[found.bounds[:-1][long]] += 1
                np.subtract.at(steps, found.bounds[1:][long], 1)
                for place in range(window - short_length(window) + 1):
                    at = found.bounds[owner] + first + place
                    at = at[(marks >> place) & 1 == 1]
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + window, -1)
                gone = np.cumsum(steps)[:total] > 0
                text_of, lengths = joined_words(data, found, ~gone)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("row"),
                        pa.array(np.diff(found.bounds)),
                        pa.array(np.diff(np.concatenate([[0], np.cumsum(gone)])[found.bounds])),
                        pa.LargeStringArray.from_buffers(rows.num_rows, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(text_of)).cast(pa.string()),
                    ],
                    names=["row", "n_words", "n_removed", "kept"],
                )

    done = joined.mapInArrow(cut, schema)
    return done.select(*[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(own)], *added)


def joined_words(data: np.ndarray, found: Tokens, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words joined by one blank, all rows in a row, and the byte length of each row."""
    kept = np.flatnonzero(keep)
    rows = np.searchsorted(found.bounds, kept, side="right") - 1
    ends_row = np.concatenate([rows[1:] != rows[:-1], [True]]) if len(kept) else np.zeros(0, bool)
    sizes = found.ends[kept] - found.starts[kept] + ~ends_row
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    source = np.arange(total) - np.repeat(begin - found.starts[kept], sizes)
    padded = np.append(data, np.uint8(32))
    out = padded[np.minimum(source, len(data))] if total else np.zeros(0, np.uint8)
    blanks = (begin + sizes - 1)[~ends_row]
    out[blanks] = 32
    lengths = np.bincount(rows, weights=sizes, minlength=len(found.bounds) - 1).astype(np.int64)
    return out, lengths
