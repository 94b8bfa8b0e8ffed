"""Corpus-wide line deduplication that returns keep bitmaps instead of text.

Line hashes are range-partitioned and sorted by hash, then document (largest first). Each task streams
its part once: a run of one hash shows its first document and whether it has enough documents. Runs
that touch the border of a batch are left open and settled by one small aggregation, so a line that
fills many partitions needs no task of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.llm.batches import settle

WHITE = b" \t\n\v\f\r"
LINE_FIELDS = "high long, low long, doc long, row long, n_lines int, places array<int>"
SLICE_ROWS = 256


def line_key(line: str) -> bytes:
    """The line without white space around it, with A-Z as a-z, in UTF-8."""
    return line.encode().strip(WHITE).lower()


def _listed(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                out: list[tuple] = []
                for doc, row, text in zip(*(rows.column(c).to_pylist() for c in ("doc", "row", "text"))):
                    places: dict[bytes, list[int]] = {}
                    lines = (text or "").split("\n")
                    for at, line in enumerate(lines):
                        if len(line) >= min_chars:
                            key = line_key(line)
                            if len(key) >= min_chars and len(key.decode()) >= min_chars:
                                places.setdefault(xxhash.xxh3_128_digest(key), []).append(at)
                    out.extend((key, doc, row, len(lines), at) for key, at in places.items())
                halves = np.frombuffer(b"".join(x[0] for x in out), ">i8").astype(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.ascontiguousarray(halves[:, 0])),
                        pa.array(np.ascontiguousarray(halves[:, 1])),
                        pa.array([x[1] for x in out], pa.int64()),
                        pa.array([x[2] for x in out], pa.int64()),
                        pa.array([x[3] for x in out], pa.int32()),
                        pa.array([x[4] for x in out], pa.list_(pa.int32())),
                    ],
                    names=["high", "low", "doc", "row", "n_lines", "places"],
                )

    return run


def _streamed(min_docs: int):
    """kind 0: a row to drop; 1: a row of an open run; 2: what a batch saw of an open run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            high, low, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("high", "low", "doc"))
            new_key = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
            new_doc = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
            if before == (high[0], low[0], doc[0]):
                new_doc[0] = False  # this document was counted in the last batch
            before = (high[-1], low[-1], doc[-1])
            heads = np.flatnonzero(new_key)
            sizes = np.diff(np.concatenate([heads, [n]]))
            docs = np.add.reduceat(new_doc.astype(np.int64), heads)
            open_run = np.zeros(len(heads), bool)
            open_run[[0, -1]] = True
            each_open = np.repeat(open_run, sizes)
            drop = ~each_open & np.repeat(docs >= min_docs, sizes) & (doc != np.repeat(doc[heads], sizes))
            kind = np.where(drop, 0, np.where(each_open, 1, -1)).astype(np.int8)
            rows = np.flatnonzero(kind >= 0)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(kind[rows]), pa.nulls(len(rows), pa.int64())], names=[*taken.schema.names, "kind", "docs"])
            summary = np.flatnonzero(open_run)
            taken = batch.take(pa.array(heads[summary]))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.full(len(summary), 2, np.int8)), pa.array(docs[summary])], names=[*taken.schema.names, "kind", "docs"]
            )

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, dropped in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist()):
            keep = np.ones(n, bool)
            keep[dropped] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(out, pa.binary())], names=["doc", "row", "keep"])


def keep_bitmaps(df: DataFrame, min_chars: int = 40, min_docs: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row, keep): which lines of a text stay, as a zlib-packed bit per line; texts that lose none are left out.

    A line's key is the line without white space around it and with A-Z as a-z. Keys of at least
    `min_chars` code points found in at least `min_docs` documents lose their lines everywhere but in the
    largest document id. `row` is the hash of the text, so rows that share an id keep their own bitmaps.
    Rows with a null id count together as one document, smaller than any other. A null text is one empty line.
    """
    base = df.select(
        F.coalesce(F.col(doc).cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text")
    )
    listed = base.mapInArrow(_listed(min_chars), LINE_FIELDS)
    ordered = listed.repartitionByRange("high", "low", F.desc("doc")).sortWithinPartitions("high", "low", F.desc("doc"))
    seen = settle(ordered.mapInArrow(_streamed(min_docs), LINE_FIELDS + ", kind byte, docs long"))
    settled = (
        seen.filter("kind = 2").groupBy("high", "low").agg(F.sum("docs").alias("n"), F.max("doc").alias("first")).filter(F.col("n") >= min_docs)
    )
    late = seen.filter("kind = 1").join(settled.drop("n"), ["high", "low"]).filter("doc <> first")
    wanted = ["doc", "row", "n_lines", "places"]
    dropped = (
        seen.filter("kind = 0").select(*wanted).unionByName(late.select(*wanted))
        .groupBy("doc", "row").agg(F.max("n_lines").alias("n_lines"), F.flatten(F.collect_set("places")).alias("places"))
    )
    return settle(dropped.mapInArrow(_bitmaps, "doc long, row long, keep binary"))


def _applied(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(start, SLICE_ROWS)
                counts, drops, kept = [], [], []
                for text, keep in zip(rows.column("text").to_pylist(), rows.column("keep").to_pylist()):
                    lines = (text or "").split("\n")
                    counts.append(len(lines))
                    if keep is None:
                        drops.append(0)
                        kept.append(text or "")
                    else:
                        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                        drops.append(len(lines) - int(bits.sum()))
                        kept.append("\n".join(line for line, bit in zip(lines, bits) if bit))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("own"), rows.column("keep"), pa.array(counts, pa.int64()), pa.array(drops, pa.int64()), pa.array(kept, pa.string())],
                    names=["own", *names],
                )

    return run


def dedup_lines(df: DataFrame, min_chars: int = 40, min_docs: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `keep` (bitmap, null if all lines stay), `n_lines`, `n_dropped` (long) and `kept`, the remaining lines.

    See `keep_bitmaps` for the rule. Every row stays, repeated rows too, even if it loses all its lines; columns
    with the added names are replaced; an empty table gives an empty table.
    """
    added = ["keep", "n_lines", "n_dropped", "kept"]
    own = [f for f in df.schema.fields if f.name not in added]
    # The text goes once through the shuffle, inside `own` where it is one of the kept columns.
    place = next((i for i, f in enumerate(own) if f.name.lower() == text.lower()), None)
    base = df.select(
        F.struct(*[F.col("`" + f.name.replace("`", "``") + "`").alias(f"c{i}") for i, f in enumerate(own)]).alias("own"),
        F.coalesce(F.col(doc).cast("long"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64(F.col(text)).alias("row"),
        *([F.col(text).alias("text")] if place is None else []),
    )
    found = keep_bitmaps(df, min_chars, min_docs, doc, text).hint("shuffle_hash")
    read = F.col("text") if place is None else F.col(f"own.c{place}")
    joined = base.join(found, ["doc", "row"], "left").select("own", read.alias("text"), "keep")
    schema = T.StructType(
        [
            joined.schema["own"],
            T.StructField("keep", T.BinaryType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    done = joined.mapInArrow(_applied(added), schema)
    return done.select(*[F.col(f"own.c{i}").alias(f.name) for i, f in enumerate(own)], *added)
