"""Arrow batch helpers shared by the operators that run vectorised Python inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from reelwise.session import cut_lineage

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of at most `most` whole rows of about `limit` text bytes.

    Yields (rows, bytes of all their texts, offsets of the rows in those bytes). A null text has no bytes.
    One longer text makes a run of its own.
    """
    if not batch.num_rows:
        return
    total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    low = 0
    while low < batch.num_rows:
        high = min(low + most, max(low + 1, int(np.searchsorted(total, total[low] + limit, side="right")) - 1))
        rows = batch.slice(low, high - low)
        # Only the texts of one run are copied.
        column = pc.fill_null(rows.column(text).cast(pa.large_binary()), b"")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows.num_rows + 1]
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        yield rows, data[offsets[0] : offsets[-1]], offsets - offsets[0]
        low = high


def stream_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Re-cut sorted batches so that every table holds whole groups of equal `key`.

    Rows must arrive sorted by `key`. Many small groups stay together in one table; only the group
    that crosses a batch border is carried over.
    """
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key)
        if carried and carried[-1].column(key)[-1] != values[0]:
            yield pa.Table.from_batches(carried)
            carried = []
        column = values.to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(column[1:] != column[:-1])
        if len(changes):
            cut = int(changes[-1]) + 1
            yield pa.Table.from_batches([*carried, batch.slice(0, cut)])
            carried = [batch.slice(cut)]
        else:
            carried.append(batch)
    if carried:
        yield pa.Table.from_batches(carried)


def binary_rows(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per row: the bytes of `values` up to each running end."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def settle(df: DataFrame, share: int = 8) -> DataFrame:
    """Write a table that is smaller than its input to the shared folder, in fewer files, and read it back.

    The number of files follows the session's shuffle partitions, and so the size of the data.
    """
    spark = df.sparkSession
    files = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)
    return cut_lineage(df.coalesce(files))
