"""Shared-folder files and batch helpers used by the operators of this subpackage; scratch tables are the library's."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopmill.functions.scratch import scratch_dir as scratch_dir
from loopmill.functions.scratch import settle as materialize  # noqa: F401

#: A side is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow table for broadcast if its counted rows are within ``limit``; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def open_shared(uri: str):
    """(filesystem, path) of a Hadoop-style URI, usable inside a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _sizes(column: pa.Array) -> pa.Array:
    """Bytes of each text, from the offsets alone; null counts as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())


def give_back() -> None:
    """Hand free memory back to the system. Idle Python workers would keep what a finished task's batches took, beside
    the stages that run in the JVM afterwards."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of ``column`` at most, and one row at least."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.cumsum(_sizes(batch.column(column)).to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield batch.slice(lo, hi - lo)
        del batch
    give_back()


def grouped_slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Like ``slices``, but neighbouring small batches are joined up to ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in slices(batches, column, most):
        own = int(_sizes(piece.column(column)).to_numpy(zero_copy_only=False).sum())
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held = []
    give_back()


def task_count(df: DataFrame, payload_bytes: int | None, task_bytes: int) -> int:
    """Partitions for rows that are small themselves but stand for ``payload_bytes`` to read or write."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(payload_bytes or 0) // task_bytes))


def crc_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
