"""Packing: concatenate all documents and cut the stream into windows of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.llm.common import grouped_slices, materialize, utf8
from loopmill.llm.tokens import default_path, encoder

BATCH_BYTES = 4 << 20


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, closing: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` (16- or 32-bit little-endian), ``n_tokens``, and its place:
    ``part`` (the task that read it) and ``at`` (ids before it in that task).

    A null or empty text has the closing id alone. A repeated row is a document of its own; ids may be null.
    """
    path = path or default_path()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in grouped_slices(batches, "text", BATCH_BYTES):
            ids, bounds = enc.encode(utf8(batch.column("text")), closing)
            raw, width = ids.tobytes(), ids.itemsize
            cut = (bounds * width).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], type=pa.binary()),
                    pa.array(np.diff(bounds)),
                    pa.array(np.full(len(cut) - 1, part, dtype=np.int64)),
                    pa.array(bounds[:-1] + at),
                ],
                names=["doc_id", "ids", "n_tokens", "part", "at"],
            )
            at += int(bounds[-1])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long, part long, at long")


def global_starts(tokens: DataFrame) -> DataFrame:
    """``start_at`` of each task's ids in the one stream: prefix sums over the totals, a row for each task."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start_at"))


def cut_windows(tokens: DataFrame, length: int = 4096) -> DataFrame:
    """Pieces of documents in windows of ``length`` ids, from a table that ``tokenize`` made.

    Columns: doc_id, start (its document's ids before the piece), length, ids (32-bit), ids_crc32, doc_tokens,
    sequence_id, offset (of the piece in its window), starts_doc, ends_doc. Windows have no gap; all but the
    last are full.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()
    width = F.octet_length("ids") / F.col("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_slices(batches, "ids", BATCH_BYTES):
            begin = batch.column("begin").to_numpy()
            total = batch.column("n_tokens").to_numpy()
            pieces = (begin + total - 1) // length - begin // length + 1
            row = np.repeat(np.arange(len(begin)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = begin[row] // length + nth
            start = np.maximum(sequence * length, begin[row]) - begin[row]
            stop = np.minimum((sequence + 1) * length - begin[row], total[row])
            dtypes = [np.dtype(f"<u{int(x)}") for x in batch.column("width").to_pylist()]
            wide = [np.frombuffer(x, dtype=t).astype("<u4").tobytes() for x, t in zip(batch.column("ids").to_pylist(), dtypes)]
            ids = [wide[r][a:b] for r, a, b in zip(row.tolist(), (start * 4).tolist(), (stop * 4).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(start),
                    pa.array(stop - start),
                    pa.array(ids, type=pa.binary()),
                    pa.array([zlib.crc32(x) for x in ids], type=pa.int64()),
                    pa.array(total[row]),
                    pa.array(sequence),
                    pa.array(begin[row] + start - sequence * length),
                    pa.array(start == 0),
                    pa.array(stop == total[row]),
                ],
                names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "starts_doc", "ends_doc"],
            )

    placed = tokens.join(F.broadcast(global_starts(tokens)), "part").select(
        "doc_id", "ids", "n_tokens", width.cast("int").alias("width"), (F.col("start_at") + F.col("at")).alias("begin")
    )
    return placed.mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, starts_doc boolean, ends_doc boolean",
    )


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 4096, path: str | None = None, closing: int = 2) -> DataFrame:
    """``tokenize``, keep the ids in the shared folder, then ``cut_windows``.

    Documents stand in the order in which they are read. Empty tables give no piece. Other columns of ``docs``
    are not looked at.
    """
    return cut_windows(materialize(tokenize(docs, doc_id, text, path, closing)), length)
