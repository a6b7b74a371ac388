"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

A payload is kept as a greyscale PNG (8-bit samples, lossless). Metadata columns come from range reads of the
fixed-size file header alone; features from a full read of the stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopmill.llm.common import materialize, open_shared, scratch_dir, slices, task_count, text_or_empty

#: Payload lengths are multiples of this many bytes, padded with spaces: one image row.
ROW_BYTES = 192
HEADER_BYTES = 33  # the PNG signature and its IHDR chunk
SIGNATURE = b"\x89PNG\r\n\x1a\n"
TAIL = 16
BATCH_BYTES = 8 << 20
#: Size beyond which a task begins another tar shard.
SHARD_BYTES = 256 << 20
#: Stored bytes that one task reads back.
READ_BYTES = 16 << 20
_INDEX = "digest binary, shard string, media_offset long, media_length long"


def to_png(payload: bytes) -> bytes:
    """8-bit greyscale rows of ROW_BYTES samples. The bytes depend on the payload alone."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((len(payload) // ROW_BYTES, ROW_BYTES + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW_BYTES)
    header = struct.pack(">IIBBBBB", ROW_BYTES, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of what ``to_png`` made; chunk checksums and sizes are verified."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filtered PNG row")
    return rows[:, 1:].tobytes()


def payloads(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the UTF-8 text; null: 0), payload (padded to a positive multiple of ROW_BYTES), digest."""
    raw = F.encode(text_or_empty(text), "UTF-8")
    size = F.greatest(F.ceil(F.octet_length(raw) / ROW_BYTES), F.lit(1)) * ROW_BYTES
    padded = docs.select(F.col(doc_id).alias("doc_id"), raw.alias("raw"), size.cast("int").alias("size"))
    return padded.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.expr("rpad(raw, size, X'20')").alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))


def write_shards(found: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store payloads below ``folder``; the index has one entry for each digest: shard, media_offset, media_length.

    A task stores each digest once, in shards of its own, so payloads cross no network; of entries that several
    tasks made of one digest, the index names the first, and all rows use it. A task that runs again writes files
    of its own, and only rows of tasks that succeeded enter the index.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_shared(folder)
        seen: set[bytes] = set()
        out, name, at = None, "", 0

        def finish() -> None:
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()

        try:
            for batch in slices(batches, "payload", BATCH_BYTES):
                rows = []
                for digest, payload in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist()):
                    if digest in seen:
                        continue
                    seen.add(digest)
                    if out is None or at >= shard_bytes:
                        finish()
                        fs.create_dir(base, recursive=True)
                        name, at = f"shard-{uuid.uuid4().hex}.tar", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    media = to_png(payload)
                    entry = tarfile.TarInfo(f"{digest.hex()}.png")
                    entry.size = len(media)
                    head = entry.tobuf(tarfile.USTAR_FORMAT)
                    body = media + b"\0" * (-len(media) % 512)
                    out.write(head + body)
                    rows.append((digest, name, at + len(head), len(media)))
                    at += len(head) + len(body)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["digest", "shard", "media_offset", "media_length"])
        finally:
            finish()

    stored = materialize(found.select("digest", "payload").mapInArrow(store, _INDEX))
    first = stored.groupBy("digest").agg(F.min(F.struct("shard", "media_offset", "media_length")).alias("at"))
    return materialize(first.select("digest", "at.*"))


def in_order(index: DataFrame) -> DataFrame:
    """Entries of a shard side by side, as they stand there. An index row is small, what it stands for is not: there
    are as many tasks as the stored bytes ask for."""
    size = index.agg(F.sum("media_length").alias("n")).first().n
    return index.repartitionByRange(task_count(index, size, READ_BYTES), "shard", "media_offset").sortWithinPartitions("shard", "media_offset")


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with media_width, media_height, bit_depth and colour_type, from HEADER_BYTES of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_shared(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for shard, offset in zip(batch.column("shard").to_pylist(), batch.column("media_offset").to_pylist()):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{base}/{shard}")
                rows.append(struct.unpack(">IIBB", file.read_at(HEADER_BYTES, offset)[16:26]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, type=pa.int32()) for c in zip(*rows))], names=[*batch.schema.names, *names])

    names = ["media_width", "media_height", "bit_depth", "colour_type"]
    return index.mapInArrow(run, ", ".join([_INDEX, *(f"{c} int" for c in names)]))


def read_features(index: DataFrame, folder: str) -> DataFrame:
    """``index`` with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, all from
    the stored bytes. feature is mean, deviation and mean step of the samples, and their 8-class histogram."""
    extra = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_shared(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "media_offset", "media_length"))):
                if shard != name:
                    name, file = shard, fs.open_input_file(f"{base}/{shard}")
                media = file.read_at(length, offset)
                payload = from_png(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, type=k) for c, k in zip(zip(*rows), kinds))], names=[*batch.schema.names, *(c.split()[0] for c in extra.split(", "))])

    return index.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in index.schema), extra]))


def feature(payload: bytes) -> str:
    x = np.frombuffer(payload, dtype=np.uint8)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    classes = ",".join(map(str, np.bincount(x >> 5, minlength=8).tolist()))
    return f"mean={x.mean():.4f};deviation={x.std():.4f};step={step:.4f};classes={classes}"


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, n_bytes) with digest, shard, offset, length, header metadata and features.

    A null text counts as empty, and an empty one has one row of spaces. Equal texts share one stored entry.
    A repeated row, or a null id, gives a row each time. Other columns of ``docs`` are not looked at.
    """
    folder = folder or scratch_dir(docs.sparkSession) + "/media"
    found = payloads(docs, doc_id, text)
    index = write_shards(found, folder)
    read = materialize(read_features(read_headers(in_order(index), folder), folder))
    return found.select("doc_id", "n_bytes", "digest").join(read, "digest")
