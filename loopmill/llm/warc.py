"""WARC archives with a two-level capture index.

Pages are dealt by ranges of (reversed-host URL key, page id), so each task writes one archive whose records
stand in key order, and beside it one index: compressed blocks of capture lines, then a sparse directory with a
line for each block. A lookup searches the files' first keys, then a file's directory, then the lines of one block.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopmill.llm.common import grouped_slices, materialize, open_shared, scratch_dir, small_side, task_count, text_or_empty

BATCH_BYTES = 8 << 20
BLOCK_LINES = 300
#: Page bytes meant for one archive.
ARCHIVE_BYTES = 128 << 20
#: Stored bytes that one task reads back by ranges.
READ_BYTES = 8 << 20
#: The alphabet of base 32 (RFC 4648) against that of Spark's conv().
_CONV, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONTROL = {c: " " for c in range(32)}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits are four of base 32."""
    code = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(code, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _CONV, _BASE32)


def url_key(url: str | None) -> str:
    """Sort key: host labels reversed, port kept unless it is the scheme's own, then path and query; no fragment.

    A null or unparsable URL keeps its text as key. Control characters are blanks in all keys, as files and indexes are
    sorted and searched by them.
    """
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "://" in text else f"http://{text}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return f"){text}".translate(_CONTROL)
    host = host.removeprefix("www.")
    own = {"http": 80, "https": 443}.get(parts.scheme)
    name = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != own else "")
    return (f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")).translate(_CONTROL)


def add_key(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with surt, the sort key of their URL. Python sees the URLs alone; payloads stay where they are."""
    keys = F.arrow_udf(lambda urls: pa.array([url_key(u) for u in urls.to_pylist()], type=pa.string()), "string")
    return pages.withColumn("surt", keys(F.col(url)))


def decide(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to: null for responses, else the page that they revisit.

    Of equal payloads that with the largest page_id is the response; rows that repeat it are responses too. A
    null id comes before all others; if a payload has no other, all its rows are responses.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.encode(text_or_empty(html), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", payload_digest(F.col("payload")))
    # only repeated payloads need a decision; their list goes to all tasks while it is short, else pages are joined
    originals = rows.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1 AND original IS NOT NULL")
    joined = rows.join(small_side(materialize(originals.select("payload_digest", "original"))), "payload_digest", "left")
    revisits = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        "page_id", "url", "payload_digest", F.when(revisits, F.col("original")).alias("refers_to"), F.when(~revisits, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes")
    )


def record(page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes | None, size: int) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header alone, whose Content-Length is the payload's."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {json.dumps(url)}" if url is None or any(c < " " for c in url) else f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join([*lines, "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record, and of a response its payload's own size and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        read = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != size or read != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']} does not hold its payload")
    ids = [fields.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To")]
    own, refers = (int(x) if x else None for x in ids)
    return {"page_id": own, "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": refers}


def sort_id(page_id: int | None) -> str:
    """Order of numbers as text; null first."""
    return "" if page_id is None else f"{page_id + (1 << 63):020d}"


def write_archives(decided: DataFrame, folder: str, archives: int | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write archives and their indexes below ``folder``; one row for each: first_key, last_key, name,
    captures, stored_bytes.

    A task that runs again writes files of its own; only rows of tasks that succeeded name files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_shared(folder)
        name, out, index, at = uuid.uuid4().hex, None, None, 0
        lines: list[str] = []
        directory: list[tuple[str, int, int]] = []
        last, captures, index_at = "", 0, 0

        def flush() -> None:
            nonlocal lines, index_at
            if lines:
                block = zlib.compress("\n".join(lines).encode(), 6)
                index.write(block)
                directory.append((lines[0].rsplit("\t", 2)[0], index_at, len(block)))
                index_at += len(block)
                lines = []

        try:
            for batch in grouped_slices(batches, "payload", BATCH_BYTES):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out, index = fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None), fs.open_output_stream(f"{base}/{name}.idx", compression=None)
                for row in batch.to_pylist():
                    raw = gzip.compress(record(row["page_id"], row["url"], row["payload_digest"], row["refers_to"], row["payload"], row["payload_bytes"]), 6, mtime=0)
                    out.write(raw)
                    last = f"{row['surt']}\t{sort_id(row['page_id'])}"
                    lines.append(f"{last}\t{at}\t{len(raw)}")
                    at += len(raw)
                    captures += 1
                    if len(lines) == block_lines:
                        flush()
            if out is not None:
                flush()
                tail = zlib.compress("\n".join(f"{k}\t{a}\t{n}" for k, a, n in directory).encode(), 6)
                index.write(tail + struct.pack(">QQ", index_at, len(tail)))
        finally:
            for f in (out, index):
                if f is not None:
                    f.close()
        if captures:
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([last]), pa.array([name]), pa.array([captures], type=pa.int64()), pa.array([at], type=pa.int64())], names=["first_key", "last_key", "name", "captures", "stored_bytes"])

    if archives is None:
        size = decided.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("n")).first().n
        archives = max(decided.sparkSession.sparkContext.defaultParallelism, -(-size // ARCHIVE_BYTES))
    keyed = add_key(decided)
    # as in the index: control characters never stand in a key, and ids sort as numbers
    ordered = keyed.repartitionByRange(int(archives), "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return materialize(ordered.mapInArrow(run, "first_key string, last_key string, name string, captures long, stored_bytes long"))


class _IndexFile:
    """Directory of one index, and the block that was read last."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        at, n = struct.unpack(">QQ", self.file.read_at(16, self.file.size() - 16))
        rows = [x.rsplit("\t", 2) for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n")]
        self.keys, self.places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.block, self.lines = -1, []

    def find(self, key: str) -> list[tuple[int, int]]:
        """(offset, length) of all captures of a key, which may go on in following blocks."""
        out = []
        k = max(bisect.bisect_left(self.keys, key) - 1, 0)
        while k < len(self.keys) and self.keys[k] <= key:
            if k != self.block:
                at, n = self.places[k]
                self.block, self.lines = k, [x.rsplit("\t", 2) for x in zlib.decompress(self.file.read_at(n, at)).decode().split("\n")]
            i = bisect.bisect_left(self.lines, key, key=lambda x: x[0])
            while i < len(self.lines) and self.lines[i][0] == key:
                out.append((int(self.lines[i][1]), int(self.lines[i][2])))
                i += 1
            k += 1
        return out


def read_captures(wanted: DataFrame, archives: DataFrame, folder: str) -> DataFrame:
    """The records of ``wanted`` (url, page_id), distinct ones, found through the index and read by ranges.

    page_id, record_type, payload_bytes, payload_digest, refers_to: one row for each record found.
    """
    spark = wanted.sparkSession
    # a row for each archive: their number is set by ARCHIVE_BYTES, a few hundred bytes each
    rows = archives.select("first_key", "last_key", "name", "stored_bytes").collect()
    files = sorted((r.first_key, r.last_key, r.name) for r in rows)
    tasks = task_count(wanted, sum(r.stored_bytes for r in rows), READ_BYTES)
    shared = spark.sparkContext.broadcast(files)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = [f[0] for f in shared.value]
        for batch in batches:
            keys, names = [], []
            for surt, page in zip(batch.column("surt").to_pylist(), batch.column("page_id").to_pylist()):
                key = f"{surt}\t{sort_id(page)}"
                k = max(bisect.bisect_left(first, key) - 1, 0)  # equal keys may begin in the file before
                while k < len(first) and first[k] <= key:
                    if shared.value[k][1] >= key:
                        keys.append(key)
                        names.append(shared.value[k][2])
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(keys, type=pa.string())], names=["name", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_shared(folder)
        name, index, archive = None, None, None
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            rows = []
            for own, key in zip(batch.column("name").to_pylist(), batch.column("key").to_pylist()):
                if own != name:
                    name, index, archive = own, _IndexFile(fs, f"{base}/{own}.idx"), fs.open_input_file(f"{base}/{own}.warc.gz")
                rows += [parse(gzip.decompress(archive.read_at(n, at))) for at, n in index.find(key)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    keyed = add_key(wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")))
    placed = keyed.mapInArrow(place, "name string, key string").distinct()
    # neighbours in key order are read by one task, block by block; a range holds part of a file if that is large.
    # Keys are short, records are not: there are as many ranges as the stored bytes ask for
    ordered = placed.repartitionByRange(tasks, "name", "key").sortWithinPartitions("name", "key")
    return ordered.mapInArrow(read, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> DataFrame:
    """Write all pages and read all of them back through the capture index.

    A null html is an empty payload, a null or broken URL a key of its own. Rows repeated whole give as many
    records. Other columns are not looked at.
    """
    folder = folder or scratch_dir(pages.sparkSession) + "/warc"
    decided = decide(pages, page_id, url, html)
    files = write_archives(decided, folder)
    return read_captures(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), files, folder)
