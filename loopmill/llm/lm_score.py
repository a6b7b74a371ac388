"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders up to ``order`` and a uniform one are mixed with weights for each
bucket of context frequency; expectation-maximisation learns the weights on a deleted part of the training
texts, against counts without that part.

Counting and looking up are one exchange. Each block of texts sends its distinct n-gram keys (64-bit, sorted,
packed) with its training counts to shards by key range; a shard adds up and answers each block in the block's
own order. A frequent n-gram is one key in each block, so no key is hot, and no table is whole anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopmill.llm.common import grouped_slices, materialize, utf8
from loopmill.llm.wordscan import mix, scan

BLOCK_BYTES = 8 << 20
#: Text for each shard of keys; about two million keys.
SHARD_BYTES = 16 << 20
ORDER = 2
#: One in so many training texts is deleted for the weights.
DELETED = 8
#: Width of the classes (natural logarithms) in which held-out probability ratios are counted for EM.
RATIO_STEP = 0.1
LEAST_UNIFORM = 1e-5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_END, _START = np.uint64(0x51ED270B7A5A1C3D), np.uint64(0x2545F4914F6CDD1D)
_EXCHANGE = "kind int, shard int, block string, level int, deleted boolean, n long, keys binary, counts binary, train_tokens long, train_docs long, deleted_tokens long, deleted_docs long"
_COLUMNS = [c.split()[0] for c in _EXCHANGE.split(", ")]
LAYOUT, KEYS, ANSWER, SIZES = range(4)


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; ``unpack`` needs their number and type."""
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), asbytes=True)


def unpack(raw: bytes, n: int, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, decompressed_size=n * width), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).reshape(n)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(raw, n, np.uint64), dtype=np.uint64)


def keys_of(token: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, the key of the n-gram that ends at each token; starts are padded."""
    out, starts = [token], first[:-1]
    for _ in range(order - 1):
        context = np.empty_like(token)
        context[1:] = out[-1][:-1]
        context[starts] = _START
        out.append(mix(context * _ODD + token))
    return out


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(keys, np.array([(s << 64) // shards for s in range(shards)], dtype=np.uint64))


def _row(**of):
    return [of.get(c) for c in _COLUMNS]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(list(x), type=k) for x, k in zip(zip(*rows), kinds)], names=_COLUMNS)


def _blocks(order: int, shards: int):
    """Texts to exchange rows: a block's layout (ids, flags, word keys, words in order), and its keys by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in grouped_slices(batches, "text", BLOCK_BYTES):
            flag = np.array(batch.column("deleted").to_pylist(), dtype=bool)
            for deleted in (False, True):
                part = batch.filter(pa.array(flag == deleted))
                if not part.num_rows:
                    continue
                block = uuid.uuid4().hex  # rows of a task that is run again go together with its own layout
                w = scan(utf8(part.column("text")))
                docs = part.num_rows
                first = w.first + np.arange(docs + 1)
                token = np.full(first[-1], _END)
                inside = np.ones(len(token), dtype=bool)
                inside[first[1:] - 1] = False
                token[inside] = w.hash
                train = np.array(part.column("train").to_pylist(), dtype=bool)
                weight = np.repeat(train, np.diff(first))
                rows, word = [], None
                for level, key in enumerate(keys_of(token, first, order), 1):
                    unique, back = np.unique(key, return_inverse=True)
                    word = (unique, back) if level == 1 else word
                    count = np.bincount(back[weight], minlength=len(unique)).astype(np.uint32)
                    cut = [*_shard(unique, shards).tolist(), len(unique)]
                    for s, (a, b) in enumerate(zip(cut, cut[1:])):
                        if b > a:
                            rows.append(_row(kind=KEYS, shard=s, block=block, level=level, deleted=deleted, n=b - a, keys=pack_sorted(unique[a:b]), counts=pack(count[a:b])))
                        if len(rows) == 64:
                            yield _batch(rows)
                            rows = []
                unique, back = word
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([part.schema.field("doc_id"), ("held_out", pa.bool_()), ("tokens", pa.int64())])) as writer:
                    writer.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first))], names=["doc_id", "held_out", "tokens"]))
                head = sink.getvalue().to_pybytes()
                body = pack(back.astype(np.uint32))
                sizes = np.array([len(head), len(unique), len(back), len(body)], dtype="<u8").tobytes()
                n = int(weight.sum())
                numbers = {"train_tokens": n, "train_docs": int(train.sum()), "deleted_tokens": n * deleted, "deleted_docs": int(train.sum()) * deleted}
                rows.append(_row(kind=LAYOUT, shard=int(block[:7], 16) % shards, block=block, level=0, deleted=deleted, n=len(token), keys=pack_sorted(unique), counts=sizes + head + body, **numbers))
                yield _batch(rows)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, level: each level of a shard is added up, and each block gets its counts back."""
    held: list[dict] = []

    def flush() -> Iterator[pa.RecordBatch]:
        key = np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in held])
        count = np.concatenate([unpack(r["counts"], r["n"], np.uint32) for r in held]).astype(np.int64)
        removed = np.concatenate([np.full(r["n"], r["deleted"]) for r in held])
        unique, back = np.unique(key, return_inverse=True)
        total = np.bincount(back, weights=count, minlength=len(unique)).astype(np.int64)
        rest = total - np.bincount(back[removed], weights=count[removed], minlength=len(unique)).astype(np.int64)
        shard, level, at, rows = held[0]["shard"], held[0]["level"], 0, []
        for r in held:
            mine = back[at : at + r["n"]]
            at += r["n"]
            rows.append(
                _row(kind=ANSWER, shard=shard, block=r["block"], level=level, deleted=r["deleted"], n=r["n"], keys=pack(total[mine].astype(np.uint64)), counts=pack(rest[mine].astype(np.uint64)) if r["deleted"] else None)
            )
        if level == 1:  # distinct words seen, and without the deleted part
            rows.append(_row(kind=SIZES, shard=shard, level=1, n=int((total > 0).sum()), train_docs=int((rest > 0).sum())))
        yield _batch(rows)

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == LAYOUT:
                yield _batch([[row[c] for c in _COLUMNS]])
                continue
            if held and (held[0]["shard"], held[0]["level"]) != (row["shard"], row["level"]):
                yield from flush()
                held = []
            held.append(row)
    if held:
        yield from flush()


class _Block:
    """A block put together again: for each token the counts of its n-grams and of their contexts."""

    def __init__(self, layout: dict, answers: list[dict], order: int, without: bool, docs_seen: int):
        head, words, tokens, body = np.frombuffer(layout["counts"][:32], dtype="<u8").tolist()
        self.docs = pa.ipc.open_stream(layout["counts"][32 : 32 + head]).read_all()
        unique = unpack_sorted(layout["keys"], words)
        back = unpack(layout["counts"][32 + head : 32 + head + body], tokens, np.uint32)
        self.first = np.concatenate([[0], np.cumsum(self.docs.column("tokens").to_numpy())])
        self.count = []
        for level, key in enumerate(keys_of(unique[back], self.first, order), 1):
            got = [unpack(a["counts" if without else "keys"], a["n"], np.uint64) for a in answers if a["level"] == level]
            counts = np.concatenate(got).astype(np.float64)
            self.count.append(counts[back] if level == 1 else counts[np.unique(key, return_inverse=True)[1]])
        self.context = []
        for counts in self.count[:-1]:
            before = np.empty_like(counts)
            before[1:] = counts[:-1]
            before[self.first[:-1]] = docs_seen
            self.context.append(before)

    def estimates(self, total: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each token, and its estimates: uniform, then each order (0 where a context is unseen)."""
        n = len(self.count[0])
        p = np.zeros((len(self.count) + 1, n))
        p[0] = 1 / (words + 1)
        p[1] = self.count[0] / max(total, 1)
        bucket = np.zeros(n, dtype=np.int64)
        for k, before in enumerate(self.context):
            seen = before > 0
            p[k + 2][seen] = self.count[k + 1][seen] / before[seen]
            bucket[seen] = 64 * (k + 1) + np.log2(before[seen]).astype(np.int64)
        return bucket, p


def _each_block(rows: DataFrame, order: int, without: bool, docs_seen: int, use, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, answers = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == LAYOUT:
                    if layout:
                        yield use(_Block(layout, answers, order, without, docs_seen))
                    layout, answers = row, []
                else:
                    answers.append(row)
        if layout:
            yield use(_Block(layout, answers, order, without, docs_seen))

    whole = rows.filter(F.col("kind").isin(LAYOUT, ANSWER)).select("kind", "block", "level", "shard", "n", "keys", "counts")
    return whole.repartition("block").sortWithinPartitions("block", "kind", "level", "shard").mapInArrow(run, schema)


def expectation_maximisation(ratios: np.ndarray, weight: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Mixture weights for held-out tokens in classes: ``ratios`` (class x estimate), and how many of each."""
    use = ratios.max(axis=0) > 0
    mixture = use / use.sum()
    for _ in range(rounds):
        share = ratios * mixture
        new = (weight[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / weight.sum()
        if np.abs(new - mixture).max() < 1e-6:
            mixture = new
            break
        mixture = new
    mixture[0] = max(mixture[0], LEAST_UNIFORM)
    return mixture / mixture.sum()


def score(docs: DataFrame, train: Column, held_out: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of ``docs``.

    Tokens are words between ASCII white space, ASCII capitals lowered, then one end; a null or empty text has
    the end alone. Rows where ``train`` holds are learnt from. base_score adds one to each word count; score is
    the mixture's log10 probability of the text, end included. A repeated row counts each time. Without any
    training row every token has probability one. Other columns are not looked at.
    """
    source = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    ).withColumn("deleted", F.col("train") & (F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(DELETED)) == 0))
    kind = source.schema["doc_id"].dataType.simpleString()
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    shards = max(8, math.ceil(size / SHARD_BYTES))
    sent = source.mapInArrow(_blocks(order, shards), _EXCHANGE)
    # one shard a partition: hashed numbers would leave some partitions with several and some with none
    counted = materialize(sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "level").mapInArrow(_answer, _EXCHANGE), "none")
    numbers = counted.groupBy().agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == LAYOUT, F.col(c))), F.lit(0)).alias(c) for c in ("train_tokens", "train_docs", "deleted_tokens", "deleted_docs")),
        *(F.coalesce(F.sum(F.when(F.col("kind") == SIZES, F.col(c))), F.lit(0)).alias(a) for c, a in (("n", "words"), ("train_docs", "words_left"))),
    ).first()
    left, left_docs = numbers.train_tokens - numbers.deleted_tokens, numbers.train_docs - numbers.deleted_docs
    names = [f"r{k}" for k in range(1, order + 1)]

    def ratios(b: _Block) -> pa.RecordBatch:
        """Held-out tokens counted by bucket and by classes of their estimates against the uniform one."""
        bucket, p = b.estimates(left, numbers.words_left)
        with np.errstate(divide="ignore"):
            x = np.where(p[1:] > 0, np.round(np.log(p[1:] / p[0]) / RATIO_STEP), -(10**6)).astype(np.int64)
        classes, n = np.unique(np.vstack([bucket, x]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in classes), pa.array(n)], names=["bucket", *names, "n"])

    found = _each_block(counted.filter("deleted"), order, True, left_docs, ratios, ", ".join(f"{c} long" for c in ["bucket", *names, "n"]))
    # as many rows as there are classes, whatever the corpus: logarithms of counts and ratios
    table = np.array([[r.bucket, *(r[c] for c in names), r.n] for r in found.groupBy("bucket", *names).agg(F.sum("n").alias("n")).collect()], dtype=np.int64).reshape(-1, order + 2)
    against = np.where(table[:, 1:-1] > -(10**6), np.exp(table[:, 1:-1] * RATIO_STEP), 0)
    against = np.hstack([np.ones((len(table), 1)), against])
    pooled = expectation_maximisation(against, table[:, -1].astype(float)) if len(table) else np.full(order + 1, 1 / (order + 1))
    weights = {int(b): expectation_maximisation(against[table[:, 0] == b], table[table[:, 0] == b, -1].astype(float)) for b in np.unique(table[:, 0])}
    total, words, docs_seen = numbers.train_tokens, numbers.words, numbers.train_docs

    def judged(b: _Block) -> pa.RecordBatch:
        bucket, p = b.estimates(total, words)
        mixed = np.empty(len(bucket))
        for k in np.unique(bucket).tolist():
            mine = bucket == k
            mixture = weights.get(k, pooled).copy()
            mixture[2 + k // 64 :] = 0  # contexts that are unseen
            if not total:
                mixture[1:] = 0
            mixture = mixture / mixture.sum() if mixture.sum() else np.eye(order + 1)[0]
            mixed[mine] = mixture @ p[:, mine]
        sums = lambda x: np.add.reduceat(x, b.first[:-1])  # noqa: E731  each text has a token at least
        base = np.log10((b.count[0] + 1) / (total + words + 1))
        n = b.docs.num_rows
        return pa.RecordBatch.from_arrays(
            [
                b.docs.column("doc_id").combine_chunks(),
                b.docs.column("held_out").combine_chunks(),
                pa.array(np.diff(b.first)),
                pa.array(sums((b.count[0] > 0).astype(np.int64))),
                pa.array(np.full(n, total, dtype=np.int64)),
                pa.array(sums(base)),
                pa.array(sums(np.log10(mixed))),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _each_block(counted, order, False, docs_seen, judged, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
