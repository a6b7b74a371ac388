"""Benchmark decontamination by an FM-index over each shard of the training texts.

A shard is a bounded batch of documents inside one task. Its words become symbols of the benchmark's own
vocabulary; runs of such words at least as long as the shortest window (nothing else can match) are joined,
with a separator of its own after each run. Suffixes are sorted, the BWT goes into a wavelet matrix, windows
are searched backwards by its ranks, and occurrences are located by walking to sampled suffix positions.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.llm.common import grouped_slices, materialize, open_shared, scratch_dir, text_or_empty, utf8
from loopmill.llm.wordscan import ALNUM, Words, scan

WINDOW_WORDS = 10
SHARD_BYTES = 8 << 20
SAMPLE_EVERY = 16
#: Benchmark text of one block of windows. All blocks are searched; a task reads them from the shared folder and
#: keeps the last BLOCKS_HELD.
BLOCK_BYTES, BLOCKS_HELD = 4 << 20, 4


class FMIndex:
    """Full-text index of an int array in which 0 is a separator, each one smaller than the next."""

    def __init__(self, symbols: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        n = len(symbols)
        order = self._suffixes(symbols)
        self.bwt = symbols[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        # positions kept: each multiple of `every`, and each first one after a separator
        kept = (order % every == 0) | (self.bwt == 0)
        self.sampled = np.cumsum(kept) - 1
        self.kept, self.positions = kept, order[kept]
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []
        level = self.bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1 == 1
            zeros = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((zeros, int(zeros[-1])))
            level = np.concatenate([level[~one], level[one]])
        counts = np.bincount(self.bwt, minlength=1 << self.bits)
        # where each symbol starts on the last level: symbols stand there in bit-reversed order
        names = np.arange(1 << self.bits)
        reverse = np.zeros_like(names)
        for b in range(self.bits):
            reverse |= ((names >> b) & 1) << (self.bits - 1 - b)
        by = np.argsort(reverse)
        self.first = np.zeros(1 << self.bits, dtype=np.int64)
        self.first[by] = np.cumsum(counts[by]) - counts[by]

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """Prefix doubling; the separators are told apart by place, so no comparison passes one."""
        n = len(symbols)
        gaps = symbols == 0
        rank = symbols.astype(np.int64) + int(gaps.sum())
        rank[gaps] = np.arange(int(gaps.sum()))
        step = 1
        while True:
            key = rank * np.int64(2 * n + len(symbols) + rank.max() + 2)
            key[:-step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.empty(n, dtype=np.int64)
            new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = new
            if n < 2 or rank.max() == n - 1:
                return order
            step *= 2

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the BWT before each row."""
        at = row
        for b, (zeros, total) in zip(range(self.bits - 1, -1, -1), self.levels):
            z = zeros[at]
            at = np.where((symbol >> b) & 1 == 1, total + at - z, z)
        return at - self.first[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern (padded rows of symbols)."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), len(self.bwt), dtype=np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > step) & (low < high))
            c = patterns[live, lengths[live] - 1 - step]
            low[live] = self.below[c] + self.rank(c, low[live])
            high[live] = self.below[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, each by steps back to a sampled one."""
        out, at, steps = np.empty(len(rows), dtype=np.int64), rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.kept[at[open_]]
            hit = open_[done]
            out[hit] = self.positions[self.sampled[at[hit]]] + steps[hit]
            open_ = open_[~done]
            c = self.bwt[at[open_]]
            at[open_] = self.below[c] + self.rank(c, at[open_])
            steps[open_] += 1
        return out


@dataclass
class Windows:
    """A block of the benchmark: vocabulary (sorted word hashes), distinct windows, and items of each."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray  #: items of all windows, window by window
    item_from: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes], window: int) -> Windows:
        w = scan(texts, ALNUM)
        vocabulary = np.unique(w.hash)
        symbol = np.searchsorted(vocabulary, w.hash) + 1
        n = np.diff(w.first)
        size = np.minimum(n, window)
        many = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(texts)), many)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        start, length = w.first[:-1][item] + nth, size[item]
        grid = start[:, None] + np.arange(window)
        rows = np.where(np.arange(window) < length[:, None], symbol[np.minimum(grid, max(len(symbol) - 1, 0))] if len(symbol) else 0, 0)
        patterns, back = np.unique(rows.reshape(-1, window), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([back.ravel(), item], axis=1), axis=0)
        return cls(vocabulary, patterns, (patterns > 0).sum(axis=1), pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)))

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word of each occurrence, and its window."""
        nothing = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not len(self.patterns) or not len(w.hash):
            return nothing
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == w.hash
        # runs of known words, broken at document borders
        edge = np.zeros(len(known) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = known[1:] != known[:-1]
        edge[w.first] = True
        cut = np.flatnonzero(edge)
        begin, size = cut[:-1], np.diff(cut)
        keep = known[begin] & (size >= self.lengths.min())
        begin, size = begin[keep], size[keep]
        if not len(begin):
            return nothing
        place = np.arange(size.sum() + len(size)) - np.repeat(np.cumsum(size + 1) - size - 1 - begin, size + 1)
        ends = np.cumsum(size + 1) - 1
        symbols = at[np.minimum(place, len(at) - 1)] + 1
        symbols[ends] = 0
        index = FMIndex(symbols.astype(np.int64), len(self.vocabulary) + 1)
        low, high = index.search(self.patterns, self.lengths)
        many = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(many)), many)
        rows = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return place[index.locate(rows)], which


def merged_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [start, stop) intervals as sorted, disjoint ones."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > stop[:-1]
    last = np.ones(len(start), dtype=bool)
    last[:-1] = new[1:]
    return start[new], stop[last]


def _search(folder: str, blocks: list[str], text: str) -> Callable:
    """A pass over documents that fills n_words, spans and items from the blocks of windows in ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_shared(folder)

        @lru_cache(maxsize=BLOCKS_HELD)
        def block(name: str) -> tuple[Windows, list[str | None]]:
            with fs.open_input_file(f"{base}/{name}") as file:
                return pickle.loads(file.read())

        for batch in grouped_slices(batches, text, SHARD_BYTES):
            w = scan(utf8(batch.column(text)), ALNUM)
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for windows, ids in map(block, blocks):
                start, which = windows.occurrences(w)
                doc = np.searchsorted(w.first, start, "right") - 1
                order = np.argsort(doc, kind="stable")
                bounds = np.searchsorted(doc[order], np.arange(batch.num_rows + 1))
                for d in np.unique(doc).tolist():
                    mine = order[bounds[d] : bounds[d + 1]]
                    a = start[mine] - w.first[d]
                    b = a + windows.lengths[which[mine]]
                    if old := spans[d]:
                        a, b = np.concatenate([a, old[0::2]]), np.concatenate([b, old[1::2]])
                    a, b = merged_spans(a, b)
                    spans[d] = np.stack([a, b], axis=1).ravel().tolist()
                    found = np.concatenate([windows.item_of[windows.item_from[p] : windows.item_from[p + 1]] for p in np.unique(which[mine]).tolist()])
                    items[d] = sorted({*items[d], *(ids[i] for i in np.unique(found).tolist() if ids[i] is not None)})
            new = {"n_words": pa.array(np.diff(w.first)), "spans": pa.array(spans, type=pa.list_(pa.int64())), "items": pa.array(items, type=pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return run


def write_blocks(blocks: DataFrame, folder: str, window: int) -> list[str]:
    """Windows of each block, built by a task and written to the shared folder; returns the files' names.

    A task that runs again writes files of its own, and only those of tasks that succeeded are named.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_shared(folder)

        def build(rows: list[tuple[str | None, str]]) -> str:
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.windows"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as file:
                file.write(pickle.dumps((Windows.build([t.encode() for _, t in rows], window), [i for i, _ in rows])))
            return name

        number, rows = None, []
        for batch in batches:
            for at, item, text in zip(*(batch.column(c).to_pylist() for c in ("block", "item", "text"))):
                if at != number and rows:
                    yield pa.RecordBatch.from_arrays([pa.array([number], type=pa.int64()), pa.array([build(rows)])], names=["block", "name"])
                    rows = []
                number = at
                rows.append((item, text))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([number], type=pa.int64()), pa.array([build(rows)])], names=["block", "name"])

    # a block is of block_bytes, so a task holds one at a time
    dealt = blocks.repartition("block").sortWithinPartitions("block", "item", "text")
    return [r.name for r in materialize(dealt.mapInArrow(run, "block long, name string")).orderBy("block").collect()]


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> DataFrame:
    """Items dealt into blocks of about ``block_bytes``, by one running sum over item sizes in two levels."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), text_or_empty(text).alias("text")).distinct()
    sized = rows.withColumns({"size": F.octet_length("text") + 16, "deal": F.pmod(F.xxhash64("item", "text"), F.lit(1024))})
    totals = sized.groupBy("deal").agg(F.sum("size").alias("total"))
    before = Window.orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("deal", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("deal").orderBy("item", "text")
    return sized.join(totals, "deal").select("item", "text", F.floor((F.col("before") + F.sum("size").over(inside) - F.col("size")) / block_bytes).alias("block"))


def find_spans(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (first word and end of each removal span, flat) and ``items``.

    All windows of ``window`` consecutive item words count; an item with fewer words is one window. Null texts
    have no words; an item with a null id marks spans without being listed; repeated rows and items change
    nothing else. An empty benchmark finds nothing. Columns of ``docs`` named like these three are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    blocks = benchmark_blocks(benchmark, item_id, item_text, block_bytes)
    out = docs.select(*kept).withColumns({text: F.col(text).cast("string"), "n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<bigint>"), "items": F.array().cast("array<string>")})
    folder = scratch_dir(docs.sparkSession) + "/benchmark"
    return out.mapInArrow(_search(folder, write_blocks(blocks, folder, window), text), out.schema)


def span_words(spans: str = "spans"):
    """Words inside the spans."""
    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(spans) - 2, F.lit(0)), F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.coalesce(F.try_element_at(F.col(spans), i + 2) - F.try_element_at(F.col(spans), i + 1), F.lit(0)))


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """Cut the spans that ``find_spans`` gave out of the texts, words and what stands between them.

    What stands before and after a span stays as it is. A text without spans comes back unchanged, null too.
    """
    schema = found.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_slices(batches, text, SHARD_BYTES):
            texts, spans = batch.column(text).to_pylist(), batch.column("spans").to_pylist()
            for i, s in enumerate(spans):
                if s:
                    raw = texts[i].encode()
                    w = scan([raw], ALNUM)
                    keep, at = [], 0
                    for a, b in zip(s[0::2], s[1::2]):
                        keep.append(raw[at : w.start[a]])
                        at = int(w.end[b - 1])
                    texts[i] = b"".join([*keep, raw[at:]]).decode()
            k = batch.schema.names.index(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, type=batch.schema.field(k).type))

    return found.mapInArrow(run, schema)


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
