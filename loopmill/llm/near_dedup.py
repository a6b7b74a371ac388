"""Near-duplicate documents by min-max hashing over distinct word shingles.

Every permutation gives two signature values, its minimum and its maximum over the set, so that half the hash
evaluations fill a signature. Bands of the signature name candidates; each link is confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopmill.llm.common import grouped_slices, materialize, small_side, text_or_empty, utf8
from loopmill.llm.components import components, open_members, stars
from loopmill.llm.wordscan import Words, mix, scan

BATCH_BYTES = 4 << 20
#: 36 bands of 5 values: a pair at 0.85 is missed once in 10**9, at 0.8 once in a million.
BANDS, ROWS = 36, 5
#: Members of a hub that stand beside one copy of its text.
PART_ROWS = 1_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in one array; and where each text's begin, and the end.

    A text with fewer words than ``size``, but not none, has its whole word sequence as one shingle.
    """
    n = np.diff(w.first)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    length = np.minimum(n, size)
    doc = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = w.first[:-1][doc] + nth
    value = np.full(len(doc), np.uint64(0x27D4EB2F165667C5))
    for k in range(size):
        inside = k < length[doc]
        step = w.hash[np.minimum(at + k, max(len(w.hash) - 1, 0))] if len(w.hash) else value
        value = np.where(inside, mix(value * _ODD + step), value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minmax_bands(value: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash for each text (with a shingle) and band. ``bounds`` has no empty text."""
    texts = len(bounds) - 1
    signature = np.empty((bands * rows + 1, texts), dtype=np.uint64)
    factor, shift = _permutations((bands * rows + 1) // 2)
    starts, at = bounds[:-1], 0
    while at < texts:  # a few texts at a time, so that their hashes stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 16_384, "right")) - 1)
        part, cut = value[bounds[at] : bounds[to]], starts[at:to] - bounds[at]
        hashed = np.empty_like(part)
        for k in range(len(factor)):
            np.multiply(part, factor[k], out=hashed)
            hashed += shift[k]
            signature[2 * k, at:to] = np.minimum.reduceat(hashed, cut)
            signature[2 * k + 1, at:to] = np.maximum.reduceat(hashed, cut)
        at = to
    out = np.empty((texts, bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(texts, np.uint64(b + 1))
        for r in range(rows):
            h = mix(h * _ODD + signature[b * rows + r])
        out[:, b] = h
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a digest of the whole set; null if empty) and bands (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_slices(batches, "text", BATCH_BYTES):
            value, bounds = shingles(scan(utf8(batch.column("text"))), size)
            n = np.diff(bounds)
            full = np.flatnonzero(n > 0)
            hashes = minmax_bands(value, np.append(bounds[:-1][full], bounds[-1]), bands, rows).view(np.int64) if len(full) else np.zeros((0, bands), dtype=np.int64)
            place = np.full(len(n), -1)
            place[full] = np.arange(len(full))
            raw = value.tobytes()
            keys = [hashlib.blake2b(raw[a * 8 : b * 8], digest_size=16).digest() if b > a else None for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            lists = [None if p < 0 else hashes[p] for p in place.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(keys, type=pa.binary()), pa.array(lists, type=pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands"]
            )

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_key binary, bands array<bigint>")


def beside_hubs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``pairs`` (node, hub, others) with the node's text, and the hub's own text before them.

    Sorted within partitions by hub and part: first rows with member = false and the hub's text, which has no
    node, then those of its members. A hub of more than PART_ROWS members is in several parts, so that the rows
    stay in proportion to the pairs, no task has all of a hub, and a hub's text is there once for each part.
    ``texts`` has node and text.
    """
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    needed = materialize(texts.join(small_side(wanted), "node", "left_semi"))
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART_ROWS).cast("long").alias("parts"))
    sized = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("node"), "parts")).drop("parts")
    members = sized.join(needed, "node").withColumn("member", F.lit(True))
    hubs = needed.withColumnRenamed("node", "hub").join(parts, "hub").select("hub", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"))
    rows = members.unionByName(hubs, allowMissingColumns=True)
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member")


def _against_hubs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Batches of ``beside_hubs``, each with (row, its set, its hub's set) of its members, in order.

    Where rows repeat the hub's id with other texts, a member comes once for each different text.
    """
    key, held = None, {}
    for batch in grouped_slices(batches, "text", BATCH_BYTES):
        texts = utf8(batch.column("text"))
        value, bounds = shingles(scan(texts), size)
        found = []
        for i, (hub, part, member) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "part", "member")))):
            own = value[bounds[i] : bounds[i + 1]]
            if key != (hub, part):
                key, held = (hub, part), {}
            if member:
                found += [(i, own, hub_set) for hub_set in held.values()]
            else:
                held[hashlib.blake2b(texts[i], digest_size=16).digest()] = own.copy()
        yield batch, found


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the pairs (node, hub), those with 100 * |A & B| >= percent * |A | B| on full shingle sets, as (a, b).

    ``texts`` has node and text. Sets are built anew from the texts of the pairs alone, a hub's once for each part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _against_hubs(batches, size):
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, own, hub_set in found:
                at = np.minimum(np.searchsorted(hub_set, own), max(len(hub_set) - 1, 0))
                both = int((hub_set[at] == own).sum()) if len(hub_set) and len(own) else 0
                keep[i] |= both > 0 and 100 * both >= percent * (len(own) + len(hub_set) - both)
            linked = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([linked.column("node"), linked.column("hub")], names=["a", "b"])

    kind = pairs.schema["node"].dataType.simpleString()
    return beside_hubs(pairs, texts).select("node", "hub", "part", "member", "text").mapInArrow(run, f"a {kind}, b {kind}")


def across_components(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (node, hub) to confirm among ``members`` (node, component, hub) of one hub and different components.

    Sets that are similar to one hub are far too alike for a prefix filter on themselves, so it works on what
    tells each from the hub: the symmetric difference E of a set A with the hub's. For linked sets A and B,
    |E_A and E_B| is at least (|E_A| + |E_B| - t) / 2, where t = (100 - p) / (100 + p) * (|A| + |B|) bounds their
    own difference. That is above 0 here: else both would be linked with the hub, to which all members were
    compared, and so be in one component. In one order of shingles (those that the hub lacks first), a pair must
    then share one of the first t + 1 of E, so early that enough can follow it. No linked pair is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _against_hubs(batches, size):
            tokens, sizes, differences = [np.zeros(0, dtype=np.int64)], [], []
            for _, own, hub_set in found:
                both = np.concatenate([np.setdiff1d(own, hub_set, assume_unique=True), np.setdiff1d(hub_set, own, assume_unique=True)])
                most = (100 - percent) * (len(own) + len(own) * 100 // percent + 1) // (100 + percent)
                tokens.append(both[: most + 1].view(np.int64))
                differences.append(len(both))
                sizes.append(len(own))
            n = np.array([len(x) for x in tokens[1:]], dtype=np.int64)
            nth = np.repeat(np.arange(len(n)), n)
            at = pa.array(np.array([i for i, _, _ in found], dtype=np.int64)[nth])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in ("node", "hub", "component")),
                    pa.array(np.concatenate(tokens)),
                    pa.array(np.arange(len(nth)) - np.repeat(np.cumsum(n) - n, n)),
                    pa.array(np.array(differences, dtype=np.int64)[nth]),
                    pa.array(np.array(sizes, dtype=np.int64)[nth]),
                ],
                names=["node", "hub", "component", "token", "place", "e", "n"],
            )

    kind = members.schema["node"].dataType.simpleString()
    named = materialize(members.filter("node <> hub").select("node", "hub", "component").distinct())
    rows = beside_hubs(named, texts).select("node", "hub", "component", "part", "member", "text")
    rows = materialize(rows.mapInArrow(run, f"node {kind}, hub {kind}, component {kind}, token long, place long, e long, n long"))
    # what a hub has by itself all others lack alike: its largest component is therefore met by the others alone
    kinds = rows.filter("place = 0").groupBy("hub", "component").agg(F.count("*").alias("many"))
    largest = kinds.groupBy("hub").agg(F.max_by("component", F.struct("many", "component")).alias("main"))
    rows = rows.join(small_side(materialize(largest)), "hub")
    side = lambda x: rows.select("hub", "token", "main", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "component", "place", "e", "n")))
    follow = 1 + F.least(F.col("a_e") - F.col("a_place"), F.col("b_e") - F.col("b_place")) - 1
    enough = 2 * follow * (100 + percent) >= (F.col("a_e") + F.col("b_e")) * (100 + percent) - (100 - percent) * (F.col("a_n") + F.col("b_n"))
    close = F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent
    others = side("a").filter("a_component <> main").drop("main")
    once = (F.col("b_component") == F.col("main")) | (F.col("a_node") < F.col("b_node"))
    pairs = others.join(side("b"), ["hub", "token"]).filter((F.col("a_component") != F.col("b_component")) & once & close & enough)
    # the smaller id, named hub here, is the side whose text stands once for each part
    return pairs.select(F.greatest("a_node", "b_node").alias("node"), F.least("a_node", "b_node").alias("hub")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``.

    Documents with equal, non-empty shingle sets are one class. Classes are linked when ``confirm`` holds.
    A document without words is linked with nothing and has itself as component. Rows of equal id are each
    judged by their own text, and all links of an id hold for all its rows. A null id comes back with a null
    component and kept = true; nothing links to it. Other columns are not looked at.
    """
    signed = materialize(signatures(docs, doc_id, text, size, bands, rows))
    usable = signed.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("high"))
    # a class is known by its smallest id; a row that repeats an id with another text brings its own class
    members = usable.join(classes, "set_key").filter(F.col("doc_id") == F.col("node")).select("node", "n_shingles", "bands", "set_key").dropDuplicates(["set_key"])
    buckets = members.select("node", "n_shingles", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("bucket"), "node", "n_shingles")
    crowd = materialize(buckets.join(buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket"), "bucket"), "lz4")
    texts = docs.select(F.col(doc_id).alias("node"), text_or_empty(text).alias("text")).filter("node IS NOT NULL")
    # hubs of two kinds: the smallest id, and the member that meets most others, as an original meets its copies
    sizes = crowd.groupBy("bucket").agg(F.count("*").alias("n"))
    central = crowd.join(sizes, "bucket").groupBy("node").agg((-F.sum("n")).alias("rank"))
    ranked = crowd.join(central, "node")
    rough = stars(crowd).unionByName(stars(ranked, "rank"))
    # each pair once, even if either side is a hub of the other
    rough = rough.groupBy(F.least("node", "hub").alias("low"), F.greatest("node", "hub").alias("high")).agg(F.max("hub").alias("hub"))
    rough = rough.select(F.when(F.col("hub") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("node"), "hub")
    first = materialize(confirm(materialize(rough), texts, size, percent))
    # what is still apart in some bucket: its most central member has been compared with all others there
    hubs = ranked.groupBy("bucket").agg(F.min_by("node", F.struct("rank", "node")).alias("hub"))
    apart = open_members(crowd, components(first)).join(hubs, "bucket").select("node", "component", "hub")
    rest = across_components(apart, texts, size, percent)
    links = first.unionByName(confirm(materialize(rest), texts, size, percent))
    copies = usable.join(classes, "set_key").filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(links.unionByName(copies))
    out = signed.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
