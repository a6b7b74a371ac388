"""Least ways over one large network, block by block.

Nodes are cut by place into blocks of about BLOCK of them. A task searches one block at a time, from what is known of the
nodes that other blocks lead to, and offers ways to the nodes of other blocks; rounds end when no offer is better. So
there are some rounds for each block that a way passes, not for each street, and no task holds more than a block.

What is known of a node is (dist, steps), the length and the number of streets of a way; the least of both decides. Each
street adds a step, so that nodes before each other never form a ring, streets of no length included.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loopmill.functions.scratch import settle, unbroadcast

#: Nodes of a block, about (some 400 bytes each in the task that searches it).
BLOCK = 50_000
#: Tasks of a round, at most.
MOST_TASKS = 10_000


def blocks(ids: DataFrame, nodes: DataFrame, size: int | None = None) -> DataFrame:
    """node_id, block of each of ``ids`` (node_id): strips of latitude of as many nodes each, cut alike by longitude.

    Nodes without a place are dealt to the blocks by hash.
    """
    size = size or BLOCK
    at = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    known = nodes.filter("node_id IS NOT NULL").groupBy("node_id").agg(F.min(F.struct(at("lat").alias("lat"), at("lon").alias("lon"))).alias("x"))
    placed = settle(ids.join(unbroadcast(known), "node_id", "left").select("node_id", "x.lat", "x.lon"))
    side = max(isqrt(max(ceil(placed.count() / size) - 1, 0)) + 1, 1)
    anywhere = F.pmod(F.xxhash64("node_id"), F.lit(side * side)).cast("int")
    if side == 1:
        return placed.select("node_id", F.lit(0).alias("block"))
    shares, exact = [k / side for k in range(1, side)], 100 * side
    here = placed.filter("lat IS NOT NULL AND lon IS NOT NULL")
    bounds = here.approxQuantile("lat", shares, 1 / exact)
    strip = sum((F.when(F.col("lat") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    cuts = here.groupBy(strip.alias("strip")).agg(F.percentile_approx("lon", shares, exact).alias("cuts"))
    cut = placed.withColumn("strip", strip).join(F.broadcast(cuts), "strip", "left")
    own = F.col("strip") * side + F.size(F.filter("cuts", lambda c: c <= F.col("lon")))
    return cut.select("node_id", F.when(F.col("lat").isNull() | F.col("lon").isNull(), anywhere).otherwise(own.cast("int")).alias("block"))


def least_ways(start: DataFrame, light: DataFrame, nodes: DataFrame, keys: list[str], shared: list[str], max_m: float | None, most_rounds: int, size: int | None = None) -> DataFrame:
    """keys, source, node_id, dist, before: a least way from each of ``start`` (keys, source) to each node it reaches.

    ``light`` has single streets (shared, u, v, length), ``nodes`` node_id, lat and lon.
    """
    by, here = [*keys, "source"], [*keys, "source", "block"]
    ids = light.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    placed = settle(blocks(ids, nodes, size))
    end = lambda c, name: placed.select(F.col("node_id").alias(c), F.col("block").alias(name))
    streets = settle(light.filter("u <> v").join(end("u", "block"), "u").join(end("v", "to_block"), "v"))
    out = streets.groupBy(*shared, "block").agg(F.collect_list(F.struct("u", "v", "length", "to_block")).alias("x"))
    # nodes that other blocks lead to
    into = streets.filter("block <> to_block").groupBy(*shared, F.col("to_block").alias("block")).agg(F.collect_set("v").alias("entries"))
    part = lambda c: F.transform("x", lambda x: x[c]).alias(c)
    packed = settle(out.join(into, [*shared, "block"], "full").select(*shared, "block", "entries", *(part(c) for c in ("u", "v", "length", "to_block"))))

    kind = light.schema["u"].dataType
    known = start.withColumn("node_id", F.col("source")).join(placed, "node_id", "left")
    first = {"dist": F.lit(0.0), "steps": F.lit(0).cast("long"), "new": F.lit(1), "before": F.lit(None).cast(kind)}
    state = settle(known.select(*by, "node_id", F.coalesce("block", F.lit(-1)).alias("block"), *(c.alias(n) for n, c in first.items())))

    def searched(asked: DataFrame, tasks: int, every: bool) -> DataFrame:
        """What is found from the known nodes of each block: of ``every`` node of it, or of those between blocks."""
        lists = asked.groupBy(*here).agg(F.collect_list(F.struct("node_id", "dist", "steps", "before")).alias("from"))
        met = unbroadcast(lists).join(unbroadcast(packed), [*shared, "block"], "left").repartition(min(max(tasks, 1), MOST_TASKS))
        schema = StructType([*asked.select(*by, "node_id", "block", "dist", "steps", "new", "before").schema])
        columns = to_arrow_schema(schema)
        return met.mapInArrow(lambda batches: _search_rows(batches, columns, by, max_m, every), schema)

    for _ in range(most_rounds):
        open_ = state.filter("new = 1").select(*here).distinct()
        tasks = open_.count()
        if not tasks:
            break
        found = searched(unbroadcast(state).join(unbroadcast(open_), here, "left_semi"), tasks, False)
        # of equal ways what a block has found itself stays, so that only better offers make it search again
        both = state.withColumn("new", F.lit(0)).unionByName(found)
        best = both.groupBy(*by, "node_id", "block").agg(F.min(F.struct("dist", "steps", "new", "before")).alias("x"))
        state = settle(best.select(*by, "node_id", "block", "x.*"))
    else:
        raise RuntimeError("shortest paths did not settle")
    return searched(state, state.select(*here).distinct().count(), True).select(*by, "node_id", "dist", "before")


def _search_rows(batches: Iterator[pa.RecordBatch], columns: pa.Schema, by: list[str], max_m: float | None, every: bool) -> Iterator[pa.RecordBatch]:
    most = float("inf") if max_m is None else max_m
    for batch in batches:
        for k in range(batch.num_rows):
            cell = lambda c: batch.column(c)[k]  # noqa: B023, E731
            block, from_ = cell("block").as_py(), cell("from").as_py()
            array = lambda c: cell(c).values.to_numpy(zero_copy_only=False) if cell(c).is_valid else np.empty(0, dtype=np.int64)  # noqa: B023, E731
            names, at, dist, steps, before = _search(array("u"), array("v"), array("length"), from_, most)
            outside = dict(zip(array("v").tolist(), array("to_block").tolist()))
            entries = set(array("entries").tolist())
            if every:
                rows = [(i, block, 0) for i in at if outside.get(names[i], block) == block]
            else:
                to = ((i, outside.get(names[i], block)) for i in at)
                rows = [(i, b, int(b != block)) for i, b in to if b != block or names[i] in entries]
            if not rows:
                continue
            made = {"node_id": [names[i] for i, _, _ in rows], "block": [b for _, b, _ in rows], "dist": [dist[i] for i, _, _ in rows]}
            made |= {"steps": [steps[i] for i, _, _ in rows], "new": [n for _, _, n in rows], "before": [before[i] for i, _, _ in rows]}
            made |= {c: [cell(c).as_py()] * len(rows) for c in by}
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in columns], schema=columns)


def _search(u: np.ndarray, v: np.ndarray, length: np.ndarray, from_: list[dict], most: float) -> tuple[list, list[int], list[float], list[int], list]:
    """(names, reached, dist, steps, before) over the streets of one block; nodes of other blocks lead no further."""
    seeds = [x["node_id"] for x in from_]
    names = np.unique(np.concatenate([u, v, np.array(seeds, dtype=u.dtype if len(u) else None)])) if len(u) else np.unique(np.array(seeds))
    n = len(names)
    tails = np.searchsorted(names, u)
    order = np.argsort(tails, kind="stable")
    first = np.searchsorted(tails[order], np.arange(n + 1)).tolist()
    heads, metres = np.searchsorted(names, v)[order].tolist(), length[order].tolist()
    place = np.searchsorted(names, np.array(seeds, dtype=names.dtype)).tolist()
    names = names.tolist()
    dist, steps, before, heap = [float("inf")] * n, [0] * n, [None] * n, []
    for i, x in zip(place, from_):
        dist[i], steps[i], before[i] = x["dist"], x["steps"], x["before"]
        heap.append((x["dist"], x["steps"], i))
    heapq.heapify(heap)
    done, reached = [False] * n, []
    while heap:
        d, s, i = heapq.heappop(heap)
        if done[i]:
            continue
        done[i] = True
        reached.append(i)
        for j in range(first[i], first[i + 1]):
            x, far = heads[j], d + metres[j]
            if far <= most and (far < dist[x] or (far == dist[x] and s + 1 < steps[x])):
                dist[x], steps[x], before[x] = far, s + 1, names[i]
                heapq.heappush(heap, (far, s + 1, x))
    return names, reached, dist, steps, before
