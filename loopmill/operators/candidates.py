"""Candidate loops for many requests at once, on networks that requests of one place share.

Requests near each other, with like radii, form a group: its network is read and packed once, and slices of its
requests meet it. A request uses what lies in its own box alone. Starts and stops are placed by joins over cells; ways
between stops come from a helper that holds one network, or, for networks beyond a bound, from joins alone.

All draws are digests of (seed, request, strategy, attempt, draw), so that a task that runs again draws alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.functions.geo import METRES_PER_DEGREE, destination, search_bounds
from loopmill.functions.scratch import settle, unbroadcast
from loopmill.operators import graph
from loopmill.operators.graph import BOX, dedupe_routes, nearest_in_box, nodes_in_boxes, subgraph, too_few, validate_routes, with_boxes

# Bearings of each strategy, attempts, stops, and routes kept before similar ones go.
LOOP_BEARINGS, LOOP_SPREAD = (0, 90, 180, 270), 45
RETURN_BEARINGS = (0, 120, 240)
RANDOM_ATTEMPTS, LEAST_STOPS, MOST_STOPS, MOST_ROUTES = 20, 2, 5, 15
NO_ROUTES = "Could not generate any valid routes in this area"
STRATEGIES = ("directional", "out_and_back", "random", "figure_eight")
BEARINGS = {"directional": LOOP_BEARINGS, "out_and_back": RETURN_BEARINGS, "random": (0,) * RANDOM_ATTEMPTS, "figure_eight": (0,)}
#: Random stops are the first different ones of so many draws.
STOP_DRAWS = 16
#: Streets of a network that one task holds (some 100 bytes each); larger networks are searched by joins.
MOST_EDGES = 1_000_000
#: Requests that meet their network in one task, on average.
SLICE = 64
#: Ways from all stops of a request are found together up to so many nodes times stops, streets to a node, and passes.
MOST_CELLS, MOST_STREETS, MOST_PASSES = 200_000, 16, 128
#: Requests of one task, on average, at most.
TASK = 256
KEYS = ["request_id", "route_no"]
#: Width in degrees of the first cells in which starts and stops are looked for.
STOP_CELL = 0.005


def draw(low: float, high: float, number: int | Column, seed: int = 0) -> Column:
    """A number from ``low`` to ``high`` for a try: 48 bits of a digest of what it is for."""
    text = lambda c: (F.lit(c) if isinstance(c, int) else c).cast("string")
    of = F.concat_ws("|", F.lit(str(seed)), text(F.col("request_id")), "strategy", text(F.col("attempt")), text(number))
    return low + (high - low) * (F.conv(F.substr(F.md5(of), F.lit(1), F.lit(12)), 16, 10).cast("double") / float(2**48))


def tries(requests: DataFrame, strategies: tuple[str, ...] = STRATEGIES[:3]) -> DataFrame:
    """``requests`` with strategy, attempt, bearing and route_no: a row for each try, in order of strategies."""
    listed = [(s, k, b) for s in strategies for k, b in enumerate(BEARINGS[s])]
    one = lambda no, s, k, b: {"route_no": F.lit(no).cast("long"), "strategy": F.lit(s), "attempt": F.lit(k), "bearing": F.lit(float(b))}
    rows = F.array(*(F.struct(*(c.alias(n) for n, c in one(no, *x).items())) for no, x in enumerate(listed)))
    return requests.withColumn("try", F.explode(rows)).select("*", "try.*").drop("try")


def directional(metres: Column, seed: int = 0) -> Column:
    """Aims (bearing, metres) of a loop into one direction: out, and on to one side."""
    out = metres * draw(0.25, 0.4, 1, seed)
    side = F.when(draw(0, 1, 3, seed) < 0.5, -1).otherwise(1)
    one = F.struct((F.col("bearing") + draw(-LOOP_SPREAD / 2, LOOP_SPREAD / 2, 2, seed)).alias("turn"), out.alias("metres"))
    two = F.struct((F.col("bearing") + side * draw(45, 90, 4, seed)).alias("turn"), (out * draw(0.8, 1.2, 5, seed)).alias("metres"))
    return F.array(one, two)


def out_and_back(metres: Column, seed: int = 0) -> Column:
    """The aim of a way out that is also the way back."""
    return F.array(F.struct(F.col("bearing").alias("turn"), (metres / 2 * draw(0.9, 1.1, 1, seed)).alias("metres")))


def figure_eight(metres: Column, seed: int = 0) -> Column:
    """Aims of two loops on opposite sides of the start."""
    return F.array(*(F.struct((F.col("bearing") + turn).alias("turn"), (metres / 8).alias("metres")) for turn in (0, 90, 180, 270)))


def random_draws(tried: DataFrame, seed: int = 0) -> DataFrame:
    """Random tries with stops (how many) and draws: STOP_DRAWS - 1 numbers from 0 to 1 that choose among other nodes."""
    stops = (LEAST_STOPS + F.floor(draw(0, MOST_STOPS - LEAST_STOPS + 1, 1, seed))).cast("int")
    draws = F.transform(F.sequence(F.lit(2), F.lit(STOP_DRAWS + 1)), lambda k: draw(0, 1, k, seed))
    return tried.filter("strategy = 'random'").select(*KEYS, stops.alias("stops"), draws.alias("draws"))


def random_stops(tried: DataFrame, own_nodes: DataFrame, seed: int = 0) -> DataFrame:
    """request_id, route_no, place, node_id: two to five nodes other than the start, by number among the request's.

    A try that draws too few different nodes, or whose request has too few, has none. By joins; ``Network.pick`` is the
    same for a network that a task holds.
    """
    own = own_nodes.join(tried.select("request_id", "start").distinct(), "request_id").filter("node_id <> start")
    numbered = own.select("request_id", "node_id", F.row_number().over(Window.partitionBy("request_id").orderBy("node_id")).alias("number"))
    counts = own.groupBy("request_id").agg(F.count("*").alias("others"))
    drawn = F.array_distinct(F.transform("draws", lambda x: F.floor(x * F.col("others")) + 1))
    picked = random_draws(tried, seed).join(counts, "request_id").withColumn("drawn", drawn).filter("others >= 2 AND size(drawn) >= stops")
    placed = picked.select(*KEYS, F.posexplode(F.slice("drawn", 1, F.col("stops"))).alias("place", "number"))
    return placed.join(numbered, ["request_id", "number"]).select(*KEYS, "place", "node_id")


def aims(tried: DataFrame, seed: int = 0) -> DataFrame:
    """request_id, route_no, place, lat, lon: where the stops of each try that is not random should be."""
    metres = F.col("target_distance_km") * 1000
    of = {"directional": directional, "out_and_back": out_and_back, "figure_eight": figure_eight}
    all_ = F.coalesce(*(F.when(F.col("strategy") == name, make(metres, seed)) for name, make in of.items()))
    rows = tried.filter("strategy <> 'random'").select(*KEYS, "lat", "lon", F.posexplode(all_).alias("place", "aim"))
    lat, lon = destination(F.col("lat"), F.col("lon"), F.col("aim.turn"), F.col("aim.metres"))
    return rows.select(*KEYS, "place", lat.alias("lat"), lon.alias("lon"))


def placed(requests: DataFrame, tried: DataFrame, boxes: DataFrame, nodes: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(request_id, start; request_id, route_no, place, node_id): the node nearest to each request and to each aim, both
    in the request's own box; ties to the smaller id. One search serves both."""
    own = requests.select("request_id", F.lit(-1).cast("long").alias("route_no"), F.lit(-1).alias("place"), "lat", "lon")
    near = settle(nearest_in_box(own.unionByName(aims(tried, seed)), boxes, nodes, [*KEYS, "place"], STOP_CELL).select(*KEYS, "place", "node_id"))
    return near.filter("place < 0").select("request_id", F.col("node_id").alias("start")), near.filter("place >= 0")


def listed(tried: DataFrame, stops: DataFrame) -> DataFrame:
    """request_id, route_no, strategy, stops: the nodes that each try goes through, from the start on, in order.

    Tries of the first two strategies end where a stop is the start itself.
    """
    by_place = stops.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("place", "node_id"))).alias("s"))
    known = tried.select(*KEYS, "strategy", "start").join(unbroadcast(by_place), KEYS).withColumn("s", F.transform("s", lambda x: x["node_id"]))
    known = known.filter(~(F.col("strategy").isin("directional", "out_and_back") & F.array_contains("s", F.col("start"))))
    start = F.array("start")
    eight = F.concat(start, F.slice("s", 1, 2), start, F.slice("s", 3, 2), start)
    loop = F.when(F.col("strategy") == "out_and_back", F.concat(start, "s")).when(F.col("strategy") == "figure_eight", eight).otherwise(F.concat(start, "s", start))
    return known.select(*KEYS, "strategy", loop.alias("stops"))


class Tree:
    """Least-length ways from one node of a network, found as far as they are asked for; among equals over the node
    nearest to the source, then by id (nodes are numbered in order of their ids)."""

    def __init__(self, source: int, out: dict[int, list[tuple[int, float]]]):
        self.out, self.dist, self.before, self.done, self.heap = out, {source: 0.0}, {source: source}, set(), [(0.0, source)]

    def way(self, target: int) -> list[int] | None:
        while target not in self.done and self.heap:
            d, u = heapq.heappop(self.heap)
            if u in self.done:
                continue
            self.done.add(u)
            for v, length in self.out.get(u, ()):
                if d + length < self.dist.get(v, float("inf")):
                    self.dist[v], self.before[v] = d + length, u
                    heapq.heappush(self.heap, (d + length, v))
        if target not in self.done:
            return None
        back = [target]
        while self.before[back[-1]] != back[-1]:
            back.append(self.before[back[-1]])
        return back[::-1]


class Trees:
    """The ways of ``Tree`` from several nodes of a small network, all at once by passes over its streets.

    ``known`` is false where such passes are no help: many nodes times sources, long ways, nodes with many streets,
    and streets that are too short to change a sum.
    """

    def __init__(self, nodes: int, u: np.ndarray, v: np.ndarray, length: np.ndarray, sources: list[int]):
        self.known, self.column = False, {s: k for k, s in enumerate(sources)}
        counted = length == length  # a street of no known length leads nowhere
        u, v, length = u[counted], v[counted], length[counted]
        held = np.bincount(v, minlength=nodes)
        if nodes * len(sources) > MOST_CELLS or held.max(initial=0) > MOST_STREETS or length.min(initial=0) < 0:
            return
        # streets by the node they lead to, and of a node by the id they come from
        order = np.lexsort((u, v))
        u, v, length = u[order], v[order], length[order]
        place = np.arange(len(v)) - (np.cumsum(held) - held)[v]
        before, metres = np.zeros((held.max(initial=0), nodes), dtype=np.int64), np.full((held.max(initial=0), nodes, 1), np.inf)
        before[place, v], metres[place, v, 0] = u, length
        dist = np.full((nodes, len(sources)), np.inf)
        dist[sources, range(len(sources))] = 0.0
        for _ in range(MOST_PASSES):
            old = dist.copy()
            for k in range(len(before)):
                np.minimum(dist, dist[before[k]] + metres[k], out=dist)
            if np.array_equal(old, dist):
                break
        else:
            return
        near, self.before = np.full(dist.shape, np.inf), np.full(dist.shape, -1)
        for k in range(len(before)):
            d = dist[before[k]]
            better = (d + metres[k] == dist) & (d < near) & (d < dist)
            near[better] = d[better]
            self.before[better] = np.broadcast_to(before[k][:, None], dist.shape)[better]
        self.dist = dist
        self.known = not ((self.before < 0) & np.isfinite(dist) & (dist > 0)).any() and (dist == 0).sum() == len(sources)

    def way(self, source: int, target: int) -> list[int] | None:
        column = self.column[source]
        if not np.isfinite(self.dist[target, column]):
            return None
        back, before = [target], self.before[:, column]
        while back[-1] != source:
            back.append(int(before[back[-1]]))
        return back[::-1]


class Network:
    """A group's network as arrays: nodes in order of id, streets in order of the node they leave."""

    def __init__(self, ids: np.ndarray, lat: np.ndarray, lon: np.ndarray, u: np.ndarray, v: np.ndarray, length: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.lat, self.lon = ids[order], lat[order], lon[order]
        u, v = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        order = np.argsort(u, kind="stable")
        self.u, self.v, self.length = u[order], v[order], length[order]

    def own(self, box: dict) -> np.ndarray:
        """Which nodes lie in a request's box."""
        inside = (self.lat >= box["s"]) & (self.lat <= box["n"])
        if box["ring"]:
            return inside
        turned = [(self.lon >= box["w"] + t) & (self.lon <= box["e"] + t) for t in (0, 360, -360)]
        return inside & (turned[0] | turned[1] | turned[2])

    def between(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streets (from, to, length) between own nodes, which are numbered among themselves."""
        at = np.flatnonzero(own[self.u] & own[self.v])
        number = np.cumsum(own) - 1
        return number[self.u[at]], number[self.v[at]], self.length[at]

    @staticmethod
    def streets(u: np.ndarray, v: np.ndarray, length: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """The same by the node they leave."""
        out: dict[int, list[tuple[int, float]]] = {}
        for a, b, metres in zip(u.tolist(), v.tolist(), length.tolist()):
            out.setdefault(a, []).append((b, metres))
        return out

    def pick(self, own: np.ndarray, start: int, draws: list[float], stops: int) -> list[int] | None:
        """The first different nodes that the draws choose among the own ones other than the start."""
        others = np.flatnonzero(own)
        others = others[others != start]
        drawn = list(dict.fromkeys(int(x * len(others)) for x in draws))
        return [int(others[k]) for k in drawn[:stops]] if len(others) >= 2 and len(drawn) >= stops else None


def _ways(nodes: int, streets: tuple[np.ndarray, np.ndarray, np.ndarray], sources: list[int]) -> Callable[[int, int], list[int] | None]:
    """A function of (source, target) that has the way between them, or none."""
    all_ = Trees(nodes, *streets, sources)
    if all_.known:
        return all_.way
    out, trees = Network.streets(*streets), {}
    return lambda a, b: trees.setdefault(a, Tree(a, out)).way(b)


_FOUND = "request_id long, route_no long, strategy string, seq long, node_id long, nodes long"


def _search(key: tuple, asked: pa.Table, packed: pa.Table) -> pa.Table:
    """Ways of all tries of one slice of requests; and a row without route for each request, with its number of nodes."""
    rows: list[tuple] = []
    if packed.num_rows:
        array = lambda name: packed.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        network = Network(*(array(c) for c in ("ids", "lats", "lons", "us", "vs", "lengths")))
        by_request: dict[int, list[dict]] = {}
        for row in asked.to_pylist():
            by_request.setdefault(row["request_id"], []).append(row)
        for request, tries_ in by_request.items():
            own = network.own(tries_[0])
            rows.append((request, None, None, None, None, int(own.sum())))
            if own.sum() < graph.LEAST_NODES:
                continue
            number, ids = np.cumsum(own) - 1, network.ids[own]
            loops_ = []
            for row in sorted((r for r in tries_ if r["route_no"] >= 0), key=lambda r: r["route_no"]):
                if row["draws"] is None:
                    stops = np.searchsorted(network.ids, row["loop"])
                else:
                    start = int(np.searchsorted(network.ids, row["start"]))
                    chosen = network.pick(own, start, row["draws"], row["stops"])
                    stops = np.array([start, *chosen, start] if chosen else [], dtype=np.int64)
                loops_.append((row, number[stops].tolist()))
            way_of = _ways(len(ids), network.between(own), list(dict.fromkeys(a for _, stops in loops_ for a in stops[:-1])))
            for row, stops in loops_:
                way = stops[:1]
                for a, b in zip(stops, stops[1:]):
                    leg = way_of(a, b)
                    way = way + leg[1:] if leg and way else []
                if row["strategy"] == "out_and_back":
                    way += way[-2::-1]
                rows += [(request, row["route_no"], row["strategy"], k, n, None) for k, n in enumerate(ids[way].tolist() if way else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _FOUND.split(", ")])


def grouped(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``network``: one name for requests whose centres share a cell, of about the size of their radii."""
    band = F.ceil(F.log2(F.greatest("radius_m", F.lit(1.0))))
    size = F.pow(F.lit(2.0), band) / METRES_PER_DEGREE
    row = F.floor(F.col("lat") / size)
    # cells are about square; those that hold or touch a pole are whole rings
    middle = F.cos(F.radians((row + 0.5) * size))
    column = F.when(F.col("ring"), F.lit(-1).cast("long")).otherwise(F.floor((F.col("w") + F.col("e") + 360) / 2 * F.greatest(middle, F.lit(0.01)) / size))
    return boxes.withColumn("network", F.concat_ws("/", band.cast("string"), row.cast("string"), column.cast("string")))


def networks(boxes: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(network, node_id, lat, lon; network, u, v, length): what lies in the boxes of each group of requests.

    ``boxes`` is from ``grouped``. A group's box holds all of its requests' boxes; of parallel streets the lightest counts.
    """
    ends = {"s": F.min("s"), "n": F.max("n"), "w": F.min("w"), "e": F.max("e"), "ring": F.max("ring")}
    outer = boxes.groupBy(F.col("network").alias("box")).agg(*(c.alias(n) for n, c in ends.items()))
    inside = settle(graph._by_cells(outer, nodes, 0.02).withColumnRenamed("box", "network"))
    ends = inside.select("network", "node_id")
    between = unbroadcast(edges).join(ends.withColumnRenamed("node_id", "u"), "u").join(ends.withColumnRenamed("node_id", "v"), ["network", "v"], "left_semi")
    return inside, settle(between.groupBy("network", "u", "v").agg(F.min("length").alias("length")))


def _by_helper(asked: DataFrame, own_nodes: DataFrame, own_edges: DataFrame, asks: int) -> DataFrame:
    """Rows of ``_search``: tries (with network and slice) of ``asks`` requests meet their network, packed once, in slices."""
    packed = own_nodes.groupBy("network").agg(F.collect_list(F.struct("node_id", "lat", "lon")).alias("n"))
    streets = own_edges.groupBy("network").agg(F.collect_list(F.struct("u", "v", "length")).alias("e"))
    none = F.array().cast("array<struct<u:bigint,v:bigint,length:double>>")
    packed = packed.join(streets, "network", "left").withColumn("e", F.coalesce("e", none))
    fields = {"ids": "n.node_id", "lats": "n.lat", "lons": "n.lon", "us": "e.u", "vs": "e.v", "lengths": "e.length"}
    packed = packed.select("network", *(F.col(c).alias(n) for n, c in fields.items()))
    wanted = asked.select("network", "slice").distinct()
    both = unbroadcast(wanted).join(packed, "network")
    asked, both = asked.toDF(*asked.columns), both.toDF(*both.columns)  # columns of their own, whatever they come from
    # small in bytes and long in time: a number of tasks that Spark does not merge by their bytes
    tasks = max(-(-asks // TASK), asked.sparkSession.sparkContext.defaultParallelism)
    asked, both = (x.repartition(tasks, "network", "slice") for x in (asked, both))
    return asked.groupBy("network", "slice").cogroup(both.groupBy("network", "slice")).applyInArrow(_search, _FOUND)


def _by_joins(tried: DataFrame, aimed: DataFrame, boxes: DataFrame, nodes: DataFrame, edges: DataFrame, seed: int) -> DataFrame:
    """The same rows without a helper: legs are ways of ``shortest_paths`` on each request's own streets."""
    own_nodes, own_edges, rejects = subgraph(boxes.select("request_id", "lat", "lon", "radius_m"), nodes, edges)
    tried = tried.join(own_nodes.select("request_id").distinct(), "request_id", "left_semi")
    stops = aimed.join(tried.select(*KEYS), KEYS, "left_semi").unionByName(random_stops(tried, own_nodes, seed).withColumn("place", F.col("place")))
    loops_ = settle(listed(tried, stops))
    legs = loops_.select(*KEYS, "strategy", F.posexplode(F.slice("stops", F.lit(1), F.size("stops") - 1)).alias("leg", "source"), "stops")
    legs = settle(legs.select(*KEYS, "strategy", "leg", "source", F.get("stops", F.col("leg") + 1).alias("target"), (F.size("stops") - 1).alias("legs")))
    paths = graph.shortest_paths(legs.select("request_id", "source"), own_edges, ["request_id"])
    found = settle(graph.ways(paths, legs.select("request_id", "source", "target"), ["request_id"]))
    sizes = found.groupBy("request_id", "source", "target").agg(F.max("seq").alias("steps"))
    along = Window.partitionBy(*KEYS)
    ordered = along.orderBy("leg").rowsBetween(Window.unboundedPreceding, -1)
    steps = {"known": F.count("*").over(along), "begins": F.coalesce(F.sum("steps").over(ordered), F.lit(0)), "all": F.sum("steps").over(along)}
    whole = legs.join(sizes, ["request_id", "source", "target"]).withColumns(steps).filter("known = legs")
    placed = whole.join(found, ["request_id", "source", "target"]).filter("seq > 0 OR leg = 0").withColumn("seq", F.col("begins") + F.col("seq"))
    out = placed.select(*KEYS, "strategy", "seq", "node_id", "all")
    back = out.filter("strategy = 'out_and_back' AND seq < all").withColumn("seq", 2 * F.col("all") - F.col("seq"))
    counts = own_nodes.groupBy("request_id").agg(F.count("*").alias("nodes"))
    few = rejects.select("request_id", F.when(F.col("reason") == graph.NO_NODES, 0).otherwise(1).cast("long").alias("nodes"))
    return out.unionByName(back).drop("all").unionByName(counts.unionByName(few), allowMissingColumns=True)


def loops(
    requests: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    strategies: tuple[str, ...] = STRATEGIES[:3],
    seed: int = 0,
    most_edges: int = MOST_EDGES,
) -> tuple[DataFrame, DataFrame]:
    """(request_id, route_no, strategy, seq, node_id; request_id, nodes) of ``requests``: all tries, in order of strategy
    and attempt, and how many nodes each request's box has.

    ``requests`` has request_id, lat, lon, radius_m and target_distance_km. A try without a way has no row, nor has a
    request with fewer than ten nodes. Networks of more than ``most_edges`` streets are searched by joins. Requests
    without a place or radius have no row; ids must be unique.
    """
    boxes = settle(grouped(with_boxes(requests.select("request_id", "lat", "lon", "radius_m", "target_distance_km"))))
    own_nodes, own_edges = networks(boxes, nodes, edges)
    asks = tries(boxes.select("request_id", "lat", "lon", "target_distance_km"), strategies)
    starts, aimed = placed(boxes, asks, boxes, nodes, seed)
    tried = settle(asks.join(starts, "request_id"))
    # names of networks beyond the bound alone
    large = own_edges.groupBy("network").agg(F.count("*").alias("edges")).filter(F.col("edges") > most_edges).select("network")
    sizes = boxes.groupBy("network").agg(F.count("*").alias("asks"))
    sliced = boxes.join(sizes, "network").withColumn("slice", F.pmod(F.xxhash64("request_id"), F.ceil(F.col("asks") / SLICE)).cast("int"))
    small = sliced.join(unbroadcast(large), "network", "left_anti").select("network", "slice", "request_id", *BOX)
    loop = unbroadcast(listed(tried, aimed).select(*KEYS, F.col("stops").alias("loop")))
    # a row for each try, which would else be sent through the driver while its compressed bytes are few
    whole = unbroadcast(tried.select(*KEYS, "strategy", "start").join(random_draws(tried, seed), KEYS, "left").join(loop, KEYS, "left"))
    # a request whose every try fell out still has its number of nodes
    asked = small.join(whole.filter("loop IS NOT NULL OR draws IS NOT NULL"), "request_id", "left").withColumn("route_no", F.coalesce("route_no", F.lit(-1)))
    found = _by_helper(asked, own_nodes, own_edges, boxes.count())
    if not large.isEmpty():
        rest = settle(boxes.join(large, "network", "left_semi"))
        ids = rest.select("request_id")
        found = found.unionByName(_by_joins(tried.join(ids, "request_id", "left_semi"), aimed.join(ids, "request_id", "left_semi"), rest, nodes, edges, seed).select(found.columns))
    found = settle(found)
    return found.filter("route_no >= 0").drop("nodes"), found.filter("route_no IS NULL").select("request_id", "nodes")


def candidate_routes(
    requests: DataFrame, nodes: DataFrame, edges: DataFrame, tolerance: float = 0.3, seed: int = 0, most_edges: int = MOST_EDGES
) -> tuple[DataFrame, DataFrame]:
    """(points, rejects): candidates of each request (request_id, lat, lon, target_distance_km).

    points: request_id, candidate_no, strategy, seq, node_id, lat, lon. Tries of a wrong length go, the first
    fifteen others stay, then those too like an earlier one go. rejects: request_id, reason.
    """
    bounds = search_bounds(F.col("target_distance_km"), tolerance)
    asked = requests.select("request_id", "lat", "lon", "target_distance_km", *(c.alias(n) for n, c in bounds.items()))
    found, counted = loops(asked, nodes, edges, seed=seed, most_edges=most_edges)
    _, points = validate_routes(found, edges, nodes, KEYS, asked.select("request_id", "min_km", "max_km"))
    points = settle(points)
    order = Window.partitionBy("request_id").orderBy("route_no")
    first = points.select(*KEYS).distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= MOST_ROUTES).select(*KEYS)
    kept = dedupe_routes(points.join(first, KEYS, "left_semi"))
    numbered = settle(kept.withColumn("candidate_no", (F.row_number().over(order) - 1).cast("long")))
    named = found.filter("seq = 0").select(*KEYS, "strategy")
    out = points.join(numbered, KEYS).join(named, KEYS).select("request_id", "candidate_no", "strategy", "seq", "node_id", "lat", "lon")
    without = asked.select("request_id").join(numbered.select("request_id").distinct(), "request_id", "left_anti").join(counted, "request_id", "left")
    reason = F.coalesce(too_few("nodes"), F.when(F.col("nodes").isNull(), graph.NO_NODES), F.lit(NO_ROUTES))
    return out, without.select("request_id", reason.alias("reason"))
