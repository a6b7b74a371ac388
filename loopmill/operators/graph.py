"""Street networks as node and edge tables: nearest nodes, subgraphs, shortest paths, route checks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from loopmill.functions.geo import EARTH_RADIUS_KM, METRES_PER_DEGREE, destination, haversine_km
from loopmill.functions.scratch import settle, unbroadcast
from loopmill.operators.blocks import least_ways

LEAST_NODES = 10
#: Passes over rings of cells before points far from every node of their box meet them all.
BOX_RINGS, FINER = 2, 4
#: Cubes of nodes are cut until they hold up to LEAF of them or are SMALLEST (of the radius: some 60 cm) wide; up to
#: FEW_CUBES are sent to the points (some 25 MB).
LEAF, SMALLEST, FEW_CUBES = 64, 1e-7, 50_000
#: A box is covered by cells COARSER times as large until it is at most SIDE of them wide and high.
SIDE, COARSER = 4, 4
#: Up to so many boxes are sent to the nodes (some 40 cells each); of more, both sides are sorted.
FEW_BOXES = 1_000
#: Similar routes of a request that are decided in one pass; more are in rounds.
FOLD = 64
#: Steps along streets that one round of ``shortest_paths`` takes.
HOPS = 12


def _on_sphere(lat: str, lon: str) -> dict[str, Column]:
    """x, y, z on the unit sphere: no seam at 180 degrees and no narrow cells at the poles."""
    flat = F.cos(F.radians(lat))
    return {"x": flat * F.cos(F.radians(lon)), "y": flat * F.sin(F.radians(lon)), "z": F.sin(F.radians(lat))}


def _cell(size: float, *shift: int) -> list[Column]:
    return [(F.floor(F.col(c) / size) + i).alias(f"c{c}") for c, i in zip("xyz", shift or (0, 0, 0))]


def _cubes(nodes: DataFrame, size: float) -> DataFrame:
    """Cubes of ``size`` that hold nodes: cx, cy, cz, bounds of their x, y, z, latitude and longitude, four of their
    nodes (outermost by latitude and longitude) as ``some``, and ``held``, their number."""
    ends = [f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("x", "y", "z", "phi", "lam")]
    some = F.array(*(f(F.struct("x", "y", "z"), c) for c in ("phi", "lam") for f in (F.min_by, F.max_by)))
    return nodes.groupBy(*_cell(size)).agg(*ends, some.alias("some"), F.count("*").alias("held"))


def _least_chord() -> Column:
    """A bound below the chords from a point to all nodes of a cube, by the bounds of their places in space and of
    their latitudes and longitudes; rounding only makes it smaller."""
    gaps = [F.greatest(F.col(f"lo{c}") - F.col(c), F.col(c) - F.col(f"hi{c}"), F.lit(0.0)) for c in "xyz"]
    between = F.col("lam").between(F.col("lolam"), F.col("hilam"))
    turn = F.when(between, 1.0).otherwise(F.greatest(*(F.cos(F.col("lam") - F.col(f"{e}lam")) for e in ("lo", "hi"))))
    # the product of two unit vectors is up * sin(phi) + along * cos(phi), largest at ``best``
    up, along = F.col("z"), F.sqrt(F.greatest(1 - F.col("z") * F.col("z"), F.lit(0.0))) * turn
    best, at = F.atan2(up, along), lambda e: up * F.sin(F.col(f"{e}phi")) + along * F.cos(F.col(f"{e}phi"))
    product = F.when(best.between(F.col("lophi"), F.col("hiphi")), F.sqrt(up * up + along * along)).otherwise(F.greatest(at("lo"), at("hi")))
    return F.greatest(F.sqrt(sum((g * g for g in gaps), F.lit(0.0))), F.sqrt(F.greatest(2 - 2 * product - 1e-14, F.lit(0.0))))


def _nearest_by_descent(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """lat, lon, node_id, distance_km: cubes of nodes, from large to small, that may hold a point's nearest node.

    A cube stays while no node of it is surely farther than one of the four nodes by which each cube is known, so that
    a point meets a few cubes of each size. Cubes are cut until they hold up to LEAF nodes. While they are few they
    are sent to the points, which then stay where they are.
    """
    size, front, own = 2.0, points, ["lat", "lon", "x", "y", "z", "lam"]
    while True:
        cubes = settle(_cubes(nodes, size))
        all_ = cubes.agg(F.count("*").alias("cubes"), F.max("held").alias("most")).first()
        few = all_.cubes <= FEW_CUBES
        if front is points:
            step = points.crossJoin(F.broadcast(cubes))  # eight cubes at most
        else:
            below = cubes.select("*", *(F.floor(F.col(f"c{c}") / FINER).alias(f"p{c}") for c in "xyz"))
            step = (front if few else settle(front)).join(F.broadcast(below) if few else unbroadcast(below), ["px", "py", "pz"])
        chord = lambda n: F.sqrt(sum(((n[c] - F.col(c)) * (n[c] - F.col(c)) for c in "xyz"), F.lit(0.0)))
        reached = F.array_min(F.transform("some", chord))
        step = step.select(*own, "cx", "cy", "cz", _least_chord().alias("near"), reached.alias("reached"))
        bound = F.min("reached").over(Window.partitionBy("lat", "lon"))
        kept = step.withColumn("bound", bound).filter(F.col("near") <= F.col("bound") + 1e-9).select(*own, "cx", "cy", "cz")
        if (all_.most or 0) <= LEAF or size < SMALLEST:
            held = unbroadcast(nodes.select("node_id", "n_lat", "n_lon", *_cell(size)))
            return _best(settle(kept).join(held, ["cx", "cy", "cz"]))
        front, size = kept.withColumnsRenamed({f"c{c}": f"p{c}" for c in "xyz"}), size / FINER


def _best(pairs: DataFrame, by: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    distance = haversine_km(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))
    best = pairs.groupBy(*by).agg(F.min(F.struct(distance.alias("distance_km"), F.col("node_id"))).alias("best"))
    return best.select(*by, "best.node_id", "best.distance_km")


def _around(size: float) -> Column:
    """The cube of a position and the 26 around it."""
    return F.array(*(F.struct(*_cell(size, i, j, k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)))


def _placed(df: DataFrame) -> DataFrame:
    return df.filter("NOT (lat IS NULL OR lon IS NULL OR isnan(lat) OR isnan(lon))")


def nearest_node(points: DataFrame, nodes: DataFrame, keys: list[str], cell: float = 0.01) -> DataFrame:
    """keys, node_id, distance_km: the nearest node of each point on the sphere; none if there are no nodes.

    Positions go down by cubes of nodes, which are as small as the nodes are dense (``cell``, a width in degrees, is no
    longer needed), so neither crowds of nodes nor points far from all of them meet more than a few. Ties: smaller node
    id. Points or nodes without a coordinate are left out; repeated points have a row each, equal positions are
    searched once. Longitudes may wrap.
    """
    asked = unbroadcast(_placed(points.select(*keys, "lat", "lon")))
    angles = {"phi": F.asin(F.greatest(F.least("z", F.lit(1.0)), F.lit(-1.0))), "lam": F.atan2("y", "x")}
    placed = lambda df: df.withColumns(_on_sphere("lat", "lon")).withColumns(angles).filter("NOT isnan(x + y + z)")
    known = placed(_placed(nodes.select("node_id", "lat", "lon")).groupBy("lat", "lon").agg(F.min("node_id").alias("node_id")))
    known = settle(known.withColumnsRenamed({"lat": "n_lat", "lon": "n_lon"}))
    found = _nearest_by_descent(placed(asked.select("lat", "lon").distinct()).drop("phi"), known)
    return asked.join(found, ["lat", "lon"]).select(*keys, "node_id", "distance_km")


def nearest_in_box(points: DataFrame, boxes: DataFrame, nodes: DataFrame, keys: list[str], cell: float = 0.01) -> DataFrame:
    """keys, node_id, distance_km: the nearest node of each point (keys with request_id, lat, lon) among those of its
    request's box (``boxes`` from ``with_boxes``); none if the box has no node.

    Points meet the nodes of the cubes around them, as in ``nearest_node``, and count those inside the box alone, so
    what is read follows the nodes near the points. Points without a sure one after some wider cubes meet all
    nodes of their own box. Ties: smaller node id.
    """
    by = (*keys, "lat", "lon")
    left = _placed(points.select(*by)).join(unbroadcast(boxes.select("request_id", *BOX)), "request_id").withColumns(_on_sphere("lat", "lon"))
    known = unbroadcast(_placed(nodes.select("node_id", "lat", "lon")).withColumns(_on_sphere("lat", "lon")).withColumnsRenamed({"lat": "n_lat", "lon": "n_lon"}))
    found, size = [], math.radians(cell)
    for _ in range(BOX_RINGS):
        rings = left.withColumn("cell", F.explode(_around(size))).select(*by, *BOX, "cell.*")
        near = _best(rings.join(known.select("node_id", "n_lat", "n_lon", *_cell(size)), ["cx", "cy", "cz"]).filter(_inside("n_lat", "n_lon")), by)
        sure = F.coalesce(F.col("distance_km") <= size * EARTH_RADIUS_KM, F.lit(False))
        judged = settle(left.join(unbroadcast(near.select(*keys, "node_id", "distance_km")), keys, "left").withColumn("sure", sure))
        found.append(judged.filter("sure").select(*keys, "node_id", "distance_km"))
        left = judged.filter("NOT sure").drop("node_id", "distance_km", "sure")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        size *= FINER
    rest = boxes.join(left.select("request_id").distinct(), "request_id", "left_semi")
    own = nodes_in_boxes(rest, nodes).withColumnsRenamed({"lat": "n_lat", "lon": "n_lon"})
    far = _best(left.select(*by).join(own, "request_id"), by).select(*keys, "node_id", "distance_km")
    return reduce(DataFrame.unionByName, [*found, far])


def node_at_bearing(points: DataFrame, nodes: DataFrame, keys: list[str], bearing: Column, distance_m: Column, start: str, cell: float = 0.01) -> DataFrame:
    """keys, node_id nearest to the place at a bearing and distance; none if that is the node in ``start``."""
    lat, lon = destination(F.col("lat"), F.col("lon"), bearing, distance_m)
    found = nearest_node(points.select(*keys, lat.alias("lat"), lon.alias("lon")), nodes, keys, cell)
    return found.join(unbroadcast(points.select(*keys, start)), keys).filter(F.col("node_id") != F.col(start)).select(*keys, "node_id")


#: Columns of a box: south and north, west and east (east may pass 180 degrees), and whether it goes round the pole.
BOX = ("s", "n", "w", "e", "ring")
NO_NODES, FEW_NODES = "No road network data available", "Not enough road network data in this area"


def with_boxes(requests: DataFrame) -> DataFrame:
    """``requests`` (request_id, lat, lon, radius_m) with the square box around each, as columns BOX.

    A box that passes a pole, or is 360 degrees wide, holds all longitudes of its latitudes. Requests without a
    place or radius have no row.
    """
    half_lat = F.col("radius_m") / METRES_PER_DEGREE
    half_lon = F.col("radius_m") / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians("lat")))
    known = _placed(requests).filter("radius_m >= 0 AND NOT isnan(radius_m)")
    known = known.withColumn("lon", F.when((F.col("lon") >= -180) & (F.col("lon") < 180), F.col("lon")).otherwise(_turned(F.col("lon"))))
    south, north = F.col("lat") - half_lat, F.col("lat") + half_lat
    ring = (half_lon >= 180) | (half_lon < 0) | (south <= -90) | (north >= 90)
    return known.withColumns({"s": F.greatest(south, F.lit(-90.0)), "n": F.least(north, F.lit(90.0)), "w": F.col("lon") - half_lon, "e": F.col("lon") + half_lon, "ring": ring})


def _inside(lat: str, lon: str) -> Column:
    """Whether a position is in the box of its row; longitudes count modulo 360."""
    turned = [F.col(lon).between(F.col("w") + turn, F.col("e") + turn) for turn in (0, 360, -360)]
    return F.col(lat).between(F.col("s"), F.col("n")) & (F.col("ring") | turned[0] | turned[1] | turned[2])


def _turned(lon: Column) -> Column:
    """A longitude from -180 on, below 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def _by_cells(boxes: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """Boxes (columns ``box``, BOX) joined with the nodes in them: box, node_id, lat, lon.

    A box takes cells of such a size (``cell`` degrees times a power of COARSER) that it covers a few, however large
    it is; nodes stand on the cells of each size in use. Cells of a size are counted round the parallel.
    """
    high, wide = F.col("n") - F.col("s"), F.when(F.col("ring"), 0.0).otherwise(F.col("e") - F.col("w"))
    deep = F.ceil(F.log(F.greatest(high / (SIDE * cell), wide / (SIDE * cell), F.lit(1.0))) / math.log(COARSER))
    sized = boxes.select("box", *BOX, deep.cast("int").alias("level")).withColumn("size", cell * F.pow(F.lit(float(COARSER)), "level"))
    low = lambda c: F.floor(c / F.col("size"))
    # a box beyond a pole ends before it begins, and has no cell
    rows = F.when(F.col("s") <= F.col("n"), F.sequence(low(F.col("s")), low(F.col("n")))).otherwise(F.array().cast("array<bigint>"))
    # a ring of latitude is one cell wide; elsewhere columns start at the west end and are counted modulo the parallel
    around = F.ceil(F.lit(360.0) / F.col("size"))
    start = F.floor((_turned(F.col("w")) + 180) / F.col("size"))
    wide = F.ceil((F.col("e") - F.col("w")) / F.col("size"))
    columns = F.when(F.col("ring"), F.array(F.lit(-1).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(start, start + wide + 1), lambda x: F.pmod(x, around))))
    cells = sized.withColumn("cy", F.explode(rows)).withColumn("cx", F.explode(columns))
    # a few numbers, whatever the boxes: levels are logarithms of sizes
    counts = {(r.level, r.ring): r["count"] for r in sized.filter("s <= n").groupBy("level", "ring").count().collect()}
    levels = sorted(counts)
    none = F.array().cast("array<struct<level:int,cy:bigint,cx:bigint>>")
    places = []
    for level, ring in levels:
        size = cell * float(COARSER) ** level
        column = F.lit(-1).cast("long") if ring else F.pmod(F.floor((_turned(F.col("lon")) + 180) / size), F.ceil(F.lit(360.0) / size))
        places.append(F.struct(F.lit(level).alias("level"), F.floor(F.col("lat") / size).alias("cy"), column.alias("cx")))
    at = F.array(*places) if places else none
    placed = _placed(nodes.select("node_id", "lat", "lon")).withColumn("at", F.explode(at)).select("node_id", "lat", "lon", "at.*")
    # nodes come first: of a sorted join the second side's rows of a key are held, and a large box's cell has most nodes
    cells = F.broadcast(cells) if sum(counts.values()) <= FEW_BOXES else unbroadcast(cells)
    return placed.join(cells, ["level", "cy", "cx"]).filter(_inside("lat", "lon")).select("box", "node_id", "lat", "lon")


def nodes_in_boxes(boxes: DataFrame, nodes: DataFrame, cell: float = 0.02) -> DataFrame:
    """request_id, node_id, lat, lon of all nodes in each request's box (``boxes`` from ``with_boxes``)."""
    found = _by_cells(boxes.select(F.col("request_id").alias("box"), *BOX), nodes, cell)
    return found.withColumnRenamed("box", "request_id")


def too_few(nodes: str) -> Column:
    """Why a network of so many nodes is none; null if it is large enough."""
    return F.when(F.col(nodes) == 0, NO_NODES).when(F.col(nodes) < LEAST_NODES, FEW_NODES)


def subgraph(requests: DataFrame, nodes: DataFrame, edges: DataFrame, cell: float = 0.02) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejects) of each request (request_id, lat, lon, radius_m): what lies in its square box.

    Boxes meet nodes by cells in keeping with their size, then by exact bounds, so a box may be of any size, lie across
    180 degrees or hold a pole. Requests with fewer than ten nodes are rejected with a reason, those without a place
    too.
    """
    inside = settle(nodes_in_boxes(with_boxes(requests), nodes, cell))
    counted = inside.groupBy("request_id").agg(F.count("*").alias("nodes"))
    counts = unbroadcast(requests.select("request_id")).join(counted, "request_id", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
    judged = settle(counts.select("request_id", too_few("nodes").alias("reason")))
    kept = inside.join(judged.filter("reason IS NULL").select("request_id"), "request_id", "left_semi")
    ends = unbroadcast(kept.select("request_id", "node_id"))
    within = unbroadcast(edges).join(ends.withColumnRenamed("node_id", "u"), "u").join(ends.withColumnRenamed("node_id", "v"), ["request_id", "v"], "left_semi")
    return kept, within.select("request_id", "u", "v", "key", "length"), judged.filter("reason IS NOT NULL")


def _spread(state: DataFrame, out: DataFrame, by: list[str], shared: list[str], bound: float, max_m: float | None) -> DataFrame:
    """One step: nodes that are new and nearer than ``bound`` offer ways to their neighbours, each node keeps its best.

    Of equal lengths what stands stays; settled nodes take no offer, as theirs is shorter.
    """
    keys = [k for k in by if k not in ("source", "node_id")]
    met = state.join(out.withColumnRenamed("u", "node_id"), [*shared, "node_id"], "left")
    goes = (F.col("new") == 1) & (F.col("dist") < bound)
    fresh = [F.lit(1).alias("new"), F.col("node_id").alias("before"), F.lit(False).alias("done")]
    offer = F.transform("to", lambda t: F.struct(t["v"].alias("node_id"), (F.col("dist") + t["length"]).alias("dist"), *fresh))
    if max_m is not None:
        offer = F.filter(offer, lambda t: t["dist"] <= max_m)
    # after its offers a node is new no more
    own = F.array(F.struct("node_id", "dist", F.when(goes, 0).otherwise(F.col("new")).alias("new"), "before", "done"))
    rows = F.when(goes & F.col("to").isNotNull(), F.concat(own, offer)).otherwise(own)
    spread = met.select(*keys, "source", F.explode(rows).alias("x")).select(*keys, "source", "x.*")
    best = spread.groupBy(*by).agg(F.min(F.struct("dist", "new", "before", "done")).alias("x"))
    return best.select(*by, "x.*")


def shortest_paths(
    sources: DataFrame, edges: DataFrame, keys: list[str], max_m: float | None = None, hops: int = HOPS, most_rounds: int = 10_000, nodes: DataFrame | None = None
) -> DataFrame:
    """keys, source, node_id, dist, before: least total length from each source (keys, source) over directed edges.

    The lightest of parallel edges is used; lengths must not be negative. Lengths from the sources are cut into
    buckets of about ``hops`` streets. A round takes the nodes of the nearest bucket with open ones through ``hops``
    steps in one job; what is settled is written and met again only to drop offers to it, so that rounds are some for
    each bucket, not one for each street, and carry the rim of what is reached. ``before`` is the node before on a
    least way: of several the one nearest to the source, then the smallest id. ``edges`` may have the keys or be shared.
    Rows without a node or length lead nowhere; sources that are null or have a null key have no row.
    With ``nodes`` (node_id, lat, lon) a few sources on a large network are searched by ``blocks``, with the same rows.
    """
    shared, by = [k for k in keys if k in edges.columns], [*keys, "source", "node_id"]
    light = settle(edges.filter("length IS NOT NULL AND NOT isnan(length)").groupBy(*shared, "u", "v").agg(F.min("length").alias("length")))
    sized = light.agg(F.avg("length").alias("mean"), F.max("length").alias("most"), F.min("length").alias("least")).first()
    if sized.least is not None and sized.least < 0:
        raise ValueError("lengths must not be negative")
    start = sources.select(*keys, "source").dropna().distinct()
    if nodes is not None:
        return _with_least_before(settle(least_ways(start, light, nodes, keys, shared, max_m, most_rounds)), light, by, shared)
    width, reach = max((sized.mean or 0.0) * hops * 0.75, 1e-9), sized.most or 0.0
    out = settle(light.filter("u <> v").groupBy(*shared, "u").agg(F.collect_list(F.struct("v", "length")).alias("to")))
    none = F.lit(None).cast(edges.schema["u"].dataType)
    first = {"node_id": F.col("source"), "dist": F.lit(0.0), "new": F.lit(1), "before": none, "done": F.lit(False)}
    state = settle(start.select(*keys, "source", *(c.alias(n) for n, c in first.items())))
    settled, bound = [], width
    for _ in range(most_rounds):
        front = state.filter("NOT done").agg(F.min("dist").alias("low"), F.min(F.when((F.col("new") == 1) & (F.col("dist") < bound), F.col("dist"))).alias("open")).first()
        if front.low is None and front.open is None:
            break
        if front.open is None:  # the bucket is settled
            closed = state.filter(~F.col("done") & (F.col("dist") < bound))
            settled.append(closed.select(*by, "dist", "before"))
            # its rim stays for a while to take offers back
            rim = closed.filter(F.col("dist") >= bound - width - reach).withColumn("done", F.lit(True))
            ahead = state.filter(~F.col("done") & (F.col("dist") >= bound))
            low = ahead.agg(F.min("dist").alias("low")).first().low
            if low is None:
                break
            state, bound = ahead.unionByName(rim), low + width
        step = state
        for _ in range(hops):
            step = _spread(step, out, by, shared, bound, max_m)
        # offers to nodes settled long ago, over streets that lead back
        if len(settled) > 1:
            step = step.join(reduce(DataFrame.unionByName, settled[:-1]).select(*by), by, "left_anti")
        state = settle(step)
    else:
        raise RuntimeError("shortest paths did not settle")
    if not settled:  # no source
        return state.select(*by, "dist", "before")
    return _with_least_before(settle(reduce(DataFrame.unionByName, settled)), light, by, shared)


def _with_least_before(found: DataFrame, light: DataFrame, by: list[str], shared: list[str]) -> DataFrame:
    """``before`` chosen among all least ways, alike however the search went; over streets of no length it stays."""
    group = [*by[:-1], "v"]
    here = found.select(*by[:-1], F.col("node_id").alias("u"), F.col("dist").alias("dist_u"))
    tight = here.join(light, [*shared, "u"]).join(found.select(*by[:-1], F.col("node_id").alias("v"), "dist"), group)
    tight = tight.filter((F.col("dist_u") + F.col("length") == F.col("dist")) & (F.col("dist_u") < F.col("dist")))
    least = tight.groupBy(*group).agg(F.min(F.struct("dist_u", "u")).alias("x")).select(*by[:-1], F.col("v").alias("node_id"), F.col("x.u").alias("least"))
    return found.join(least, by, "left").select(*by, "dist", F.coalesce("least", "before").alias("before"))


def ways(paths: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, target, seq, node_id: the nodes of the least way to each target (keys, source, target), in order.

    ``paths`` is from ``shortest_paths``. Pointers over ``before`` are doubled until none is left; then each way is
    filled from its end by halves, so there are as many joins as the longest way's number has bits, whatever the ways.
    A target that is not reached has no row; the source itself is a way of one node.
    """
    by = [*keys, "source"]
    jump = settle(paths.filter("before IS NOT NULL").select(*by, "node_id", F.col("before").alias("to")))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        jump = settle(jump.join(jump.select(*by, F.col("node_id").alias("to"), F.col("to").alias("far")), [*by, "to"]).select(*by, "node_id", F.col("far").alias("to")))
    asked = targets.select(*by, "target").distinct().withColumn("node_id", F.col("target"))
    rows = asked.join(paths.select(*by, "node_id"), [*by, "node_id"], "left_semi").select(*by, "target", F.lit(0).cast("long").alias("back"), "node_id")
    for k in reversed(range(len(jumps))):
        further = rows.join(jumps[k], [*by, "node_id"]).select(*by, "target", (F.col("back") + (1 << k)).alias("back"), F.col("to").alias("node_id"))
        rows = settle(rows.unionByName(further))
    longest = Window.partitionBy(*by, "target")
    return rows.select(*by, "target", (F.max("back").over(longest) - F.col("back")).alias("seq"), "node_id")


def way_sums(paths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, target, nodes, way_sum: of the least way to each node of ``paths`` (from ``shortest_paths``) how many
    nodes it has and the sum of seq * node_id along it, as ``ways`` would number it, without writing out the ways.

    Pointers over ``before`` are doubled; each carries of the nodes that it passes their number, the sum of their ids
    and that of ids times steps back. So there are some rows for each node, however long its way.
    """
    by = [*keys, "source"]
    steps = paths.filter("before IS NOT NULL").select(*by, "node_id", F.col("before").alias("to"), F.lit(1).cast("long").alias("n"), F.col("node_id").alias("ids"), F.lit(0).cast("long").alias("back"))
    state = settle(steps.withColumn("goes", F.lit(True)))
    while not state.filter("goes").isEmpty():
        on = state.select(*by, F.col("node_id").alias("to"), *(F.col(c).alias(f"{c}_on") for c in ("to", "n", "ids", "back")))
        met = state.join(on, [*by, "to"], "left")
        plus = lambda c: F.col(c) + F.coalesce(f"{c}_on", F.lit(0))
        back = plus("back") + F.col("n") * F.coalesce("ids_on", F.lit(0))
        state = settle(met.select(*by, "node_id", F.coalesce("to_on", "to").alias("to"), plus("n").alias("n"), plus("ids").alias("ids"), back.alias("back"), F.col("to_on").isNotNull().alias("goes")))
    # the source is number 0 and adds nothing
    sums = state.select(*by, F.col("node_id").alias("target"), (F.col("n") + 1).alias("nodes"), (F.col("n") * F.col("ids") - F.col("back")).alias("way_sum"))
    own = paths.filter("before IS NULL").select(*by, F.col("node_id").alias("target"), F.lit(1).cast("long").alias("nodes"), F.lit(0).cast("long").alias("way_sum"))
    return sums.unionByName(own)


def validate_routes(routes: DataFrame, edges: DataFrame, nodes: DataFrame, keys: list[str], bounds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lengths, points): street_km of each route (keys, seq, node_id), and the coordinates of those in bounds.

    A step counts the first of parallel edges, and 0 where there is none. ``bounds`` has some of the keys,
    min_km and max_km, both included; without it every route stays.
    """
    first = unbroadcast(edges.groupBy(*(k for k in keys if k in edges.columns), "u", "v").agg(F.min_by("length", "key").alias("length")))
    along = Window.partitionBy(*keys).orderBy("seq")
    steps = routes.select(*keys, "seq", F.lag("node_id").over(along).alias("u"), F.col("node_id").alias("v"))
    measured = steps.join(first, [c for c in first.columns if c != "length"], "left")
    lengths = measured.groupBy(*keys).agg((F.sum(F.coalesce("length", F.lit(0.0))) / 1000).alias("street_km"))
    if bounds is not None:
        lengths = lengths.join(unbroadcast(bounds), [k for k in keys if k in bounds.columns]).filter(F.col("street_km").between(F.col("min_km"), F.col("max_km"))).select(*keys, "street_km")
    kept = routes.join(lengths.select(*keys), keys, "left_semi")
    return lengths, kept.join(unbroadcast(nodes.select("node_id", "lat", "lon").distinct()), "node_id").select(*keys, "seq", "node_id", "lat", "lon")


def similar_routes(members: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(routes, pairs): request_id, route_no of routes with different coordinates, the first of equal ones, and
    request_id, a, b (a < b) of those whose sets of coordinates have a Jaccard similarity above ``threshold``.

    A similar pair shares one of the first coordinates of each, ordered by how many routes of the request have
    them (prefix filter), so what all routes pass, such as the start, is no key. Pairs are then counted on whole sets.
    """
    cells = members.select("request_id", "route_no", F.xxhash64("lat", "lon").alias("place")).distinct()
    common = unbroadcast(cells.groupBy("request_id", "place").agg(F.count("*").alias("routes")))
    ranked = cells.join(common, ["request_id", "place"])
    sets = ranked.groupBy("request_id", "route_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("routes", "place"))), lambda x: x["place"]).alias("places"))
    routes = settle(sets.groupBy("request_id", "places").agg(F.min("route_no").alias("route_no")))
    n = F.size("places")
    shown = n - F.ceil(n * threshold).cast("int") + 1
    keyed = routes.select("request_id", "route_no", n.alias("n"), F.explode(F.slice("places", F.lit(1), F.least(shown, n))).alias("place"))
    one, two = keyed.withColumnsRenamed({"route_no": "a", "n": "na"}), keyed.withColumnsRenamed({"route_no": "b", "n": "nb"})
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") > threshold * F.greatest("na", "nb"))
    pairs = one.join(two, ["request_id", "place"]).filter(near).select("request_id", "a", "b").distinct()
    own = lambda side: routes.select("request_id", F.col("route_no").alias(side), F.col("places").alias(f"places_{side}"))
    both = pairs.join(own("a"), ["request_id", "a"]).join(own("b"), ["request_id", "b"])
    shared = F.size(F.array_intersect("places_a", "places_b"))
    alike = shared / (F.size("places_a") + F.size("places_b") - shared) > threshold
    return routes.select("request_id", "route_no"), both.filter(alike).select("request_id", "a", "b")


def dedupe_routes(members: DataFrame, threshold: float = 0.8, most_rounds: int = 10_000) -> DataFrame:
    """request_id, route_no of the routes that stay: in order, each unlike all earlier ones that stayed.

    ``members`` has request_id, route_no, lat, lon. Routes are alike as by ``similar_routes``; equal ones share their
    fate with the first. A request of up to FOLD different routes that are like others is folded in order in one pass. For
    larger ones the choice goes in rounds over all requests at once: what is like a route that no other holds back
    goes, the rest waits; so a request may have any number of routes, and rounds are as many as the longest chain of
    routes that each wait for the one before. A null request is one group.
    """
    named = members.select(F.struct("request_id").alias("request_id"), "route_no", "lat", "lon")  # a struct of null is no null
    routes, pairs = similar_routes(named, threshold)
    pairs = settle(pairs)
    sizes = pairs.select("request_id", F.explode(F.array("a", "b")).alias("route_no")).groupBy("request_id").agg(F.count_distinct("route_no").alias("n"))
    many = settle(sizes.filter(F.col("n") > FOLD).select("request_id"))
    gone = [_folded(pairs.join(many, "request_id", "left_anti"))]
    if not many.isEmpty():
        gone += _dropped_in_rounds(settle(pairs.join(many, "request_id", "left_semi")), most_rounds)
    kept = routes.join(reduce(DataFrame.unionByName, gone), ["request_id", "route_no"], "left_anti")
    return kept.select("request_id.request_id", "route_no")


def _folded(pairs: DataFrame) -> DataFrame:
    """request_id, route_no of routes that go, by one pass in order over each request's similar routes."""
    kind = pairs.schema["b"].dataType
    earlier = pairs.groupBy("request_id", F.col("b").alias("route_no")).agg(F.collect_list("a").alias("earlier"))
    listed = earlier.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("route_no", "earlier"))).alias("routes"))
    none = F.array().cast(ArrayType(kind))
    # a route goes if one of its earlier ones is not among those that went
    goes = F.aggregate("routes", none, lambda out, r: F.when(F.size(F.array_except(r["earlier"], out)) > 0, F.array_append(out, r["route_no"])).otherwise(out))
    return listed.select("request_id", F.explode(goes).alias("route_no"))


def _dropped_in_rounds(pairs: DataFrame, most_rounds: int) -> list[DataFrame]:
    gone = []
    for _ in range(most_rounds):
        if pairs.isEmpty():
            return gone
        late = pairs.select("request_id", F.col("b").alias("a")).distinct()
        gone.append(settle(pairs.join(late, ["request_id", "a"], "left_anti").select("request_id", F.col("b").alias("route_no")).distinct()))
        for side in "ab":
            pairs = pairs.join(gone[-1].withColumnRenamed("route_no", side), ["request_id", side], "left_anti")
        pairs = settle(pairs)
    raise RuntimeError("routes were not decided")
