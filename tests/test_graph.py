"""Graph, ranking, place and GPX operators on hand-made inputs."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from loopmill.functions import geo
from loopmill.operators import blocks, candidates, graph, places, ranking
from loopmill.sources import gpx
from loopmill.sources.fixtures import fixture
from loopmill.streaming import gpx_stream

KEY = ["request_id"]


def test_unreachable_and_parallel_edges(spark):
    edges = spark.createDataFrame([(1, 2, 0, 9.0), (1, 2, 1, 4.0), (2, 3, 0, 1.0), (1, 3, 0, 7.0), (4, 1, 0, 1.0)], "u long, v long, key long, length double")
    sources = spark.createDataFrame([(7, 1)], "request_id long, source long")
    got = {r.node_id: (r.dist, r.before) for r in graph.shortest_paths(sources, edges, KEY).collect()}
    assert got == {1: (0.0, None), 2: (4.0, 1), 3: (5.0, 2)}
    assert {r.node_id for r in graph.shortest_paths(sources, edges, KEY, max_m=4.0).collect()} == {1, 2}


def dijkstra(edges, source):
    """(dist, before): of several least ways the one over the node nearest to the source, then of smallest id."""
    out = {}
    for u, v, _, length in edges:
        out.setdefault(u, {})
        out[u][v] = min(length, out[u].get(v, math.inf))
    dist, before, heap, done = {source: 0.0}, {source: None}, [(0.0, source)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u not in done:
            done.add(u)
            for v, length in out.get(u, {}).items():
                if d + length < dist.get(v, math.inf):
                    dist[v], before[v] = d + length, u
                    heapq.heappush(heap, (d + length, v))
    return dist, before


def lattice(n, seed=1, step=1):
    draw = random.Random(seed)
    edges = []
    for i in range(n):
        for j in range(n):
            for di, dj in ((0, 1), (1, 0)):
                if i + di < n and j + dj < n:
                    u, v, length = i * n + j, (i + di) * n + j + dj, float(80 + step * draw.randrange(50 // step))
                    edges += [(u, v, 0, length), (v, u, 0, length)][: 1 if draw.random() < 0.06 else 2]
    return edges


@pytest.mark.parametrize("hops,seed,step", [(12, 1, 1), (5, 2, 25)])
def test_rounds_take_many_streets_and_ways_are_dijkstras(spark, hops, seed, step):
    """A lattice of 18 x 18 nodes, with few different lengths (many equal ways) and a street back across all of it."""
    n = 18
    edges = [*lattice(n, seed, step), (n * n - 1, 1, 0, 10.0), (n * n - 1, n * n + 5, 0, 0.0), (n * n + 5, n * n - 1, 0, 0.0)]
    table = spark.createDataFrame(edges, "u long, v long, key long, length double")
    sources = spark.createDataFrame([(1, 0), (2, n + 3), (2, 10**6), (None, 0)], "request_id long, source long")
    paths = graph.shortest_paths(sources, table, KEY, hops=hops, most_rounds=2 * 36 // hops + 4).cache()
    got = {(r.request_id, r.source, r.node_id): (r.dist, r.before) for r in paths.collect() if r.request_id}
    want = {}
    for key, source in ((1, 0), (2, n + 3), (2, 10**6)):
        dist, before = dijkstra(edges, source)
        want |= {(key, source, v): (dist[v], before[v]) for v in dist}
    assert got == want
    targets = spark.createDataFrame([(1, 0, n * n - 1), (1, 0, 0), (2, n + 3, 7), (1, 0, n * n + 5), (1, 0, -4)], "request_id long, source long, target long")
    made = {}
    for r in graph.ways(paths, targets, KEY).orderBy("request_id", "target", "seq").collect():
        made.setdefault((r.request_id, r.source, r.target), []).append(r.node_id)
    plain = {}
    for key, source, target in ((1, 0, n * n - 1), (1, 0, 0), (2, n + 3, 7), (1, 0, n * n + 5)):
        way = [target]
        while want[(key, source, way[-1])][1] is not None:
            way.append(want[(key, source, way[-1])][1])
        plain[(key, source, target)] = way[::-1]
    assert made == plain


@pytest.mark.parametrize("size,step,max_m", [(90, 1, None), (40, 25, None), (90, 25, 1500.0), (10**6, 1, None)])
def test_blocks_of_one_network_are_dijkstras(spark, monkeypatch, size, step, max_m):
    """A lattice of 24 x 24 nodes in blocks, with streets of no length in and between blocks, also as rings, nodes without a
    place, a street back across all of it, and a source without streets."""
    monkeypatch.setattr(blocks, "BLOCK", size)
    n, draw = 24, random.Random(size + step)
    edges = [*lattice(n, 3, step), (n * n - 1, 1, 0, 10.0), (5, n * n + 5, 0, 0.0), (n * n + 5, 5, 0, 0.0), (n * n + 5, n * n + 6, 0, 3.0)]
    for _ in range(60):
        u = draw.randrange(n * n - n)
        edges += [(u, u + n, 1, 0.0), (u + n, u, 1, 0.0)]
    table = spark.createDataFrame(edges, "u long, v long, key long, length double")
    rows = [(i * n + j, 42 + i * 0.001, -71 + j * 0.001) for i in range(n) for j in range(n)]
    rows[7], rows[300], rows[410] = (7, None, -71.0), (300, float("nan"), 1.0), (410, 42.0, None)
    nodes = spark.createDataFrame(rows, "node_id long, lat double, lon double")
    sources = spark.createDataFrame([(1, 0), (2, n + 3), (2, 10**6), (None, 0)], "request_id long, source long")
    paths = graph.shortest_paths(sources, table, KEY, max_m=max_m, most_rounds=40, nodes=nodes).cache()
    got = {(r.request_id, r.source, r.node_id): r.dist for r in paths.collect()}
    assert len(got) == paths.count()
    want = {}
    for key, source in ((1, 0), (2, n + 3), (2, 10**6)):
        want |= {(key, source, v): d for v, d in dijkstra(edges, source)[0].items() if max_m is None or d <= max_m}
    assert got == want
    # nodes before each other lead to the source over streets of that length
    light = {}
    for u, v, _, length in edges:
        light[u, v] = min(length, light.get((u, v), math.inf))
    before = {(r.request_id, r.source, r.node_id): r.before for r in paths.collect()}
    for (key, source, v), d in want.items():
        hops = 0
        while before[key, source, v] is not None:
            u = before[key, source, v]
            assert want[key, source, u] + light[u, v] == want[key, source, v] and (hops := hops + 1) <= n * n + 2
            v = u
        assert v == source


def test_one_town_takes_rounds_by_blocks(spark, monkeypatch):
    """Tables written for the least ways of a town of 1,500 nodes, 39 streets wide: they do not follow its width."""
    from loopmill.jobs import registry

    written = []
    for module in (graph, blocks):
        plain = module.settle
        monkeypatch.setattr(module, "settle", lambda df, plain=plain: (written.append(1), plain(df))[1])
    monkeypatch.setattr(graph, "way_sums", lambda paths, keys: paths.selectExpr("request_id", "source", "node_id AS target"))
    assert registry.queries()["g1_town_ways"](spark, "/root/testdata/sf0.01").count() == 1500
    assert len(written) < 10


def test_paths_of_nothing(spark):
    edges = spark.createDataFrame([], "u long, v long, key long, length double")
    none = spark.createDataFrame([], "request_id long, source long")
    assert graph.shortest_paths(none, edges, KEY).count() == 0
    one = spark.createDataFrame([(1, 5)], "request_id long, source long")
    assert [tuple(r) for r in graph.shortest_paths(one, edges, KEY).collect()] == [(1, 5, 5, 0.0, None)]
    with pytest.raises(ValueError):
        graph.shortest_paths(one, spark.createDataFrame([(5, 6, 0, -1.0)], edges.schema), KEY)


def box_of(lat, lon, radius):
    """Whether a place is in the box, stated plainly."""
    half = radius / 111320.0
    flat = math.cos(math.radians(lat))
    wide = half / flat if flat > 1e-12 else math.inf

    def holds(a, b):
        if not lat - half <= a <= lat + half:
            return False
        return wide >= 180 or lat + half >= 90 or lat - half <= -90 or any(lon - wide <= b + t <= lon + wide for t in (0, 360, -360))

    return holds


def test_boxes_at_the_seam_the_poles_and_of_any_size(spark):
    draw = random.Random(3)
    nodes = [(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(1500)]
    nodes += [(2000 + 9 * i + j, 10 + 0.002 * i, (179.992 + 0.002 * j + 180) % 360 - 180) for i in range(9) for j in range(9)]
    nodes += [(3000 + i, 89.99, -180 + 18.0 * i) for i in range(20)] + [(4000, None, 1.0), (4001, 1.0, float("nan")), (4002, -90.0, 0.0), (4003, 10.0, 180.0)]
    requests = [(1, 10.008, 180.0, 1500.0), (2, 10.008, -179.999, 1500.0), (3, 90.0, 0.0, 2000.0), (4, -90.0, 7.0, 5e6), (5, 20.0, 170.0, 5e6), (6, 0.0, 0.0, 5e9), (7, 89.995, 100.0, 3000.0), (8, 45.0, -100.0, 9e5)]
    requests += [(9, None, 1.0, 5.0), (10, 1.0, 1.0, None), (11, -60.0, 0.0, 1.0)]
    asked = spark.createDataFrame(requests, "request_id long, lat double, lon double, radius_m double")
    known = spark.createDataFrame(nodes, "node_id long, lat double, lon double")
    got = {}
    for r in graph.nodes_in_boxes(graph.with_boxes(asked), known).collect():
        got.setdefault(r.request_id, []).append(r.node_id)
    for key, lat, lon, radius in requests[:8]:
        holds = box_of(lat, lon, radius)
        assert sorted(got[key]) == [i for i, a, b in nodes if a is not None and b == b and holds(a, b)], key
    assert len([i for i in got[1] if 2000 <= i < 2100]) == 81 and len(got[6]) == len(nodes) - 2 and not {9, 10, 11} & set(got)
    edges = spark.createDataFrame([(2000, 2001, 0, 5.0), (2001, 1, 0, 5.0)], "u long, v long, key long, length double")
    own, within, rejects = graph.subgraph(asked, known, edges)
    assert {r.request_id: r.reason for r in rejects.collect()} == {8: graph.FEW_NODES, 9: graph.NO_NODES, 10: graph.NO_NODES, 11: graph.NO_NODES}
    assert {(r.request_id, r.u) for r in within.collect()} >= {(1, 2000), (2, 2000), (6, 2000), (6, 2001)}


def test_nearest_in_the_own_box(spark):
    draw = random.Random(8)
    nodes = [(i, draw.uniform(42, 42.2), draw.uniform(-71.2, -71)) for i in range(300)] + [(900, 60.0, 179.99)]
    boxes = [(1, 42.1, -71.1, 4000.0), (2, 42.02, -71.02, 9000.0), (3, 60.0, -179.9, 20000.0), (4, 0.0, 0.0, 100.0)]
    points = [(k, p, draw.uniform(a - 0.1, a + 0.1), draw.uniform(b - 0.1, b + 0.1)) for k, a, b, _ in boxes for p in range(6)] + [(1, 9, None, 0.0)]
    asked = graph.with_boxes(spark.createDataFrame(boxes, "request_id long, lat double, lon double, radius_m double"))
    rows = spark.createDataFrame(points, "request_id long, place long, lat double, lon double")
    got = {(r.request_id, r.place): r.node_id for r in graph.nearest_in_box(rows, asked, spark.createDataFrame(nodes, "node_id long, lat double, lon double"), ["request_id", "place"], 0.001).collect()}
    far = lambda a, b, c, d: math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    want = {}
    for k, lat, lon, radius in boxes:
        own = [n for n in nodes if box_of(lat, lon, radius)(n[1], n[2])]
        want |= {(k, p): min(own, key=lambda n: (far(a, b, n[1], n[2]), n[0]))[0] for q, p, a, b in points if q == k and a is not None and own}
    assert got == want and {k for k, _ in want} == {1, 2, 3}


def test_any_number_of_routes_is_decided(spark):
    """A request of 2,000 routes that all pass the start, with equal ones, and chains; others beside it are folded plainly."""
    draw = random.Random(4)
    routes = {}
    for k in range(3):
        base = [{(0, 0)} | {(draw.randrange(40), draw.randrange(40)) for _ in range(draw.choice([12, 30]))} for _ in range(4 + 2 * k)]
        for no in range(60):
            own = set(draw.choice(base))
            for _ in range(draw.randrange(4)):
                own ^= {(draw.randrange(40), draw.randrange(40))}
            routes[(k, no)] = own or {(0, 0)}
    routes |= {(None, no): {(0, no % 2)} for no in range(5)}
    routes |= {(9, no): {(0, 0), (1, no % 1500), (2, no % 1500), (3, no % 1500)} for no in range(2000)}
    members = spark.createDataFrame([(k, no, float(x), float(y)) for (k, no), s in routes.items() for x, y in s], "request_id long, route_no long, lat double, lon double")
    got = sorted(((r.request_id is None, r.request_id or 0, r.route_no) for r in graph.dedupe_routes(members).collect()))
    want = [(True, 0, 0), (True, 0, 1)] + [(False, 9, no) for no in range(1500)]
    for k in range(3):
        kept = []
        for no in range(60):
            s = routes[(k, no)]
            if all(len(s & routes[(k, o)]) / len(s | routes[(k, o)]) <= 0.8 for o in kept):
                kept.append(no)
        want += [(False, k, no) for no in kept]
    assert got == sorted(want)


def test_route_length_takes_the_first_parallel_edge(spark):
    edges = spark.createDataFrame([(1, 2, 0, 900.0), (1, 2, 1, 4.0)], "u long, v long, key long, length double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.1)], "node_id long, lat double, lon double")
    routes = spark.createDataFrame([(1, 0, 0, 1), (1, 0, 1, 2), (1, 0, 2, 1)], "request_id long, route_no long, seq long, node_id long")
    lengths, _ = graph.validate_routes(routes, edges, nodes, ["request_id", "route_no"])
    assert lengths.first().street_km == pytest.approx(0.9)


def test_dedupe_chain_keeps_what_is_like_a_dropped_route(spark):
    a = {(0, i) for i in range(10)}
    b = a - {(0, 0)} | {(1, 0)}
    c = b - {(0, 1)} | {(1, 1)}
    routes = {0: a, 1: b, 2: c, 3: a}
    rows = [(5, k, float(x), float(y)) for k, s in routes.items() for x, y in s]
    members = spark.createDataFrame(rows, "request_id long, route_no long, lat double, lon double")
    assert sorted(r.route_no for r in graph.dedupe_routes(members, 0.8).collect()) == [0, 2]
    assert sorted(r.route_no for r in graph.dedupe_routes(members, 0.6).collect()) == [0]


def test_nearest_node_across_cells(spark):
    import random

    draw = random.Random(5)
    nodes = [(i, draw.uniform(-80, 80), draw.uniform(-179, 179)) for i in range(40)]
    nodes += [(50, 89.9, 10.0), (51, -89.5, -170.0), (52, 10.0, -179.9), (53, 10.0, 170.0), (54, 0.0, -100.0), (55, 0.0, -100.0), (56, None, 1.0)]
    points = [(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(40)]
    points += [(50, 10.0, 179.9), (51, 10.0, -179.95), (52, 89.99, -170.0), (53, -90.0, 0.0), (54, 0.0, -100.0), (55, 0.0, 80.0)]
    lost = [(90, None, 0.0), (91, 0.0, float("nan"))]
    known = spark.createDataFrame(nodes, "node_id long, lat double, lon double")
    got = graph.nearest_node(spark.createDataFrame(points + lost, "p long, lat double, lon double"), known, ["p"], 2.0)
    pairs = spark.createDataFrame(points, "p long, lat double, lon double").crossJoin(spark.createDataFrame(nodes, "node_id long, a double, b double").filter("a IS NOT NULL"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))
    best = {r.p: r.best for r in pairs.groupBy("p").agg(F.min(F.struct(km.alias("km"), F.col("node_id"))).alias("best")).collect()}
    assert {r.p: r.node_id for r in got.collect()} == {p: b.node_id for p, b in best.items()} and best[50].node_id == 52 and best[54].node_id == 54
    # with narrow cubes most points are found by descent
    narrow = graph.nearest_node(spark.createDataFrame(points, "p long, lat double, lon double"), known, ["p"], 0.001)
    assert {r.p: r.node_id for r in narrow.collect()} == {p: b.node_id for p, b in best.items()}
    twice = spark.createDataFrame([(None, 1.0, 2.0), (None, 1.0, 2.0)], "p long, lat double, lon double")
    assert graph.nearest_node(twice, known, ["p"]).count() == 2 and graph.nearest_node(twice, known.filter("false"), ["p"]).count() == 0


def test_candidates_are_loops_within_bounds(spark, sf):
    requests, nodes, edges = (fixture(spark, sf, n) for n in ("loop_requests", "street_nodes", "street_edges"))
    points, rejects = candidates.candidate_routes(requests, nodes, edges)
    rows = points.collect()
    again = candidates.candidate_routes(requests, nodes, edges)[0].collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and rows
    target = {r.request_id: r.target_distance_km for r in requests.collect()}
    first = {}
    for r in edges.orderBy("u", "v", "key").collect():
        first.setdefault((r.u, r.v), r.length)
    ways = {}
    for r in sorted(rows, key=lambda r: (r.request_id, r.candidate_no, r.seq)):
        ways.setdefault((r.request_id, r.candidate_no), []).append(r.node_id)
    for (request, _), way in ways.items():
        assert way[0] == way[-1]
        km = sum(first.get(x, 0.0) for x in zip(way, way[1:])) / 1000
        assert 0.7 * target[request] - 1e-9 <= km <= 1.3 * target[request] + 1e-9
    sets = {k: set(w) for k, w in ways.items()}
    for (r, a), x in sets.items():
        for (q, b), y in sets.items():
            assert r != q or a >= b or len(x & y) / len(x | y) <= 0.8
    assert {r.request_id for r in rejects.collect()} | {k[0] for k in ways} == set(target)


def test_start_lies_in_the_requests_own_network(spark):
    """A lone node just outside the box is nearer, but is no start."""
    lattice = [(10 * i + j + 1, 42.0 + 0.001 * i, -71.0 + 0.00125 * j) for i in range(5) for j in range(5)]
    nodes = spark.createDataFrame([*lattice, (999, 42.0 - 0.0134 - 0.0181, -71.018)], "node_id long, lat double, lon double")
    ids = {n for n, _, _ in lattice}
    steps = [(n, n + d, 0, 100.0) for n in ids for d in (1, 10, -1, -10) if n + d in ids]
    edges = spark.createDataFrame(steps, "u long, v long, key long, length double")
    request = spark.createDataFrame([(1, 42.0 - 0.0134, -71.018, 1.0)], "request_id long, lat double, lon double, target_distance_km double")
    assert graph.nearest_node(request, nodes, ["request_id"]).first().node_id == 999
    boxes = graph.with_boxes(request.withColumn("radius_m", F.lit(2000.0)))
    starts, _ = candidates.placed(request, candidates.tries(request), boxes, nodes)
    assert [tuple(r) for r in starts.collect()] == [(1, 1)]


def test_requests_of_one_town_share_a_network_and_joins_find_the_same(spark):
    """Many requests in one cell, bad ones beside them; helper and joins alike."""
    draw = random.Random(6)
    nodes = [(10 * i + j + 1, 42.0 + 0.001 * i, -71.0 + 0.00125 * j) for i in range(10) for j in range(10)]
    ids = {n for n, _, _ in nodes}
    steps = [(n, n + d, 0, 80.0 + draw.randrange(5) * 10) for n in sorted(ids) for d in (1, 10, -1, -10) if n + d in ids and not (d in (1, -1) and (n - 1) // 10 != (n + d - 1) // 10)]
    across = [(5000 + 10 * i + j, -17.0 + 0.001 * i, (179.996 + 0.001 * j + 180) % 360 - 180) for i in range(8) for j in range(8)]
    known = {n for n, _, _ in across}
    steps += [(n, n + d, 0, 105.0) for n in sorted(known) for d in (1, 10, -1, -10) if n + d in known]
    requests = [(k, 42.003 + draw.random() * 0.002, -70.997 + draw.random() * 0.002, draw.choice([1.0, 1.25, 1.5])) for k in range(70)]
    requests += [(100, -16.9965, 180.0, 1.2), (101, 90.0, 0.0, 1.0), (102, 10.0, 10.0, 5000.0), (103, None, 0.0, 1.0), (104, 42.0, -71.0, 1e7)]
    asked = spark.createDataFrame(requests, "request_id long, lat double, lon double, target_distance_km double")
    tables = [spark.createDataFrame(nodes + across, "node_id long, lat double, lon double"), spark.createDataFrame(steps, "u long, v long, key long, length double")]
    town = graph.with_boxes(asked.filter("request_id < 70").withColumn("radius_m", F.lit(1500.0)))
    assert candidates.grouped(town).select("network").distinct().count() <= 2
    small = asked.filter("request_id IN (1, 2, 3) OR request_id BETWEEN 100 AND 103")
    sides = []
    for most in (candidates.MOST_EDGES, 0):
        points, rejects = candidates.candidate_routes(small, *tables, most_edges=most)
        sides.append((sorted(map(tuple, points.collect())), sorted(map(tuple, rejects.collect()))))
    assert sides[0] == sides[1] and {r[0] for r in sides[0][0]} == {1, 2, 3, 100}
    assert dict(sides[0][1]) == {101: graph.NO_NODES, 102: graph.NO_NODES, 103: graph.NO_NODES}
    points, rejects = candidates.candidate_routes(asked, *tables)
    rows = sorted(map(tuple, points.collect()))
    assert [r for r in rows if r[0] in (1, 2, 3, 100)] == sides[0][0]
    assert {r[0] for r in rows} == {*range(70), 100} and {r.request_id for r in rejects.collect()} == {101, 102, 103, 104}


def test_figure_eight_passes_the_start_three_times(spark, sf):
    from loopmill.jobs import registry

    ways = {}
    for r in registry.g5_figure_eight(spark, sf).orderBy("request_id", "seq").collect():
        ways.setdefault(r.request_id, []).append(r.node_id)
    assert ways and all(w[0] == w[-1] and w.count(w[0]) >= 3 for w in ways.values())
    edges = {(r.u, r.v) for r in fixture(spark, sf, "street_edges").collect()}
    assert all(a == b or (a, b) in edges for w in ways.values() for a, b in zip(w, w[1:]))


def test_grades_count_by_their_number(spark):
    rows = [(i, "manual", None, 2.0, g, 7.0) for i, g in enumerate(["2.5%", " 3 pct", "-1", ".5e1x", "", "up 3", None, "1e", "0"])]
    asked = spark.createDataFrame(rows, "request_id long, mode string, track_id long, distance_km double, grade string, gain_m double")
    none = spark.createDataFrame([], "track_id long, distance_km double, elevation_gain_m double")
    got = [r.gain_m for r in ranking.resolve_targets(asked, none).orderBy("request_id").collect()]
    assert got == pytest.approx([50.0, 60.0, -20.0, 100.0, 7.0, 7.0, 7.0, 20.0, 0.0])


def test_suggestions_of_long_and_short_queries(spark):
    rows = [(i, f"Long Name Street {i % 20}", "", None, "X", None, None, None, 1.0, 2.0, float(i % 9), None, "t") for i in range(200)]
    kind = "place_id long, name string, city string, state string, country string, countrycode string, housenumber string, street string, lat double, lon double, importance double, osm_value string, type string"
    asked = spark.createDataFrame([(1, "long name street 1"), (2, "LO"), (3, "l"), (4, None), (5, "long name street 19 "), (6, "zz")], "query_id long, query string")
    got = {}
    for r in places.place_suggest(asked, spark.createDataFrame(rows, kind)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.place_id)
    best = lambda start: [i for i, *_ in sorted((r for r in rows if r[1].lower().startswith(start)), key=lambda r: (-r[10], r[0]))][:5]
    assert got == {1: best("long name street 1"), 2: best("lo"), 5: best("long name street 19")}


def test_ranking_keeps_order_of_equal_scores(spark):
    rows = [(1, 0, 5.0, 0.0), (1, 1, 10.0, 0.0), (1, 2, 10.0, 0.0), (1, 3, 10.0, 500.0)]
    candidates_ = spark.createDataFrame(rows, "request_id long, candidate_no long, distance_km double, elevation_gain_m double")
    requests = spark.createDataFrame([(1, 10.0, 0.0, 3)], "request_id long, target_distance_km double, target_elevation_gain_m double, num_results long")
    got = ranking.rank_routes(ranking.score_routes(candidates_, requests)).orderBy("rank").collect()
    assert [(r.candidate_no, r.similarity_score, r.name) for r in got] == [(1, 1.0, "Route 1"), (2, 1.0, "Route 2"), (0, 0.8, "Route 3")]


def test_requests_are_judged(spark):
    rows = [(1, "x", 5.0, 0.0, None), (2, " ", 5.0, 0.0, 3), (3, "x", 0.0, 0.0, 3), (4, "x", 5.0, -1.0, 3), (5, "x", 5.0, 0.0, 21), (6, None, None, None, 0), (7, "x", 1e6, 0.0, 3), (8, "x", float("nan"), 0.0, 3)]
    got = ranking.validate_requests(spark.createDataFrame(rows, "request_id long, location string, target_distance_km double, target_elevation_gain_m double, num_results long")).orderBy("request_id").collect()
    assert [r.reason is None for r in got] == [True] + [False] * 7 and got[0].num_results == 5


GOOD = (
    '<g:gpx xmlns:g="http://www.topografix.com/GPX/1/1"><g:wpt lat="9" lon="9"><g:ele>1</g:ele></g:wpt><g:trk><g:trkseg><g:trkpt lat="1" lon="2"><g:ele>5</g:ele></g:trkpt>'
    '<g:trkpt lat="1" lon="3"/></g:trkseg><g:trkseg><g:trkpt lat="1" lon="4"><g:ele>7</g:ele></g:trkpt></g:trkseg></g:trk><g:rte><g:rtept lat="2" lon="2"><g:ele>6</g:ele></g:rtept></g:rte></g:gpx>'
)
FILES = [("a.GPX", GOOD), ("b.gpx", GOOD[:200]), ("c.gpx", '<gpx><trk><trkseg><trkpt lat="1" lon="2"/></trkseg></trk></gpx>'), ("d.txt", GOOD), ("e.gpx", '<gpx><trk><trkseg><trkpt lon="2"><ele>1</ele></trkpt></trkseg></trk></gpx>')]


def test_gpx_files(spark):
    points, bad = gpx.read_gpx(spark.createDataFrame(FILES, "track_id string, content string"))
    assert [(r.track_id, r.seq, r.lat, r.lon, r.ele) for r in points.orderBy("seq").collect()] == [("a.GPX", 0, 1.0, 2.0, 5.0), ("a.GPX", 1, 1.0, 3.0, None), ("a.GPX", 2, 1.0, 4.0, 7.0), ("a.GPX", 3, 2.0, 2.0, 6.0)]
    assert {r.track_id: r.reason for r in bad.collect()} == {"b.gpx": gpx.BROKEN, "c.gpx": gpx.NO_POINTS, "d.txt": gpx.NOT_GPX, "e.gpx": gpx.BROKEN}


def test_stream_equals_batch(spark, tmp_path):
    from loopmill.operators.tracks import profile_summary

    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, content in FILES:
        (inbox / name).write_text(content)
    (inbox / "f.gpx").write_bytes(GOOD.encode() + b"\xff")
    started = gpx_stream.start(gpx_stream.file_stream(spark, str(inbox)), str(tmp_path / "p"), str(tmp_path / "r"), str(tmp_path / "c"))
    started.awaitTermination()
    points, bad = gpx.read_gpx(gpx.read_files(spark, str(inbox)))
    batch = profile_summary(points, ["track_id"])
    assert sorted(spark.read.parquet(str(tmp_path / "p")).drop("batch").collect()) == sorted(batch.collect())
    assert spark.read.parquet(str(tmp_path / "r")).count() == bad.count() == 5
    assert {r.track_id.rpartition("/")[2] for r in bad.filter(F.col("reason") == gpx.BROKEN).collect()} == {"b.gpx", "e.gpx", "f.gpx"}


def test_stream_leaves_no_scratch_and_no_half_batch(spark, tmp_path):
    """Many batches leave outputs alone; a batch that died between its two tables is not read."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "loopmill"
    before = set(shared.glob("*")) if shared.exists() else set()
    base = spark.createDataFrame(FILES, "track_id string, content string")
    out = [str(tmp_path / n) for n in ("p", "r")]
    assert gpx_stream.read_committed(spark, *out) is None
    for number in range(5):
        gpx_stream.write_batch(base, number, *out)
    assert (set(shared.glob("*")) if shared.exists() else set()) == before
    gpx_stream.write_batch(base, 2, *out)  # runs again
    half = spark.createDataFrame([("lost.gpx", 1.0, 0.0, 0.0, 0.0, 0.0)], spark.read.parquet(f"{out[0]}/batch=0").schema)
    half.write.parquet(f"{out[0]}/batch=9")
    profiles_, rejects_ = gpx_stream.read_committed(spark, *out)
    assert sorted(r.batch for r in profiles_.collect()) == [0, 1, 2, 3, 4] and rejects_.count() == 20
    assert profiles_.filter("track_id = 'lost.gpx'").count() == 0


def test_a_place_without_importance_comes_last(spark):
    rows = [(1, "Town", 1.0, 1.0, None), (2, "town ", 2.0, 2.0, 0.9), (3, "Town", 3.0, 3.0, float("nan")), (4, "Else", 4.0, 4.0, None)]
    known = spark.createDataFrame(rows, "place_id long, name string, lat double, lon double, importance double")
    found, missed = places.geocode(spark.createDataFrame([(1, " TOWN"), (2, "else"), (3, None)], "request_id long, location string"), known)
    assert {r.request_id: r.place_id for r in found.collect()} == {1: 2, 2: 4} and missed.count() == 1


def test_write_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (2, 0)], "request_id long, route_no long")
    ranking.write_results(rows, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_place_display(spark):
    rows = [("A", "B", None, "US", "US", "1", "S"), ("B", "B", "T", "X", None, None, "S"), (None, None, None, "United States", None, None, None), ("N", None, None, None, None, "2", None)]
    got = places.place_display(spark.createDataFrame(rows, "name string, city string, state string, country string, countrycode string, housenumber string, street string"))
    assert [r.display for r in got.collect()] == ["A, 1 S, B", "S, B, T, X", "Unknown location", "N"]


def test_routes_have_elevations(spark, sf):
    """The grid covers all streets, with one value a cell, and tells candidates apart."""
    from loopmill.jobs import registry
    from loopmill.sources.fixtures import fixture

    grid = fixture(spark, sf, "street_elevation").collect()
    cells = {(r.cell_y, r.cell_x) for r in grid}
    assert len(cells) == len(grid)
    nodes = fixture(spark, sf, "street_nodes").selectExpr("floor(lat / 0.001) AS y", "floor(lon / 0.001) AS x").collect()
    assert {(r.y, r.x) for r in nodes} <= cells
    rows = [r for r in registry.find_routes(spark, sf).collect() if r.reason is None]
    assert rows and min(r.min_elevation_m for r in rows) >= 10 and len({r.elevation_gain_m for r in rows}) > 1


def _broadcast_nodes(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_points_around_cubes_are_not_broadcast(spark, monkeypatch):
    """Rows of a small file, times 27 cubes each, stay off the driver whatever Spark takes the file for."""
    from loopmill.operators import graph as module

    seen = []
    plain = module._best
    monkeypatch.setattr(module, "_best", lambda pairs, *rest: (seen.append(_broadcast_nodes(pairs)), plain(pairs, *rest))[1])
    nodes = spark.range(50).selectExpr("id AS node_id", "42 + id * 0.001D AS lat", "-71D AS lon")
    points = spark.range(50).selectExpr("id AS point_id", "42 + id * 0.001D AS lat", "-71.0001D AS lon")
    assert module.nearest_node(points, nodes, ["point_id"]).count() == 50
    boxes = module.with_boxes(points.selectExpr("point_id AS request_id", "lat", "lon", "500D AS radius_m"))
    asked = points.selectExpr("point_id AS request_id", "0 AS place", "lat", "lon")
    assert module.nearest_in_box(asked, boxes, nodes, ["request_id", "place"]).count() == 50
    assert seen and not any(seen)


def test_box_beyond_a_pole_has_no_cells(spark, monkeypatch):
    """A box whose south end is above 90 degrees holds nothing; it once took every row of cells back to the pole."""
    from pyspark.sql import functions as F

    from loopmill.operators import graph as module

    boxes = module.with_boxes(spark.createDataFrame([(1, 150.0, -71.0, 500.0), (2, 42.0, -71.0, 500.0)], "request_id long, lat double, lon double, radius_m double"))
    nodes = spark.createDataFrame([(1, 150.0, -71.0), (2, 42.0, -71.0), (3, 120.0, -71.0)], "node_id long, lat double, lon double")
    made, plain = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (made.append(df.count()), plain(df))[1])
    assert [tuple(r) for r in module.nodes_in_boxes(boxes, nodes).select("request_id", "node_id").collect()] == [(2, 2)]
    assert made and sum(made) < 50


def test_many_boxes_and_few_give_the_same(spark, monkeypatch):
    from loopmill.operators import graph as module

    nodes = spark.range(400).selectExpr("id AS node_id", "42 + floor(id / 20) * 0.001D AS lat", "-71 + id % 20 * 0.001D AS lon")
    boxes = module.with_boxes(nodes.selectExpr("node_id AS request_id", "lat", "lon", "150D + node_id * 20 AS radius_m"))
    few = sorted(map(tuple, module.nodes_in_boxes(boxes, nodes).collect()))
    monkeypatch.setattr(module, "FEW_BOXES", 0)
    assert sorted(map(tuple, module.nodes_in_boxes(boxes, nodes).collect())) == few


def test_far_points_meet_few_of_many_near_nodes(spark, monkeypatch):
    """Points far from a crowd of nodes, beside the pole and opposite to it, find the right one among a few."""
    import math

    from loopmill.operators import graph as module

    met, plain = [], module._best
    monkeypatch.setattr(module, "_best", lambda pairs, *rest: (met.append(pairs.count()), plain(pairs, *rest))[1])
    nodes = spark.range(2000).selectExpr("id AS node_id", "42 + id % 25 * 0.001D AS lat", "-71 + floor(id / 25) * 0.001D AS lon")
    points = spark.createDataFrame([(1, 132.0, -71.0), (2, 60.0, -70.97), (3, 89.999, 10.0), (4, 222.0013, -71.004), (5, 42.0123, -70.95)], "point_id long, lat double, lon double")
    got = {r.point_id: (r.node_id, r.distance_km) for r in module.nearest_node(points, nodes, ["point_id"]).collect()}

    def km(a, b):
        p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2)))

    known = [(r.lat, r.lon) for r in nodes.orderBy("node_id").collect()]
    for p in points.collect():
        assert abs(got[p.point_id][1] - min(km((p.lat, p.lon), n) for n in known)) < 1e-3 * max(1.0, got[p.point_id][1] / 1000)
    assert sum(met) < 5 * 400


def test_sums_of_ways_are_those_of_written_ways(spark):
    """The same numbers as from the ways themselves, with a few rows for each node instead of a row for each step."""
    from pyspark.sql import functions as F

    from loopmill.operators import graph as module

    first = "CASE WHEN node_id = 0 THEN NULL WHEN node_id % 7 = 3 THEN floor(node_id / 2) ELSE node_id - 1 END"
    paths = spark.range(60).selectExpr("id % 2 AS request_id", "0L AS source", "id DIV 2 AS node_id").selectExpr("*", f"CAST({first} AS BIGINT) AS before")
    ways = module.ways(paths, paths.withColumn("target", F.col("node_id")), ["request_id"])
    want = ways.groupBy("request_id", "source", "target").agg(F.count("*").alias("nodes"), F.sum(F.col("seq") * F.col("node_id")).alias("way_sum"))
    got = module.way_sums(paths, ["request_id"]).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 60


@pytest.mark.parametrize("strategy", ["directional", "out_and_back", "random", "figure_eight"])
def test_tries_are_not_broadcast(spark, sf, monkeypatch, strategy):
    """Tries with their draws and stops, some 20 a request, stay off the driver however few their bytes are."""
    seen, plain = [], candidates._by_helper

    def watched(asked, *rest):
        asked.collect()
        seen.append(_broadcast_nodes(asked))
        return plain(asked, *rest)

    monkeypatch.setattr(candidates, "_by_helper", watched)
    tables = [fixture(spark, sf, n) for n in ("loop_requests", "street_nodes", "street_edges")]
    asked = tables[0].withColumn("radius_m", geo.search_bounds(F.col("target_distance_km"))["radius_m"])
    assert candidates.loops(asked, *tables[1:], (strategy,))[0].count() and seen == [0]


@pytest.mark.parametrize("step,odd", [(1, []), (25, []), (25, [(7, 8, 0, 0.0), (8, 7, 0, 0.0)]), (1, [(3, 90, 0, float("nan")), (90, 3, 0, 1e-300)])])
def test_ways_of_all_stops_at_once_are_those_of_each(step, odd):
    import numpy as np

    n = 12
    streets = [(u, v, length) for u, v, _, length in [*lattice(n, 4, step), *odd] if u != 17]
    u, v, length = (np.array(c) for c in zip(*streets))
    sources = [0, 50, n * n - 1]
    trees = candidates.Trees(n * n + 1, u, v, length, sources)
    assert trees.known == (not odd)  # streets that change no sum are left to the search from each
    way_of = candidates._ways(n * n + 1, (u, v, length), sources)
    out = candidates.Network.streets(u, v, length)
    for s in sources:
        tree = candidates.Tree(s, out)
        assert all(way_of(s, t) == tree.way(t) for t in range(n * n + 1))


def test_searches_are_dealt_to_tasks_by_their_number(spark, sf, monkeypatch):
    """Slices are few bytes and long work: Spark does not merge their partitions."""
    monkeypatch.setattr(candidates, "SLICE", 1)
    monkeypatch.setattr(candidates, "TASK", 1)
    made, plain = [], candidates._by_helper
    monkeypatch.setattr(candidates, "_by_helper", lambda *a: (made.append(plain(*a)), made[0])[1])
    asked, nodes, edges = (fixture(spark, sf, n) for n in ("town_requests", "town_nodes", "town_edges"))
    many = asked.crossJoin(spark.range(8)).withColumn("request_id", F.col("request_id") * 8 + F.col("id")).drop("id")
    candidates.candidate_routes(many, nodes, edges)
    assert made[0].rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_places_of_routes_and_found_stops_are_not_broadcast(spark, monkeypatch):
    seen, plain = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: (df.collect(), seen.append(_broadcast_nodes(df)), plain(df))[2])
    members = spark.range(60).selectExpr("id % 3 AS request_id", "floor(id / 12) AS route_no", "42D + id % 7 * 0.001D AS lat", "-71D AS lon")
    assert graph.similar_routes(members)[0].count()
    nodes = spark.range(50).selectExpr("id AS node_id", "42 + id * 0.001D AS lat", "-71D AS lon")
    boxes = graph.with_boxes(nodes.selectExpr("node_id AS request_id", "lat", "lon", "500D AS radius_m"))
    assert graph.nearest_in_box(nodes.selectExpr("node_id AS request_id", "0 AS place", "lat", "lon"), boxes, nodes, ["request_id", "place"]).count() == 50
    assert seen and not any(seen)


def test_ways_are_not_broadcast(spark, monkeypatch):
    """Nor is any table of pointers that ways are filled from: their compressed files are small at any size."""
    seen, plain = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: (df.collect(), seen.append(_broadcast_nodes(df)), plain(df))[2])
    edges = spark.range(12).selectExpr("id AS u", "id + 1 AS v", "0 AS key", "1D AS length")
    sources = spark.range(1).selectExpr("id AS request_id", "id AS source")
    paths = plain(graph.shortest_paths(sources, edges, KEY))
    found = graph.ways(paths, paths.withColumn("target", F.col("node_id")), KEY)
    assert len(found.collect()) == 13 * 14 // 2 and seen and not any(seen) and not _broadcast_nodes(found)
