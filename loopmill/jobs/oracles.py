"""DuckDB SQL of the registered queries, over derived tables."""

from __future__ import annotations

from loopmill.sources.fixtures import with_fixtures


def _hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(12742.0 * atan2(sqrt({a}), sqrt(CASE WHEN {a} > 1 THEN 0 ELSE 1 - {a} END)))"


def _round(x: str, n: int) -> str:
    """Half up on the shortest decimal form, as Spark rounds doubles."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {n}) AS DOUBLE)"


_KEPT = f"""kept AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ele) OVER w AS pele
  FROM track_points WHERE ele IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
walked AS (SELECT *, sum(coalesce({_hav("plat", "plon", "lat", "lon")}, 0)) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum_km FROM kept)"""
_CLIMB = """round(coalesce(sum(CASE WHEN ele - pele > 0 THEN ele - pele ELSE 0 END), 0), 1) AS elevation_gain_m,
  round(coalesce(sum(CASE WHEN ele - pele > 0 THEN 0 ELSE coalesce(abs(ele - pele), 0) END), 0), 1) AS elevation_loss_m,
  round(min(ele), 1) AS min_elevation_m, round(max(ele), 1) AS max_elevation_m"""
_SUMMARY = f"{_KEPT}, summary AS (SELECT track_id, round(max(cum_km), 3) AS distance_km, {_CLIMB} FROM walked GROUP BY track_id)"
_PROFILE = f"{_KEPT}, profile AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS seq, round(cum_km, 3) AS km, round(ele, 1) AS ele FROM walked)"
_SIMPLE = f"""{_PROFILE},
pts AS (SELECT *, count(*) OVER p AS n, lead(km) OVER o AS nkm, lead(ele) OVER o AS nele, last_value(km) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total
  FROM profile WINDOW p AS (PARTITION BY track_id), o AS (PARTITION BY track_id ORDER BY seq)),
targets AS (SELECT track_id, i AS idx, i * (total / 49) AS t FROM pts, range(50) r(i) WHERE n > 50 AND seq = 0),
lefts AS (SELECT t.track_id, t.idx, t.t, coalesce(max(p.seq), 0) AS lseq FROM targets t LEFT JOIN pts p ON p.track_id = t.track_id AND p.km < t.t GROUP BY ALL),
simple AS (
  SELECT track_id, seq AS idx, km, ele FROM pts WHERE n <= 50
  UNION ALL
  SELECT l.track_id, l.idx, round(l.t, 3), round(CASE WHEN p.nkm IS NULL OR p.nkm - p.km <= 0 THEN p.ele ELSE p.ele + (l.t - p.km) / (p.nkm - p.km) * (p.nele - p.ele) END, 1)
  FROM lefts l JOIN pts p ON p.track_id = l.track_id AND p.seq = l.lseq)"""
_VECTORS = f"""{_SIMPLE},
means AS (SELECT track_id, count(*) AS n, avg(ele) AS mean FROM simple GROUP BY track_id),
centred AS (SELECT s.track_id, s.idx, s.ele - m.mean AS c, m.n FROM simple s JOIN means m USING (track_id)),
norms AS (SELECT track_id, n, sqrt(sum(c * c)) AS norm FROM centred GROUP BY track_id, n)"""
_CORR = "CASE WHEN a.n < 2 OR b.n < 2 OR a.norm = 0 OR b.norm = 0 THEN 0.0 ELSE x.product / (a.norm * b.norm) END"
_SCORE = f"""scored AS (SELECT c.*, r.target_distance_km, r.target_elevation_gain_m, r.num_results,
  {_round("""CAST(0.4 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - abs(c.distance_km - target_distance_km) / target_distance_km)
      + CAST(0.6 AS DOUBLE) * CASE WHEN target_elevation_gain_m > 0 THEN greatest(CAST(0 AS DOUBLE), 1 - abs(c.elevation_gain_m - target_elevation_gain_m) / target_elevation_gain_m)
              ELSE greatest(CAST(0 AS DOUBLE), 1 - c.elevation_gain_m / 100) END""", 3)} AS similarity_score
  FROM candidate_metrics c JOIN search_requests r USING (request_id) WHERE target_distance_km > 0)"""
_DENSE = lambda table, keys, metres: f"""segs AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, row_number() OVER w AS nth FROM {table} WINDOW w AS (PARTITION BY {keys} ORDER BY seq)),
lens AS (SELECT *, {_hav("plat", "plon", "lat", "lon")} AS km FROM segs),
laid AS (
  SELECT {keys}, seq, 0 AS j, lat, lon FROM lens WHERE nth = 1
  UNION ALL
  SELECT {keys}, seq, j, CASE WHEN j = n + 1 THEN lat ELSE plat + j / (n + 1) * (lat - plat) END, CASE WHEN j = n + 1 THEN lon ELSE plon + j / (n + 1) * (lon - plon) END
  FROM (SELECT *, unnest(range(1, n + 2)) AS j FROM (SELECT *, CAST(floor(km / ({metres} / 1000)) AS BIGINT) AS n FROM lens WHERE nth > 1 AND km > 0))),
dense AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY seq, j) - 1 AS seq, lat, lon FROM laid)"""  # noqa: E731
_SUMMARY_WORDS = """nullif(concat_ws('|',
  CASE WHEN off_km < 0.5 THEN 'Distance matches perfectly' WHEN off_km < 1 THEN 'Distance is close to target' END,
  CASE WHEN off_gain < 20 THEN 'Elevation gain matches well' WHEN off_gain < 50 THEN 'Similar elevation profile' END,
  CASE WHEN similarity_score >= 0.8 THEN 'Great overall match for training' END), '~')"""
_BAND = "CASE WHEN grade < 2 THEN 'flat' WHEN grade < 5 THEN 'rolling' WHEN grade < 8 THEN 'hilly' WHEN grade IS NOT NULL THEN 'challenging' END"
_ADVICE = """CASE WHEN similarity_score >= 0.75 THEN 'Highly recommended for your training goals'
  WHEN similarity_score >= 0.5 THEN 'Good alternative with some differences' ELSE 'Consider if other options unavailable' END"""
_JUDGED = f"""{_SCORE}, judged AS (SELECT *, elevation_gain_m / nullif(distance_km * 1000, 0) * 100 AS grade,
  abs(distance_km - target_distance_km) AS off_km, abs(elevation_gain_m - target_elevation_gain_m) AS off_gain FROM {{source}})"""
_US = "(coalesce(country IN ('United States', 'United States of America'), false) OR coalesce(countrycode = 'US', false))"
_DISPLAY = f"""shown AS (SELECT *, {_US} AS is_us, coalesce(nullif(concat_ws(', ',
  CASE WHEN name IS DISTINCT FROM city THEN nullif(name, '') END,
  CASE WHEN nullif(housenumber, '') IS NOT NULL AND nullif(street, '') IS NOT NULL THEN housenumber || ' ' || street ELSE nullif(street, '') END,
  nullif(city, ''), nullif(state, ''), CASE WHEN NOT {_US} THEN nullif(country, '') END), ''), nullif(name, ''), 'Unknown location') AS display FROM places)"""
_WALKS = "walks AS (SELECT w.request_id, w.route_no, w.seq, n.lat + 0.36 AS lat, n.lon - 0.06 AS lon FROM walk_nodes w JOIN street_nodes n USING (node_id))"
_RAISED = "raised AS (SELECT d.*, coalesce(g.ele, 0.0) AS ele FROM dense d LEFT JOIN elevation_grid g ON g.cell_y = floor(d.lat / 0.001) AND g.cell_x = floor(d.lon / 0.001))"
_ENRICHED = f"""{_WALKS}, {_DENSE("walks", "request_id, route_no", "100.0")}, {_RAISED},
stepped AS (SELECT *, coalesce({_hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")}, 0) AS km, lag(ele) OVER w AS pele FROM raised WINDOW w AS (PARTITION BY request_id, route_no ORDER BY seq)),
metrics AS (SELECT request_id, route_no, round(sum(km), 3) AS distance_km, {_CLIMB} FROM stepped GROUP BY request_id, route_no)"""

def _draw(number: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', '0', request_id, strategy, attempt, {number})), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE))"


def _between(low: float, high: float, number: int) -> str:
    return f"(CAST({low} AS DOUBLE) + CAST({high - low!r} AS DOUBLE) * {_draw(str(number))})"


def _ways(*strategies: str) -> str:
    """Common table expressions up to ways (request_id, route_no, strategy, seq, node_id) of all tries."""
    counts = {"directional": (0, 90, 180, 270), "out_and_back": (0, 120, 240), "random": (0,) * 20, "figure_eight": (0,)}
    tries = [(s, k, b) for s in strategies for k, b in enumerate(counts[s])]
    listed = ", ".join(f"({no}, '{s}', {k}, CAST({b} AS DOUBLE))" for no, (s, k, b) in enumerate(tries))
    out = f"metres * {_between(0.25, 0.4, 1)}"
    return f"""asked AS (SELECT request_id, lat AS c_lat, lon AS c_lon, target_distance_km * 1000 AS metres, greatest(target_distance_km * 1000 * 0.75, 1500.0) AS radius FROM loop_requests),
boxed AS (SELECT request_id, n.node_id, n.lat, n.lon FROM asked JOIN street_nodes n ON n.lat BETWEEN c_lat - radius / 111320.0 AND c_lat + radius / 111320.0
  AND n.lon BETWEEN c_lon - radius / (111320.0 * cos(radians(c_lat))) AND c_lon + radius / (111320.0 * cos(radians(c_lat)))),
own AS (SELECT * FROM boxed WHERE request_id IN (SELECT request_id FROM boxed GROUP BY request_id HAVING count(*) >= 10)),
own_edges AS (SELECT a.request_id, u, v, key, length FROM street_edges JOIN own a ON a.node_id = u JOIN own b ON b.node_id = v AND a.request_id = b.request_id),
light AS (SELECT request_id, u, v, min(length) AS length FROM own_edges GROUP BY ALL),
begun AS (SELECT request_id, arg_min(node_id, ({_hav("c_lat", "c_lon", "lat", "lon")}, node_id)) AS start FROM asked JOIN own USING (request_id) GROUP BY request_id),
tried AS (SELECT a.*, start, t.* FROM asked a JOIN begun USING (request_id), (VALUES {listed}) t(route_no, strategy, attempt, bearing)),
aims AS (
  SELECT request_id, route_no, c_lat, c_lon, 0 AS place, bearing + {_between(-22.5, 22.5, 2)} AS turn, {out} AS far FROM tried WHERE strategy = 'directional'
  UNION ALL
  SELECT request_id, route_no, c_lat, c_lon, 1, bearing + CASE WHEN {_draw("3")} < 0.5 THEN -1 ELSE 1 END * {_between(45, 90, 4)}, {out} * {_between(0.8, 1.2, 5)} FROM tried WHERE strategy = 'directional'
  UNION ALL
  SELECT request_id, route_no, c_lat, c_lon, 0, bearing, metres / 2 * {_between(0.9, 1.1, 1)} FROM tried WHERE strategy = 'out_and_back'
  UNION ALL
  SELECT request_id, route_no, c_lat, c_lon, k, bearing + k * 90, metres / 8 FROM tried, range(4) r(k) WHERE strategy = 'figure_eight'),
placed AS (SELECT *, c_lat + far * cos(radians(turn)) / 111320.0 AS to_lat, c_lon + far * sin(radians(turn)) / (111320.0 * cos(radians(c_lat))) AS to_lon FROM aims),
others AS (SELECT request_id, node_id, row_number() OVER (PARTITION BY request_id ORDER BY node_id) AS number, count(*) OVER (PARTITION BY request_id) AS others FROM own JOIN begun USING (request_id) WHERE node_id <> start),
drawn AS (SELECT request_id, route_no, 2 + CAST(floor(4 * {_draw("1")}) AS BIGINT) AS stops, k, CAST(floor({_draw("k")} * others) AS BIGINT) + 1 AS number
  FROM tried JOIN (SELECT DISTINCT request_id, others FROM others) USING (request_id), range(2, 18) r(k) WHERE strategy = 'random'),
firsts_drawn AS (SELECT request_id, route_no, stops, number, min(k) AS k FROM drawn GROUP BY ALL),
fresh AS (SELECT *, row_number() OVER (PARTITION BY request_id, route_no ORDER BY k) - 1 AS place, count(*) OVER (PARTITION BY request_id, route_no) AS kinds FROM firsts_drawn),
stops AS (
  SELECT request_id, route_no, place, arg_min(node_id, ({_hav("to_lat", "to_lon", "lat", "lon")}, node_id)) AS node_id FROM placed JOIN own USING (request_id) GROUP BY ALL
  UNION ALL
  SELECT request_id, route_no, place, node_id FROM fresh JOIN others USING (request_id, number) WHERE place < stops AND kinds >= stops),
listed AS (SELECT request_id, route_no, list(node_id ORDER BY place) AS s FROM stops GROUP BY ALL),
chained AS (SELECT request_id, route_no, strategy, CASE strategy WHEN 'out_and_back' THEN [start] || s WHEN 'figure_eight' THEN [start] || s[1:2] || [start] || s[3:4] || [start] ELSE [start] || s || [start] END AS c
  FROM tried JOIN listed USING (request_id, route_no) WHERE NOT (strategy IN ('directional', 'out_and_back') AND list_contains(s, start))),
legs AS (SELECT request_id, route_no, strategy, k AS leg, c[k] AS a, c[k + 1] AS b, len(c) - 1 AS legs FROM chained, range(1, 20) r(k) WHERE k < len(c)),
d(request_id, source, node_id, dist) USING KEY (request_id, source, node_id) AS (
  SELECT DISTINCT request_id, a, a, CAST(0 AS DOUBLE) FROM legs
  UNION
  SELECT * FROM (SELECT x.request_id, x.source, l.v AS node_id, min(x.dist + l.length) AS dist FROM d x JOIN light l ON l.request_id = x.request_id AND l.u = x.node_id GROUP BY ALL) n
  WHERE NOT EXISTS (SELECT 1 FROM recurring.d o WHERE o.request_id = n.request_id AND o.source = n.source AND o.node_id = n.node_id AND o.dist <= n.dist)),
before AS (SELECT x.request_id, x.source, x.node_id, arg_min(y.node_id, (y.dist, y.node_id)) AS prior
  FROM d x JOIN light l ON l.request_id = x.request_id AND l.v = x.node_id JOIN d y ON y.request_id = x.request_id AND y.source = x.source AND y.node_id = l.u AND y.dist + l.length = x.dist WHERE x.node_id <> x.source GROUP BY ALL),
back AS (
  SELECT request_id, route_no, leg, a, b AS at, [b] AS path FROM legs
  UNION ALL
  SELECT w.request_id, w.route_no, w.leg, w.a, p.prior, [p.prior] || w.path FROM back w JOIN before p ON p.request_id = w.request_id AND p.source = w.a AND p.node_id = w.at WHERE w.at <> w.a),
joined AS (SELECT request_id, route_no, strategy, flatten(list(CASE WHEN leg = 1 THEN path ELSE path[2:] END ORDER BY leg)) AS p FROM back JOIN legs USING (request_id, route_no, leg) WHERE back.at = back.a GROUP BY request_id, route_no, strategy, legs HAVING count(*) = legs),
whole AS (SELECT request_id, route_no, strategy, CASE WHEN strategy = 'out_and_back' THEN p || list_reverse(p)[2:] ELSE p END AS p FROM joined),
ways AS (SELECT request_id, CAST(route_no AS BIGINT) AS route_no, strategy, unnest(p) AS node_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS seq FROM whole)"""


_CANDIDATES = f"""{_ways("directional", "out_and_back", "random")},
firsts AS (SELECT request_id, u, v, arg_min(length, key) AS length FROM own_edges GROUP BY ALL),
steps AS (SELECT request_id, route_no, lag(node_id) OVER (PARTITION BY request_id, route_no ORDER BY seq) AS u, node_id AS v FROM ways),
measured AS (SELECT request_id, route_no, sum(coalesce(length, 0)) / 1000 AS street_km FROM steps LEFT JOIN firsts USING (request_id, u, v) GROUP BY ALL),
fitting AS (SELECT request_id, route_no, row_number() OVER (PARTITION BY request_id ORDER BY route_no) AS nth FROM measured JOIN loop_requests USING (request_id)
  WHERE street_km BETWEEN target_distance_km * CAST(0.7 AS DOUBLE) AND target_distance_km * CAST(1.3 AS DOUBLE)),
members AS (SELECT DISTINCT request_id, route_no, lat, lon FROM ways JOIN fitting USING (request_id, route_no) JOIN street_nodes USING (node_id) WHERE nth <= 15),
sizes AS (SELECT request_id, route_no, count(*) AS n FROM members GROUP BY ALL),
alike AS (SELECT a.request_id, b.route_no, a.route_no AS earlier FROM members a JOIN members b ON a.request_id = b.request_id AND a.lat = b.lat AND a.lon = b.lon AND a.route_no < b.route_no
  JOIN sizes x ON x.request_id = a.request_id AND x.route_no = a.route_no JOIN sizes y ON y.request_id = b.request_id AND y.route_no = b.route_no GROUP BY ALL HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) > 0.8),
numbered AS (SELECT request_id, route_no, row_number() OVER (PARTITION BY request_id ORDER BY route_no) AS k, coalesce((SELECT list(earlier) FROM alike a WHERE a.request_id = s.request_id AND a.route_no = s.route_no), []) AS earlier FROM sizes s),
fold AS (
  SELECT request_id, k, [route_no] AS kept FROM numbered WHERE k = 1
  UNION ALL
  SELECT o.request_id, o.k, CASE WHEN list_has_any(f.kept, o.earlier) THEN f.kept ELSE list_append(f.kept, o.route_no) END FROM fold f JOIN numbered o ON o.request_id = f.request_id AND o.k = f.k + 1),
finals AS (SELECT request_id, unnest(kept) AS route_no, CAST(generate_subscripts(kept, 1) - 1 AS BIGINT) AS candidate_no FROM (SELECT request_id, arg_max(kept, k) AS kept FROM fold GROUP BY request_id)),
candidates AS (SELECT request_id, candidate_no, strategy, seq, node_id, lat, lon FROM ways JOIN finals USING (request_id, route_no) JOIN street_nodes USING (node_id)),
without AS (SELECT r.request_id, CASE WHEN n = 0 THEN 'No road network data available' WHEN n < 10 THEN 'Not enough road network data in this area' ELSE 'Could not generate any valid routes in this area' END AS reason
  FROM (SELECT request_id, (SELECT count(*) FROM boxed b WHERE b.request_id = q.request_id) AS n FROM loop_requests q) r WHERE request_id NOT IN (SELECT request_id FROM finals))"""
_STREETS = ("loop_requests", "street_nodes", "street_edges")
_FOUND = f"""{_CANDIDATES}, walks AS (SELECT request_id, candidate_no AS route_no, seq, lat, lon FROM candidates WHERE request_id % 9 <> 8), {_DENSE("walks", "request_id, route_no", "100.0")},
raised AS (SELECT d.*, coalesce(g.ele, 0.0) AS ele FROM dense d LEFT JOIN street_elevation g ON g.cell_y = floor(d.lat / 0.001) AND g.cell_x = floor(d.lon / 0.001)),
stepped AS (SELECT *, coalesce({_hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")}, 0) AS km, lag(ele) OVER w AS pele FROM raised WINDOW w AS (PARTITION BY request_id, route_no ORDER BY seq)),
metrics AS (SELECT request_id, route_no AS candidate_no, round(sum(km), 3) AS distance_km, {_CLIMB} FROM stepped GROUP BY request_id, route_no),
scored AS (SELECT m.*, {_round("""CAST(0.4 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - abs(m.distance_km - target_distance_km) / target_distance_km)
      + CAST(0.6 AS DOUBLE) * CASE WHEN target_elevation_gain_m > 0 THEN greatest(CAST(0 AS DOUBLE), 1 - abs(m.elevation_gain_m - target_elevation_gain_m) / target_elevation_gain_m)
              ELSE greatest(CAST(0 AS DOUBLE), 1 - m.elevation_gain_m / 100) END""", 3)} AS similarity_score FROM metrics m JOIN loop_requests USING (request_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity_score DESC, candidate_no) AS rank FROM scored),
lost AS (SELECT request_id, CASE WHEN request_id % 9 = 8 THEN 'Location not found:  block ' || (request_id + 100000000) END AS reason FROM loop_requests WHERE request_id % 9 = 8
  UNION ALL SELECT request_id, reason FROM without WHERE request_id % 9 <> 8)"""

_SETTLED = """light AS (SELECT u, v, min(length) AS length FROM street_edges GROUP BY u, v),
        src AS (SELECT block AS request_id, min(node_id) AS source FROM street_nodes GROUP BY block),
        d(request_id, source, node_id, dist) USING KEY (request_id, node_id) AS (
          SELECT request_id, source, source, CAST(0 AS DOUBLE) FROM src
          UNION
          SELECT * FROM (SELECT x.request_id, x.source, l.v AS node_id, min(x.dist + l.length) AS dist FROM d x JOIN light l ON l.u = x.node_id GROUP BY ALL) n
          WHERE NOT EXISTS (SELECT 1 FROM recurring.d o WHERE o.request_id = n.request_id AND o.node_id = n.node_id AND o.dist <= n.dist))"""

ORACLES: dict[str, str] = {
    "p1_haversine": with_fixtures(f"SELECT track_id, seq, round({_hav('42.36', '(-71.06)', 'lat', 'lon')}, 6) AS km FROM track_points", "track_points"),
    "p2_destination": with_fixtures(
        "SELECT track_id, seq, round(lat + seq * 100 * cos(radians(seq * 30)) / 111320.0, 9) AS dest_lat, round(lon + seq * 100 * sin(radians(seq * 30)) / (111320.0 * cos(radians(lat))), 9) AS dest_lon FROM track_points",
        "track_points",
    ),
    "p3_search_bounds": with_fixtures(
        "SELECT request_id, round(greatest(target_distance_km * 1000 * 0.75, 1500.0), 6) AS radius_m, round(target_distance_km * CAST(0.7 AS DOUBLE), 6) AS min_km, round(target_distance_km * CAST(1.3 AS DOUBLE), 6) AS max_km FROM search_requests",
        "search_requests",
    ),
    "p4_validate_requests": with_fixtures(
        """SELECT request_id, location, coalesce(num_results, 5) AS num_results,
        CASE WHEN trim(coalesce(location, '')) = '' THEN 'location is blank' WHEN NOT coalesce(target_distance_km > 0, false) THEN 'distance must be positive'
             WHEN NOT coalesce(target_elevation_gain_m >= 0, false) THEN 'gain must not be negative' WHEN coalesce(num_results, 5) NOT BETWEEN 1 AND 20 THEN 'num_results must be from 1 to 20' END AS reason
        FROM search_requests""",
        "search_requests",
    ),
    "p5_resolve_targets": with_fixtures(
        f"""WITH {_SUMMARY}, asked AS (SELECT *, request_id % 6 AS n FROM search_requests)
        SELECT request_id, CASE WHEN n = 0 THEN s.distance_km ELSE target_distance_km END AS distance_km,
          round(CASE WHEN n = 0 THEN s.elevation_gain_m WHEN n = 2 THEN 0.0 WHEN n = 3 THEN CAST(2.5 AS DOUBLE) / 100 * (target_distance_km * 1000) ELSE target_elevation_gain_m END, 6) AS gain_m
        FROM asked LEFT JOIN summary s ON s.track_id = request_id % 200""",
        "search_requests",
        "track_points",
    ),
    "p6_p7_grades": with_fixtures(f"WITH g AS (SELECT *, elevation_gain_m / nullif(distance_km * 1000, 0) * 100 AS grade FROM candidate_metrics) SELECT request_id, candidate_no, grade AS avg_grade, {_BAND} AS band FROM g", "candidate_metrics"),
    "p8_summaries": with_fixtures(
        f"""WITH {_JUDGED.format(source="scored")}
        SELECT request_id, candidate_no, {_BAND} AS grade_desc, printf('%.1f', {_round("grade", 1)}) AS avg_grade, {_SUMMARY_WORDS} AS pros,
          concat_ws('|', CASE WHEN off_km >= 1 THEN 'Distance is ' || CASE WHEN distance_km > target_distance_km THEN 'longer' ELSE 'shorter' END || ' than target' END,
            CASE WHEN off_gain >= 50 THEN CASE WHEN elevation_gain_m > target_elevation_gain_m THEN 'More' ELSE 'Less' END || ' elevation than target' END) AS cons,
          {_ADVICE} AS recommendation FROM judged""",
        "candidate_metrics",
        "search_requests",
    ),
    "p9_fallback": with_fixtures(
        f"""WITH {_JUDGED.format(source="(SELECT * REPLACE (CASE WHEN candidate_no % 3 = 0 THEN 0.0 WHEN candidate_no % 3 = 1 THEN distance_km END AS distance_km) FROM scored)")}
        SELECT request_id, candidate_no, coalesce({_BAND}, 'unknown') AS grade_desc,
          CASE WHEN grade IS NULL THEN 0 ELSE CAST(off_km < 1 AS BIGINT) + CAST(off_gain < 50 AS BIGINT) + CAST(similarity_score >= 0.8 AS BIGINT) END AS n_pros,
          CASE WHEN grade IS NULL THEN 0 ELSE CAST(off_km >= 1 AS BIGINT) + CAST(off_gain >= 50 AS BIGINT) END AS n_cons,
          CASE WHEN grade IS NULL THEN 'Route data available' ELSE {_ADVICE} END AS recommendation FROM judged""",
        "candidate_metrics",
        "search_requests",
    ),
    "p10_compare": with_fixtures(
        f"""WITH {_SCORE}, lines AS (
          SELECT request_id, candidate_no, 'Distance' AS label, 'km' AS unit, target_distance_km AS target, distance_km AS actual FROM scored
          UNION ALL SELECT request_id, candidate_no, 'Elevation Gain', 'm', target_elevation_gain_m, elevation_gain_m FROM scored
          UNION ALL SELECT request_id, candidate_no, 'Avg Grade', '%', target_elevation_gain_m / nullif(target_distance_km * 1000, 0) * 100, elevation_gain_m / nullif(distance_km * 1000, 0) * 100 FROM scored),
        d AS (SELECT *, actual - target AS diff, CASE WHEN target > 0 THEN (actual - target) / target * 100 ELSE 0.0 END AS diff_pct FROM lines)
        SELECT request_id, candidate_no, label, unit, target, actual, diff, diff_pct,
          CASE WHEN abs(diff_pct) < 10 THEN 'close' WHEN diff > 0 THEN 'over' ELSE 'under' END AS flag,
          least(target / nullif(greatest(target, actual), 0) * 100, 100.0) AS target_bar, least(actual / nullif(greatest(target, actual), 0) * 100, 100.0) AS actual_bar FROM d""",
        "candidate_metrics",
        "search_requests",
    ),
    "p11_chart_series": with_fixtures(f"WITH {_PROFILE} SELECT track_id, seq, {_round('km', 2)} AS distance, CAST(floor(ele + 0.5) AS BIGINT) AS elevation FROM profile", "track_points"),
    "p12_place_display": with_fixtures(f"WITH {_DISPLAY} SELECT place_id, is_us, display FROM shown", "places"),
    "s1_s4_gpx_points": with_fixtures("SELECT track_id, seq, round(lat, 9) AS lat, round(lon, 9) AS lon, ele FROM track_points", "track_points"),
    "s2_s3_gpx_rejects": with_fixtures(
        """SELECT DISTINCT track_id || CASE WHEN track_id % 5 = 3 THEN '.txt' ELSE '.gpx' END AS track_id,
        CASE track_id % 5 WHEN 1 THEN 'Failed to parse' WHEN 2 THEN 'GPX file contains no points with elevation data' ELSE 'File must be a GPX file' END AS reason
        FROM track_points WHERE track_id % 5 IN (1, 2, 3)""",
        "track_points",
    ),
    "w1_cumulative_distance": with_fixtures(f"WITH {_KEPT} SELECT track_id, seq, round(cum_km, 3) AS cum_km FROM walked", "track_points"),
    "w1_chunked": with_fixtures(f"WITH {_KEPT} SELECT track_id, seq, round(cum_km, 3) AS cum_km FROM walked", "track_points"),
    "w_broken_points": with_fixtures(
        f"""WITH p AS (SELECT track_id, seq, CASE WHEN NOT isnan(lat) THEN lat END AS lat, lon, CASE WHEN NOT isnan(ele) THEN ele END AS ele FROM broken_points),
        all_ AS (SELECT track_id, round(sum(coalesce({_hav('plat', 'plon', 'lat', 'lon')}, 0)), 6) AS distance_km
          FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM p WINDOW w AS (PARTITION BY track_id ORDER BY seq)) GROUP BY track_id),
        kept AS (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ele) OVER w AS pele FROM p WHERE ele IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY seq)),
        walked AS (SELECT track_id, round(sum(coalesce({_hav('plat', 'plon', 'lat', 'lon')}, 0)), 3) AS cum_km, {_CLIMB} FROM kept GROUP BY track_id),
        placed AS (SELECT * FROM p WHERE lat IS NOT NULL AND lon IS NOT NULL), {_DENSE('placed', 'track_id', '50.0')},
        counted AS (SELECT track_id, count(*) AS dense, max(seq) AS last_seq FROM dense GROUP BY track_id)
        SELECT a.track_id, distance_km, elevation_gain_m, cum_km, c.dense, last_seq FROM all_ a
        LEFT JOIN walked w ON w.track_id IS NOT DISTINCT FROM a.track_id LEFT JOIN counted c ON c.track_id IS NOT DISTINCT FROM a.track_id""",
        "broken_points",
    ),
    "w_chunked": with_fixtures(
        f"WITH {_SIMPLE}, summary AS (SELECT track_id, round(max(cum_km), 3) AS distance_km, {_CLIMB} FROM walked GROUP BY track_id) SELECT track_id, idx, km, ele, distance_km, elevation_gain_m, elevation_loss_m FROM simple JOIN summary USING (track_id)",
        "track_points",
    ),
    "w5_cut_segments": with_fixtures(
        f"""WITH s AS (SELECT track_id, seq, floor({_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} / (50.0 / 1000)) AS wanted FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY seq))
        SELECT track_id, seq, CAST(wanted AS BIGINT) AS wanted, CAST(10 AS BIGINT) AS kept FROM s WHERE wanted > 10""",
        "track_points",
    ),
    "w2_route_distance": with_fixtures(
        f"WITH s AS (SELECT track_id, {_hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS km FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY seq)) SELECT track_id, round(sum(coalesce(km, 0)), 6) AS distance_km FROM s GROUP BY track_id",
        "track_points",
    ),
    "w3_elevation_metrics": with_fixtures(
        f"WITH {_KEPT}, m AS (SELECT track_id, {_CLIMB} FROM kept GROUP BY track_id) SELECT t.track_id, coalesce(elevation_gain_m, 0) AS elevation_gain_m, coalesce(elevation_loss_m, 0) AS elevation_loss_m, coalesce(min_elevation_m, 0) AS min_elevation_m, coalesce(max_elevation_m, 0) AS max_elevation_m FROM (SELECT DISTINCT track_id FROM track_points) t LEFT JOIN m USING (track_id)",
        "track_points",
    ),
    "w4_profile_summary": with_fixtures(f"WITH {_SUMMARY} SELECT * FROM summary", "track_points"),
    "s6_stream_gpx": with_fixtures(f"WITH {_SUMMARY} SELECT * FROM summary", "track_points"),
    "w4_profile_points": with_fixtures(f"WITH {_PROFILE} SELECT * FROM profile", "track_points"),
    "w5_interpolate": with_fixtures(f"WITH {_DENSE('track_points', 'track_id', '50.0')} SELECT track_id, seq, lat, lon FROM dense", "track_points"),
    "w6_build_profile": with_fixtures(
        f"""WITH s AS (SELECT track_id, seq, coalesce({_hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")}, 0) AS km, round(coalesce(ele, 0), 1) AS ele FROM track_points WINDOW w AS (PARTITION BY track_id ORDER BY seq))
        SELECT track_id, seq, round(sum(km) OVER (PARTITION BY track_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 3) AS km, ele FROM s""",
        "track_points",
    ),
    "w7_simplify_profile": with_fixtures(f"WITH {_SIMPLE} SELECT track_id, idx, km, ele FROM simple", "track_points"),
    "w8_correlation": with_fixtures(
        f"""WITH {_VECTORS}, x AS (SELECT a.track_id AS id_a, b.track_id AS id_b, sum(a.c * b.c) AS product FROM centred a JOIN centred b ON b.track_id - a.track_id IN (1, 2) AND a.idx = b.idx GROUP BY ALL)
        SELECT id_a, id_b, round({_CORR}, 6) AS correlation FROM x JOIN norms a ON a.track_id = id_a JOIN norms b ON b.track_id = id_b""",
        "track_points",
    ),
    "w9_profile_knn": with_fixtures(
        f"""WITH {_VECTORS}, sums AS (SELECT track_id, floor(round(max(cum_km), 3) / 2.0) AS kb, floor(round(coalesce(sum(CASE WHEN ele - pele > 0 THEN ele - pele ELSE 0 END), 0), 1) / 200.0) AS gb FROM walked GROUP BY track_id),
        p AS (SELECT a.track_id AS id_a, b.track_id AS id_b FROM sums a JOIN sums b ON abs(a.kb - b.kb) <= 1 AND abs(a.gb - b.gb) <= 1 AND a.track_id <> b.track_id),
        x AS (SELECT id_a, id_b, sum(a.c * b.c) AS product FROM p JOIN centred a ON a.track_id = id_a JOIN centred b ON b.track_id = id_b AND a.idx = b.idx GROUP BY ALL),
        c AS (SELECT id_a, id_b, {_CORR} AS correlation FROM x JOIN norms a ON a.track_id = id_a JOIN norms b ON b.track_id = id_b),
        r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY round(correlation, 9) DESC, id_b) AS rank FROM c)
        SELECT id_a, id_b, round(correlation, 6) AS correlation, rank FROM r WHERE rank <= 3""",
        "track_points",
    ),
    "w10_route_bounds": with_fixtures("SELECT track_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM track_points GROUP BY track_id", "track_points"),
    "w11_chart_axis": with_fixtures(
        f"""WITH {_PROFILE}, e AS (SELECT track_id, min(floor(ele + 0.5)) AS low, max(floor(ele + 0.5)) AS high FROM profile GROUP BY track_id)
        SELECT track_id, CAST(floor((low - greatest((high - low) * CAST(0.1 AS DOUBLE), 5)) / 10) * 10 AS BIGINT) AS y_min, CAST(ceil((high + greatest((high - low) * CAST(0.1 AS DOUBLE), 5)) / 10) * 10 AS BIGINT) AS y_max FROM e""",
        "track_points",
    ),
    "j1_lookup_elevation": with_fixtures(
        "SELECT track_id, seq, coalesce(g.ele, 0.0) AS ele FROM track_points p LEFT JOIN elevation_grid g ON g.cell_y = floor(p.lat / CAST(0.001 AS DOUBLE)) AND g.cell_x = floor(p.lon / CAST(0.001 AS DOUBLE))", "track_points", "elevation_grid"
    ),
    "j2_check_lookup": with_fixtures(
        """WITH doubled AS (SELECT * FROM elevation_grid UNION ALL SELECT * FROM elevation_grid WHERE cell_y % 5 = 0 AND cell_x % 5 = 0),
        e AS (SELECT track_id, count(*) AS expected FROM track_points GROUP BY track_id),
        g AS (SELECT track_id, count(*) AS got FROM track_points p LEFT JOIN doubled g ON g.cell_y = floor(p.lat / CAST(0.001 AS DOUBLE)) AND g.cell_x = floor(p.lon / CAST(0.001 AS DOUBLE)) GROUP BY track_id)
        SELECT track_id, expected, got FROM e JOIN g USING (track_id) WHERE expected <> got""",
        "track_points",
        "elevation_grid",
    ),
    "j3_geocode": with_fixtures(
        """WITH ranked AS (SELECT *, lower(trim(name)) AS key, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY importance DESC, place_id) AS r FROM places)
        SELECT request_id, p.place_id, p.lat, p.lon, CASE WHEN p.place_id IS NULL THEN 'Location not found: ' || coalesce(location, '') END AS reason
        FROM search_requests q LEFT JOIN ranked p ON p.key = lower(trim(q.location)) AND p.r = 1""",
        "search_requests",
        "places",
    ),
    "j4_reverse_geocode": with_fixtures(
        f"""WITH near AS (SELECT n.node_id AS point_id, arg_min(p.place_id, (round({_hav("n.lat", "n.lon", "p.lat", "p.lon")}, 12), p.place_id)) AS place_id, any_value(n.lat) AS lat, any_value(n.lon) AS lon FROM (SELECT node_id, lat, -71 + (node_id % 10) * CAST(0.001 AS DOUBLE) AS lon FROM street_nodes) n, places p GROUP BY n.node_id)
        SELECT point_id, coalesce(p.display_name, printf('%.4f, %.4f', near.lat, near.lon)) AS display_name FROM near JOIN places p USING (place_id)""",
        "street_nodes",
        "places",
    ),
    "j5_nearest_node": with_fixtures(
        f"""WITH points AS (SELECT node_id AS point_id, lat + (node_id % 13) * CAST(0.0021 AS DOUBLE) AS lat, lon - (node_id % 7) * CAST(0.0093 AS DOUBLE) AS lon FROM street_nodes)
        SELECT point_id, round(min({_hav("p.lat", "p.lon", "n.lat", "n.lon")}), 6) AS distance_km FROM points p, street_nodes n GROUP BY point_id""",
        "street_nodes",
    ),
    "j6_node_at_bearing": with_fixtures(
        f"""WITH aims AS (SELECT node_id AS point_id, lat + (node_id % 5) * 170 * cos(radians((node_id % 12) * 30 + 7)) / 111320.0 AS lat, lon + (node_id % 5) * 170 * sin(radians((node_id % 12) * 30 + 7)) / (111320.0 * cos(radians(lat))) AS lon FROM street_nodes),
        near AS (SELECT a.point_id, arg_min(n.node_id, ({_hav("a.lat", "a.lon", "n.lat", "n.lon")}, n.node_id)) AS node_id FROM aims a, street_nodes n GROUP BY a.point_id)
        SELECT point_id, node_id FROM near WHERE node_id <> point_id""",
        "street_nodes",
    ),
    "j7_subgraph": with_fixtures(
        """WITH box AS (SELECT *, target_distance_km * 300 AS radius FROM loop_requests),
        own AS (SELECT request_id, n.node_id FROM box b JOIN street_nodes n ON n.lat BETWEEN b.lat - radius / 111320.0 AND b.lat + radius / 111320.0
          AND n.lon BETWEEN b.lon - radius / (111320.0 * cos(radians(b.lat))) AND b.lon + radius / (111320.0 * cos(radians(b.lat)))),
        n AS (SELECT b.request_id, count(o.node_id) AS nodes, sum(o.node_id) AS node_sum FROM box b LEFT JOIN own o USING (request_id) GROUP BY b.request_id),
        e AS (SELECT a.request_id, count(*) AS edges, sum(length) AS metres FROM street_edges JOIN own a ON a.node_id = u JOIN own b ON b.node_id = v AND a.request_id = b.request_id GROUP BY a.request_id)
        SELECT request_id, CASE WHEN nodes >= 10 THEN nodes END AS nodes, CASE WHEN nodes >= 10 THEN CAST(node_sum AS BIGINT) END AS node_sum, CASE WHEN nodes >= 10 THEN edges END AS edges, CASE WHEN nodes >= 10 THEN metres END AS metres,
          CASE WHEN nodes = 0 THEN 'No road network data available' WHEN nodes < 10 THEN 'Not enough road network data in this area' END AS reason FROM n LEFT JOIN e USING (request_id)""",
        "loop_requests",
        "street_nodes",
        "street_edges",
    ),
    "j7_wide_boxes": with_fixtures(
        """WITH half AS (SELECT *, radius_m / 111320.0 AS h, radius_m / (111320.0 * cos(radians(lat))) AS wide FROM wide_requests),
        box AS (SELECT *, wide >= 180 OR wide < 0 OR lat - h <= -90 OR lat + h >= 90 AS ring FROM half),
        own AS (SELECT request_id, n.node_id FROM box b JOIN world_nodes n ON n.lat BETWEEN b.lat - h AND b.lat + h
          AND (ring OR n.lon BETWEEN b.lon - wide AND b.lon + wide OR n.lon + 360 BETWEEN b.lon - wide AND b.lon + wide OR n.lon - 360 BETWEEN b.lon - wide AND b.lon + wide)),
        n AS (SELECT b.request_id, count(o.node_id) AS nodes, sum(o.node_id) AS node_sum FROM box b LEFT JOIN own o USING (request_id) GROUP BY b.request_id),
        e AS (SELECT a.request_id, count(*) AS edges, sum(length) AS metres FROM town_edges JOIN own a ON a.node_id = u JOIN own b ON b.node_id = v AND a.request_id = b.request_id GROUP BY a.request_id)
        SELECT request_id, CASE WHEN nodes >= 10 THEN nodes END AS nodes, CASE WHEN nodes >= 10 THEN CAST(node_sum AS BIGINT) END AS node_sum, CASE WHEN nodes >= 10 THEN edges END AS edges, CASE WHEN nodes >= 10 THEN metres END AS metres,
          CASE WHEN nodes = 0 THEN 'No road network data available' WHEN nodes < 10 THEN 'Not enough road network data in this area' END AS reason FROM n LEFT JOIN e USING (request_id)""",
        "wide_requests",
        "world_nodes",
        "town_edges",
    ),
    "j8_place_suggest": with_fixtures(
        f"""WITH {_DISPLAY}, q AS (SELECT query_id, lower(trim(query)) AS q FROM place_queries WHERE length(query) >= 2 AND length(trim(query)) > 0),
        hits AS (SELECT q.query_id, s.*, row_number() OVER (PARTITION BY q.query_id ORDER BY importance DESC, place_id) AS hit FROM q JOIN shown s ON starts_with(lower(trim(s.name)), q.q)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_us DESC, hit) AS rank FROM hits WHERE hit <= 7)
        SELECT query_id, rank, place_id, display, coalesce(nullif(city, ''), name) AS city, state, country, countrycode AS country_code, lat, lon, is_us, coalesce(nullif(osm_value, ''), nullif(type, '')) AS type FROM r WHERE rank <= 5""",
        "place_queries",
        "places",
    ),
    "g1_shortest_paths": with_fixtures(f"WITH {_SETTLED} SELECT * FROM d", "street_nodes", "street_edges", recursive=True),
    "g1_town_ways": with_fixtures(
        """WITH light AS (SELECT u, v, min(length) AS length FROM town_edges GROUP BY u, v),
        d(request_id, source, node_id, dist) USING KEY (request_id, node_id) AS (
          SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS DOUBLE)
          UNION
          SELECT * FROM (SELECT x.request_id, x.source, l.v AS node_id, min(x.dist + l.length) AS dist FROM d x JOIN light l ON l.u = x.node_id GROUP BY ALL) n
          WHERE NOT EXISTS (SELECT 1 FROM recurring.d o WHERE o.request_id = n.request_id AND o.node_id = n.node_id AND o.dist <= n.dist)),
        tree AS (SELECT t.node_id, arg_min(l.u, (s.dist, l.u)) AS before FROM d t JOIN light l ON l.v = t.node_id JOIN d s ON s.node_id = l.u AND s.dist + l.length = t.dist GROUP BY ALL),
        back AS (SELECT node_id AS target, CAST(0 AS BIGINT) AS k, node_id FROM d UNION ALL SELECT b.target, b.k + 1, t.before FROM back b JOIN tree t ON t.node_id = b.node_id),
        placed AS (SELECT target, max(k) OVER (PARTITION BY target) - k AS seq, node_id FROM back)
        SELECT request_id, target, dist, nodes, way_sum FROM (SELECT target, count(*) AS nodes, CAST(sum(seq * node_id) AS BIGINT) AS way_sum FROM placed GROUP BY target) JOIN d ON d.node_id = target""",
        "town_edges",
        recursive=True,
    ),
    "g1_ways": with_fixtures(
        f"""WITH {_SETTLED},
        tree AS (SELECT t.request_id, t.source, t.node_id, arg_min(l.u, (s.dist, l.u)) AS before FROM d t JOIN light l ON l.v = t.node_id
          JOIN d s ON s.request_id = t.request_id AND s.node_id = l.u AND s.dist + l.length = t.dist GROUP BY ALL),
        back AS (
          SELECT request_id, source, node_id AS target, CAST(0 AS BIGINT) AS k, node_id FROM d
          UNION ALL
          SELECT b.request_id, b.source, b.target, b.k + 1, t.before FROM back b JOIN tree t ON t.request_id = b.request_id AND t.node_id = b.node_id)
        SELECT request_id, source, target, max(k) OVER (PARTITION BY request_id, source, target) - k AS seq, node_id FROM back""",
        "street_nodes",
        "street_edges",
        recursive=True,
    ),
    **{
        name: with_fixtures(f"WITH {_ways(strategy)} SELECT * FROM ways", *_STREETS, recursive=True)
        for name, strategy in (("g2_directional_loops", "directional"), ("g3_out_and_back", "out_and_back"), ("g4_random_loops", "random"), ("g5_figure_eight", "figure_eight"))
    },
    "g8_candidate_routes": with_fixtures(
        f"""WITH {_CANDIDATES} SELECT request_id, candidate_no, strategy, seq, node_id, lat, lon, NULL AS reason FROM candidates
        UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM without""",
        *_STREETS,
        recursive=True,
    ),
    "g8_town_routes": with_fixtures(
        f"""WITH {_CANDIDATES} SELECT request_id, candidate_no, strategy, seq, node_id, lat, lon, NULL AS reason FROM candidates
        UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM without""",
        *_STREETS,
        recursive=True,
        instead={"loop_requests": "town_requests", "street_nodes": "town_nodes", "street_edges": "town_edges"},
    ),
    "find_routes": with_fixtures(
        f"""WITH {_FOUND} SELECT request_id, rank, 'Route ' || rank AS name, candidate_no, distance_km, elevation_gain_m, elevation_loss_m, min_elevation_m, max_elevation_m, similarity_score, NULL AS reason FROM ranked WHERE rank <= 5
        UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM lost""",
        *_STREETS,
        "street_elevation",
        recursive=True,
    ),
    "g6_validate_routes": with_fixtures(
        """WITH firsts AS (SELECT u, v, arg_min(length, key) AS length FROM street_edges GROUP BY u, v),
        walks AS (SELECT w.* FROM walk_nodes w SEMI JOIN street_nodes n ON n.node_id = w.node_id),
        steps AS (SELECT request_id, route_no, lag(node_id) OVER (PARTITION BY request_id, route_no ORDER BY seq) AS u, node_id AS v FROM walks),
        lens AS (SELECT request_id, route_no, sum(coalesce(length, 0)) / 1000 AS street_km FROM steps s LEFT JOIN firsts f ON f.u = s.u AND f.v = s.v GROUP BY ALL)
        SELECT request_id, route_no, seq, node_id, round(lat, 9) AS lat, round(lon, 9) AS lon, round(street_km, 6) AS street_km
        FROM walks JOIN lens USING (request_id, route_no) JOIN street_nodes USING (node_id) WHERE street_km BETWEEN CAST(1.75 AS DOUBLE) AND CAST(1.9 AS DOUBLE)""",
        "walk_nodes",
        "street_nodes",
        "street_edges",
    ),
    "g7_dedupe_routes": with_fixtures(
        """WITH sizes AS (SELECT request_id, route_no, count(*) AS n FROM route_members GROUP BY ALL),
        both_ AS (SELECT a.request_id, a.route_no AS a, b.route_no AS b, count(*) AS i FROM route_members a JOIN route_members b ON a.request_id = b.request_id AND a.lat = b.lat AND a.lon = b.lon AND a.route_no < b.route_no GROUP BY ALL),
        alike AS (SELECT p.request_id, p.b AS route_no, list(p.a) AS earlier FROM both_ p JOIN sizes x ON x.request_id = p.request_id AND x.route_no = p.a JOIN sizes y ON y.request_id = p.request_id AND y.route_no = p.b
          WHERE i / (x.n + y.n - i) > 0.8 GROUP BY ALL),
        ordered AS (SELECT s.request_id, s.route_no, coalesce(earlier, []) AS earlier, row_number() OVER (PARTITION BY s.request_id ORDER BY s.route_no) AS k FROM sizes s LEFT JOIN alike USING (request_id, route_no)),
        fold AS (
          SELECT request_id, k, [route_no] AS kept FROM ordered WHERE k = 1
          UNION ALL
          SELECT o.request_id, o.k, CASE WHEN list_has_any(f.kept, o.earlier) THEN f.kept ELSE list_append(f.kept, o.route_no) END FROM fold f JOIN ordered o ON o.request_id = f.request_id AND o.k = f.k + 1)
        SELECT request_id, unnest(arg_max(kept, k)) AS route_no FROM fold GROUP BY request_id""",
        "route_members",
        recursive=True,
    ),
    "r1_enrich_routes": with_fixtures(f"WITH {_ENRICHED} SELECT * FROM metrics", "walk_nodes", "street_nodes", "elevation_grid"),
    "r1_doubled_cells": with_fixtures(
        f"""WITH {_ENRICHED}, bad AS (SELECT DISTINCT request_id, route_no FROM dense d JOIN elevation_grid g ON g.cell_y = floor(d.lat / 0.001) AND g.cell_x = floor(d.lon / 0.001) WHERE cell_y % 5 = 0 AND cell_x % 4 = 0)
        SELECT m.request_id, m.route_no, CASE WHEN b.request_id IS NULL THEN distance_km END AS distance_km, CASE WHEN b.request_id IS NULL THEN elevation_gain_m END AS elevation_gain_m,
          CASE WHEN b.request_id IS NOT NULL THEN 'Elevation service returned a wrong number of results' END AS reason
        FROM metrics m LEFT JOIN bad b ON b.request_id = m.request_id AND b.route_no = m.route_no""",
        "walk_nodes",
        "street_nodes",
        "elevation_grid",
    ),
    "r2_scores": with_fixtures(f"WITH {_SCORE} SELECT request_id, candidate_no, similarity_score FROM scored", "candidate_metrics", "search_requests"),
    "r3_r4_ranked": with_fixtures(
        f"""WITH {_SCORE}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity_score DESC, candidate_no) AS rank FROM scored)
        SELECT request_id, candidate_no, similarity_score, rank, 'Route ' || rank AS name FROM r WHERE rank <= least(coalesce(num_results, 5), 20)""",
        "candidate_metrics",
        "search_requests",
    ),
    "s5_result_rows": with_fixtures(
        f"""WITH {_ENRICHED}, s AS (SELECT *, {_round('CAST(0.4 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - abs(distance_km - 1.5) / CAST(1.5 AS DOUBLE)) + CAST(0.6 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - abs(elevation_gain_m - 50) / CAST(50 AS DOUBLE))', 3)} AS score FROM metrics),
        r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, route_no) AS rank FROM s),
        c AS (SELECT request_id, route_no, count(*) AS points, {_round('round(sum(km), 3)', 2)} AS last_km FROM stepped GROUP BY request_id, route_no)
        SELECT request_id, route_no, rank, 'Route ' || rank AS name, points, points AS profile_points, last_km FROM r JOIN c USING (request_id, route_no) WHERE rank <= 3""",
        "walk_nodes",
        "street_nodes",
        "elevation_grid",
    ),
}
