"""Track, street, place and request tables derived from the given tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "track_points": ["events"],
    "broken_points": ["events"],
    "elevation_grid": ["part"],
    "street_elevation": ["customer"],
    "street_nodes": ["customer"],
    "street_edges": ["customer"],
    "walk_nodes": ["customer"],
    "route_members": ["lineitem"],
    "search_requests": ["orders"],
    "candidate_metrics": ["lineitem"],
    "places": ["supplier", "nation", "region"],
    "loop_requests": ["customer"],
    "town_nodes": ["customer"],
    "town_edges": ["customer"],
    "town_requests": ["customer"],
    "world_nodes": ["customer"],
    "wide_requests": ["customer"],
    "place_queries": ["supplier"],
}

SQL = {
    "track_points": """
SELECT user_id AS track_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
       CAST(42.36 AS DOUBLE) + ((event_id * 37) % 1000) / CAST(100000 AS DOUBLE) AS lat,
       CAST(-71.06 AS DOUBLE) + ((event_id * 91) % 1000) / CAST(100000 AS DOUBLE) AS lon,
       CASE WHEN event_type <> 'error' THEN floor(value * 8) / CAST(8 AS DOUBLE) END AS ele
FROM events""",
    # a track without a key, and points without a place or with NaN
    "broken_points": """
SELECT CASE WHEN user_id <> 3 THEN user_id END AS track_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS seq,
       CASE WHEN event_id % 13 = 7 THEN NULL WHEN event_id % 11 = 5 THEN CAST('NaN' AS DOUBLE)
            ELSE CAST(42.36 AS DOUBLE) + ((event_id * 37) % 1000) / CAST(100000 AS DOUBLE) END AS lat,
       CAST(-71.06 AS DOUBLE) + ((event_id * 91) % 1000) / CAST(100000 AS DOUBLE) AS lon,
       CASE WHEN event_id % 17 = 2 THEN CAST('NaN' AS DOUBLE) WHEN event_type <> 'error' THEN floor(value * 8) / CAST(8 AS DOUBLE) END AS ele
FROM events""",
    "elevation_grid": """
SELECT 42360 + CAST(floor(p_partkey / 10) AS BIGINT) AS cell_y,
       -71060 + p_partkey % 10 AS cell_x,
       floor(p_retailprice * 8) / CAST(8 AS DOUBLE) - 900 AS ele
FROM part WHERE p_partkey % 7 <> 0""",
    # every cell of each block of streets, and one more on each side
    "street_elevation": """
SELECT 41999 + 20 * b.block + y.c_custkey AS cell_y,
       -71001 + x.c_custkey AS cell_x,
       10 + ((b.block * 31 + y.c_custkey * 17 + x.c_custkey * 23) % 97) / CAST(8 AS DOUBLE) AS ele
FROM (SELECT DISTINCT CAST(floor(c_custkey / 100) AS BIGINT) AS block FROM customer) b
JOIN customer y ON y.c_custkey < 12 JOIN customer x ON x.c_custkey < 14""",
    "street_nodes": """
SELECT c_custkey + 1 AS node_id,
       CAST(floor(c_custkey / 100) AS BIGINT) AS block,
       42 + floor(c_custkey / 100) * CAST(0.02 AS DOUBLE)
          + floor((c_custkey % 100) / 10) * CAST(0.001 AS DOUBLE) AS lat,
       -71 + (c_custkey % 10) * CAST(0.00125 AS DOUBLE) AS lon
FROM customer""",
    "street_edges": """
WITH n AS (SELECT c_custkey AS k, (SELECT count(*) FROM customer) AS total FROM customer),
fwd AS (
  SELECT k + 1 AS u, k + 2 AS v, 0 AS key, CAST(80 + (k * 37) % 50 AS DOUBLE) AS length, k
  FROM n WHERE k % 10 < 9 AND k + 1 < total
  UNION ALL
  SELECT k + 1, k + 11, 0, CAST(80 + (k * 53) % 50 AS DOUBLE), k
  FROM n WHERE k % 100 < 90 AND k + 10 < total
  UNION ALL
  SELECT k + 1, k + 2, 1, CAST(60 + (k * 37) % 50 AS DOUBLE), k
  FROM n WHERE k % 10 = 3 AND k + 1 < total)
SELECT u, v, key, length FROM fwd
UNION ALL
SELECT v, u, key, length FROM fwd WHERE k % 17 <> 0""",
    "walk_nodes": """
SELECT CAST(floor(r.c_custkey / 100) AS BIGINT) AS request_id,
       CAST(floor((r.c_custkey % 100) / 10) AS BIGINT) AS route_no,
       s.c_custkey AS seq,
       r.c_custkey + 1 + CASE WHEN s.c_custkey <= 9 THEN s.c_custkey ELSE 18 - s.c_custkey END AS node_id
FROM customer r JOIN customer s ON s.c_custkey < 19
WHERE r.c_custkey % 10 = 0""",
    "route_members": """
SELECT DISTINCT CAST(floor(l_orderkey / 16) AS BIGINT) AS request_id,
       l_orderkey % 16 AS route_no,
       CAST(42 AS DOUBLE) AS lat, -71 + (l_partkey % 6) * CAST(0.001 AS DOUBLE) AS lon
FROM lineitem""",
    "search_requests": """
SELECT o_orderkey AS request_id,
       CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE concat('Town ', CAST(o_custkey % 40 AS VARCHAR(20))) END AS location,
       CAST(o_custkey % 45 AS DOUBLE) AS target_distance_km,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_custkey % 400 AS DOUBLE) END AS target_elevation_gain_m,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 23 END AS num_results
FROM orders""",
    "candidate_metrics": """
SELECT l_orderkey AS request_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS BIGINT) AS candidate_no,
       l_quantity AS distance_km,
       CAST(floor(l_extendedprice) AS BIGINT) % 4000 / CAST(8 AS DOUBLE) AS elevation_gain_m
FROM lineitem""",
    "places": """
SELECT s_suppkey AS place_id,
       CASE WHEN s_suppkey % 4 = 0 THEN concat('Town ', CAST(s_suppkey % 30 AS VARCHAR(20)))
            WHEN s_suppkey % 4 = 3 THEN concat('Place Number ', CAST(s_suppkey AS VARCHAR(20)))
            ELSE concat('Place ', CAST(s_suppkey AS VARCHAR(20))) END AS name,
       concat('Town ', CAST(s_suppkey % 30 AS VARCHAR(20))) AS city,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE r_name END AS state,
       CASE WHEN n_regionkey = 1 THEN 'United States' ELSE n_name END AS country,
       CASE WHEN n_regionkey = 1 THEN 'US' ELSE concat('N', CAST(n_nationkey AS VARCHAR(20))) END AS countrycode,
       CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR(20)) END AS housenumber,
       CASE WHEN s_suppkey % 5 <> 0 THEN concat('Street ', CAST(s_suppkey % 9 AS VARCHAR(20))) END AS street,
       42 + (s_suppkey % 25) * CAST(0.001 AS DOUBLE) AS lat,
       -71 + floor(s_suppkey / 25) * CAST(0.001 AS DOUBLE) AS lon,
       CASE WHEN s_suppkey % 11 <> 0 THEN s_acctbal END AS importance,
       CASE WHEN s_suppkey % 4 = 0 THEN 'city' WHEN s_suppkey % 4 = 1 THEN '' END AS osm_value,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'house' END AS type,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_name END AS display_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # a search around a node of each block of streets; the last blocks may have too few nodes
    "loop_requests": """
SELECT CAST(floor(c_custkey / 100) AS BIGINT) AS request_id,
       42 + floor(c_custkey / 100) * CAST(0.02 AS DOUBLE) + floor((c_custkey % 100) / 10) * CAST(0.001 AS DOUBLE) + CAST(0.0002 AS DOUBLE) AS lat,
       -71 + (c_custkey % 10) * CAST(0.00125 AS DOUBLE) + CAST(0.0003 AS DOUBLE) AS lon,
       CAST(1 + (c_custkey % 7) * CAST(0.25 AS DOUBLE) AS DOUBLE) AS target_distance_km,
       CAST(c_custkey % 50 AS DOUBLE) AS target_elevation_gain_m
FROM customer WHERE c_custkey % 100 = 44""",
    # one connected town, as wide as it is high, that grows with the table
    "town_nodes": """
SELECT c_custkey + 1 AS node_id,
       42 + floor(c_custkey / w.w) * CAST(0.001 AS DOUBLE) AS lat,
       -71 + (c_custkey % w.w) * CAST(0.00125 AS DOUBLE) AS lon
FROM customer CROSS JOIN (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM customer) w""",
    "town_edges": """
WITH n AS (SELECT c_custkey AS k, t.total, t.w FROM customer
           CROSS JOIN (SELECT count(*) AS total, CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM customer) t),
fwd AS (
  SELECT k + 1 AS u, k + 2 AS v, 0 AS key, CAST(80 + (k * 37) % 50 AS DOUBLE) AS length, k FROM n WHERE k % w < w - 1 AND k + 1 < total
  UNION ALL
  SELECT k + 1, k + 1 + w, 0, CAST(80 + (k * 53) % 50 AS DOUBLE), k FROM n WHERE k + w < total)
SELECT u, v, key, length FROM fwd
UNION ALL
SELECT v, u, key, length FROM fwd WHERE k % 17 <> 0""",
    # many searches in the one town
    "town_requests": """
SELECT c_custkey AS request_id, n.lat + CAST(0.0002 AS DOUBLE) AS lat, n.lon + CAST(0.0003 AS DOUBLE) AS lon,
       CAST(1 + (c_custkey % 7) * CAST(0.25 AS DOUBLE) AS DOUBLE) AS target_distance_km
FROM customer JOIN (SELECT c_custkey + 1 AS node_id, 42 + floor(c_custkey / w.w) * CAST(0.001 AS DOUBLE) AS lat, -71 + (c_custkey % w.w) * CAST(0.00125 AS DOUBLE) AS lon
  FROM customer CROSS JOIN (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM customer) w) n ON n.node_id = c_custkey + 1
WHERE c_custkey % 50 = 7""",
    # the same nodes by Boston, across 180 degrees, and around the north pole
    "world_nodes": """
WITH n AS (SELECT c_custkey AS k, floor(c_custkey / w.w) * CAST(0.001 AS DOUBLE) AS up, (c_custkey % w.w) * CAST(0.00125 AS DOUBLE) AS right_
           FROM customer CROSS JOIN (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM customer) w)
SELECT k + 1 AS node_id, 42 + up AS lat, -71 + right_ AS lon FROM n
UNION ALL
SELECT k + 10000001, -17 + up, CASE WHEN right_ < CAST(0.01 AS DOUBLE) THEN CAST(179.99 AS DOUBLE) + right_ ELSE CAST(-180.01 AS DOUBLE) + right_ END FROM n
UNION ALL
SELECT k + 20000001, CAST(89.9 AS DOUBLE) + (k % 100) * CAST(0.001 AS DOUBLE), CAST(k % 360 - 180 AS DOUBLE) FROM n""",
    # of each kind some: in the town, at the seam from both sides, near and at the pole, of the size of a continent, without a place
    "wide_requests": """
SELECT c_custkey AS request_id,
       CASE c_custkey % 8 WHEN 0 THEN CAST(42.005 AS DOUBLE) WHEN 1 THEN CAST(-16.995 AS DOUBLE) WHEN 2 THEN CAST(-16.993 AS DOUBLE) WHEN 3 THEN CAST(90 AS DOUBLE)
         WHEN 4 THEN CAST(89.95 AS DOUBLE) WHEN 5 THEN CAST(40 AS DOUBLE) WHEN 6 THEN NULL ELSE CAST(-60 AS DOUBLE) END AS lat,
       CASE c_custkey % 8 WHEN 0 THEN CAST(-70.995 AS DOUBLE) WHEN 1 THEN CAST(180 AS DOUBLE) WHEN 2 THEN CAST(-179.999 AS DOUBLE) WHEN 4 THEN CAST(c_custkey AS DOUBLE)
         WHEN 5 THEN CAST(-100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lon,
       CASE c_custkey % 8 WHEN 3 THEN CAST(3000 AS DOUBLE) WHEN 5 THEN CAST(5000000 AS DOUBLE) ELSE CAST(500 + (c_custkey % 5) * 300 AS DOUBLE) END AS radius_m
FROM customer WHERE c_custkey < 40""",
    "place_queries": """
SELECT s_suppkey AS query_id,
       CASE WHEN s_suppkey % 3 = 0 THEN concat('town ', CAST(s_suppkey % 30 AS VARCHAR(20)))
            WHEN s_suppkey % 3 = 1 THEN concat(' PLACE ', CAST(s_suppkey % 90 AS VARCHAR(20)), ' ')
            WHEN s_suppkey % 4 = 0 THEN 'T' WHEN s_suppkey % 4 = 1 THEN concat('Place number ', CAST(s_suppkey % 9 AS VARCHAR(20))) WHEN s_suppkey % 4 = 2 THEN NULL ELSE 'To' END AS query
FROM supplier""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; the given tables that it reads become temporary views."""
    for table in TABLES[name]:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(SQL[name])


def with_fixtures(sql: str, *names: str, recursive: bool = False, instead: dict[str, str] | None = None) -> str:
    """``sql`` (a SELECT, or WITH and a SELECT) for DuckDB, with derived tables as common table expressions; ``instead``
    has the tables that stand under other names."""
    tables = ", ".join(f"{n} AS ({SQL[(instead or {}).get(n, n)]})" for n in names)
    body = sql.strip()
    rest = f", {body.removeprefix('WITH ')}" if body.startswith("WITH ") else f" {body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}{rest}"
