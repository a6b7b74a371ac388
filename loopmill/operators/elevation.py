"""Elevations from a grid table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopmill.functions.scratch import settle
from loopmill.operators.tracks import climb, interpolate, neighbour, null_safe, step_from

CELL_DEGREES = 0.001


def _cells(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumns({"cell_y": F.floor(F.col("lat") / cell), "cell_x": F.floor(F.col("lon") / cell)})


def lookup_elevation(points: DataFrame, grid: DataFrame, cell: float = CELL_DEGREES, also: list[str] | None = None) -> DataFrame:
    """``points`` with ``ele``: the value of the grid cell, 0.0 where the grid has none; and ``also`` of its columns.

    Only distinct cells meet the grid; Spark picks a broadcast for a small grid, and splits popular cells.
    """
    placed = _cells(points.drop("ele", *(also or [])), cell)
    known = placed.select("cell_y", "cell_x").distinct().join(grid.select("cell_y", "cell_x", "ele", *(also or [])), ["cell_y", "cell_x"])
    return placed.join(known, ["cell_y", "cell_x"], "left").withColumn("ele", F.coalesce("ele", F.lit(0.0))).drop("cell_y", "cell_x")


def check_lookup(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, expected, got: routes whose answers are not as many as their points, as a doubled cell makes them."""
    expected, got = before.groupBy(*keys).agg(F.count("*").alias("expected")), after.groupBy(*keys).agg(F.count("*").alias("got"))
    return expected.join(got, keys, "full").select(*keys, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("got", F.lit(0)).alias("got")).filter("expected <> got")


DOUBLED = "Elevation service returned a wrong number of results"


def route_metrics(points: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """keys, distance_km and climbs of routes whose every point has an elevation, in one pass; and other aggregates."""
    linked = neighbour(points, keys, ["lat", "lon", "ele"], "__before", None)
    steps = linked.withColumns({"__step": step_from("__before"), "__climb": F.col("ele") - F.col("__before.ele")})
    metrics = climb(F.col("__climb"))
    return steps.groupBy(*keys).agg(F.round(F.sum("__step"), 3).alias("distance_km"), *(c.alias(n) for n, c in metrics.items()), *more)


def enrich_routes(points: DataFrame, grid: DataFrame, keys: list[str], interval_m: float = 100.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, dense points, rejects): interpolated routes with elevations; distance is that of the dense line.

    A route over a cell that the grid has more than once would get more answers than points, as ``check_lookup`` tells
    it: it goes to the rejects (keys, reason) and the others stay. Doubled cells are told from the grid alone.
    """
    cells = grid.groupBy("cell_y", "cell_x").agg(F.min("ele").alias("ele"), (F.count("*") > 1).alias("doubled"))
    raised = lookup_elevation(interpolate(points, keys, interval_m), cells, also=["doubled"])
    judged = settle(route_metrics(raised, keys, F.coalesce(F.max("doubled"), F.lit(False)).alias("doubled")))
    bad = judged.filter("doubled").select(*keys, F.lit(DOUBLED).alias("reason"))
    kept = null_safe(raised.drop("doubled"), bad.select(*keys), keys, "left_anti")
    return judged.filter("NOT doubled").drop("doubled"), kept, bad
