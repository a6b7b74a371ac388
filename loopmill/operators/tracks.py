"""Distances, climbs and profiles of tracks and routes in long form: one row per point, ordered by ``seq``.

Points of equal ``seq`` stand in order of place and elevation, so that reruns agree; repeated points have a distance
of 0 to each other. A null or NaN coordinate gives null steps, which count as 0; a null or NaN elevation is none. Null
keys are one group. An empty table gives an empty result.

By default one shuffle by track serves windows and aggregation. With ``chunk_points`` a track may have any length: windows
run over chunks of ``seq``, and what they need from before (the last point, sums and numbers so far) comes from windows
over one row for each chunk. Results are equal up to the last digits, as sums are grouped otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from loopmill.functions.geo import haversine_km

#: Points of one window partition in the two-level form for very long tracks.
CHUNK_POINTS = 100_000
CHUNK = "__chunk"


def along(points: DataFrame, keys: list[str]) -> WindowSpec:
    """The order of a track's points."""
    return Window.partitionBy(*keys).orderBy(*_order(points))


def _order(points: DataFrame) -> list[str]:
    return ["seq", *(c for c in ("lat", "lon", "ele") if c in points.columns)]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; keys come from ``left``."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"__{k}"]) for k in keys]
    return left.join(named, same, how).drop(*(f"__{k}" for k in keys))


def cut(points: DataFrame, chunk_points: int | None) -> DataFrame:
    """``points`` with the number of their chunk, if there are chunks."""
    return points if chunk_points is None else points.withColumn(CHUNK, F.floor(F.col("seq") / chunk_points))


def neighbour(points: DataFrame, keys: list[str], columns: list[str], name: str, chunk_points: int | None, ahead: bool = False) -> DataFrame:
    """``points`` (from ``cut``) with ``name``: the columns of the point before it, or after it, as a struct; null at the end."""
    own = F.struct(*columns)
    step = F.lead if ahead else F.lag
    if chunk_points is None:
        return points.withColumn(name, step(own).over(along(points, keys)))
    pick = F.min_by if ahead else F.max_by
    ends = points.groupBy(*keys, CHUNK).agg(pick(own, F.struct(*_order(points))).alias("__end"))
    ends = ends.withColumn("__beside", step("__end").over(Window.partitionBy(*keys).orderBy(CHUNK))).drop("__end")
    inside = step(own).over(along(points, [*keys, CHUNK]))
    return null_safe(points, ends, [*keys, CHUNK]).withColumn(name, F.coalesce(inside, "__beside")).drop("__beside")


def so_far(points: DataFrame, keys: list[str], values: dict[str, Column], chunk_points: int | None) -> DataFrame:
    """``points`` (from ``cut``) with the running sum of each value, its own point included."""
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if chunk_points is None:
        whole = running(along(points, keys))
        return points.withColumns({n: F.sum(v).over(whole) for n, v in values.items()})
    totals = points.groupBy(*keys, CHUNK).agg(*(F.sum(v).alias(f"__{n}") for n, v in values.items()))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"__{n}": F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)) for n in values})
    inside = running(along(points, [*keys, CHUNK]))
    summed = points.withColumns({n: F.sum(v).over(inside) for n, v in values.items()})
    added = null_safe(summed, totals, [*keys, CHUNK])
    return added.withColumns({n: F.col(n) + F.col(f"__{n}") for n in values}).drop(*(f"__{n}" for n in values))


def step_from(before: str) -> Column:
    """Kilometres from the point in a struct column; 0 without one, or where a coordinate is missing."""
    return F.coalesce(haversine_km(F.col(f"{before}.lat"), F.col(f"{before}.lon"), F.col("lat"), F.col("lon")), F.lit(0.0))


def _raised(points: DataFrame) -> DataFrame:
    return points.filter("ele IS NOT NULL AND NOT isnan(ele)")


def cumulative_distance(points: DataFrame, keys: list[str], chunk_points: int | None = None) -> DataFrame:
    """Points with an elevation, and ``cum_km`` along them.

    Points without elevation go first, so a step leads from the last kept point, across segments too.
    """
    kept = neighbour(cut(_raised(points), chunk_points), keys, ["lat", "lon"], "__before", chunk_points).withColumn("__step", step_from("__before"))
    return so_far(kept, keys, {"cum_km": F.col("__step")}, chunk_points).drop("__before", "__step", CHUNK)


def cumulative_distance_chunked(points: DataFrame, keys: list[str], chunk_points: int = CHUNK_POINTS) -> DataFrame:
    """``cumulative_distance`` for tracks of any length."""
    return cumulative_distance(points, keys, chunk_points)


def route_distance(points: DataFrame, keys: list[str], chunk_points: int | None = None) -> DataFrame:
    """keys, distance_km: the sum of consecutive distances; 0 for one point."""
    linked = neighbour(cut(points, chunk_points), keys, ["lat", "lon"], "__before", chunk_points)
    return linked.select(*keys, step_from("__before").alias("step_km")).groupBy(*keys).agg(F.sum("step_km").alias("distance_km"))


def climb(step: Column) -> dict[str, Column]:
    """Aggregates of climbed steps and of ``ele``."""
    return {
        "elevation_gain_m": F.round(F.coalesce(F.sum(F.when(step > 0, step).otherwise(0.0)), F.lit(0.0)), 1),
        "elevation_loss_m": F.round(F.coalesce(F.sum(F.when(step > 0, 0.0).otherwise(F.coalesce(F.abs(step), F.lit(0.0)))), F.lit(0.0)), 1),
        "min_elevation_m": F.round(F.coalesce(F.min("ele"), F.lit(0.0)), 1),
        "max_elevation_m": F.round(F.coalesce(F.max("ele"), F.lit(0.0)), 1),
    }


def elevation_metrics(points: DataFrame, keys: list[str], routes: DataFrame | None = None, chunk_points: int | None = None) -> DataFrame:
    """keys and gain, loss, least and largest elevation, each to 0.1. ``routes`` keeps those without points, as 0."""
    steps = neighbour(cut(_raised(points), chunk_points), keys, ["ele"], "__before", chunk_points)
    found = steps.groupBy(*keys).agg(*(c.alias(n) for n, c in climb(F.col("ele") - F.col("__before.ele")).items()))
    if routes is None:
        return found
    names = [n for n in found.columns if n not in keys]
    return null_safe(routes.select(*keys), found, keys, "left").select(*keys, *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))


def profile_summary(points: DataFrame, keys: list[str], chunk_points: int | None = None) -> DataFrame:
    """keys, distance_km and the four metrics of points with an elevation, in one shuffle by the keys."""
    linked = neighbour(cut(_raised(points), chunk_points), keys, ["lat", "lon", "ele"], "__before", chunk_points)
    steps = linked.select(*keys, "ele", step_from("__before").alias("__step"), (F.col("ele") - F.col("__before.ele")).alias("__climb"))
    metrics = climb(F.col("__climb"))
    return steps.groupBy(*keys).agg(F.round(F.sum("__step"), 3).alias("distance_km"), *(c.alias(n) for n, c in metrics.items()))


def profile_points(points: DataFrame, keys: list[str], chunk_points: int | None = None) -> DataFrame:
    """keys, seq (renumbered from 0), km to 0.001 and ele to 0.1: the elevation profile in long form."""
    kept = neighbour(cut(_raised(points), chunk_points), keys, ["lat", "lon"], "__before", chunk_points).withColumn("__step", step_from("__before"))
    walked = so_far(kept, keys, {"__km": F.col("__step"), "__nth": F.lit(1)}, chunk_points)
    return walked.select(*keys, (F.col("__nth") - 1).cast("long").alias("seq"), F.round("__km", 3).alias("km"), F.round("ele", 1).alias("ele"))


def _segments(points: DataFrame, keys: list[str], interval_m: float, chunk_points: int | None) -> DataFrame:
    """Points with a place, the one before (``__from``, null for the first), and ``__wanted`` points between both."""
    placed = points.select(*keys, "seq", "lat", "lon").filter("NOT (lat IS NULL OR lon IS NULL OR isnan(lat) OR isnan(lon))")
    linked = neighbour(cut(placed, chunk_points), keys, ["lat", "lon"], "__from", chunk_points)
    km = haversine_km(F.col("__from.lat"), F.col("__from.lon"), F.col("lat"), F.col("lon"))
    return linked.withColumns({"__km": km, "__wanted": F.floor(km / (interval_m / 1000)).cast("int")})


def interpolate(points: DataFrame, keys: list[str], interval_m: float = 50.0, most_per_segment: int | None = None, chunk_points: int | None = None) -> DataFrame:
    """keys, seq, lat, lon: points about every ``interval_m`` along each segment, and the original ones.

    A segment of no length adds nothing, so a repeated point goes, and so does a point without a place.
    ``most_per_segment`` bounds what one broken coordinate can add (``cut_segments`` reports where); None adds all.
    """
    segments, first = _segments(points, keys, interval_m, chunk_points), F.col("__from").isNull()
    n = F.col("__wanted") if most_per_segment is None else F.least("__wanted", F.lit(most_per_segment))
    # the first point is its own end, so one pass makes all rows; their number so far is the next one's place
    laid = segments.filter(first | (F.col("__km") > 0)).withColumn("n", F.when(first, 0).otherwise(n))
    laid = so_far(laid, keys, {"__end": F.col("n") + 1}, chunk_points)
    laid = laid.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n") + 1)))
    share = F.try_divide(F.col("j"), F.col("n") + 1)
    between = lambda c: F.col(f"__from.{c}") + share * (F.col(c) - F.col(f"__from.{c}"))
    at = lambda c: F.when(F.col("j") == F.col("n") + 1, F.col(c)).otherwise(between(c)).alias(c)
    return laid.select(*keys, (F.col("__end") - F.col("n") + F.col("j") - 2).cast("long").alias("seq"), at("lat"), at("lon"))


def cut_segments(points: DataFrame, keys: list[str], interval_m: float, most_per_segment: int, chunk_points: int | None = None) -> DataFrame:
    """keys, seq, wanted, kept: ends of segments to which ``interpolate`` adds fewer points for ``most_per_segment``."""
    found = _segments(points, keys, interval_m, chunk_points).filter(F.col("__wanted") > most_per_segment)
    return found.select(*keys, "seq", F.col("__wanted").cast("long").alias("wanted"), F.lit(most_per_segment).cast("long").alias("kept"))


def build_profile(coordinates: DataFrame, elevations: DataFrame, keys: list[str], chunk_points: int | None = None) -> DataFrame:
    """keys, seq, km, ele from coordinates and elevations of equal ``seq``; the shorter list ends it."""
    both = null_safe(coordinates.select(*keys, "seq", "lat", "lon"), elevations.select(*keys, "seq", "ele"), [*keys, "seq"])
    linked = neighbour(cut(both, chunk_points), keys, ["lat", "lon"], "__before", chunk_points).withColumn("__step", step_from("__before"))
    walked = so_far(linked, keys, {"__km": F.col("__step")}, chunk_points)
    return walked.select(*keys, "seq", F.round("__km", 3).alias("km"), F.round("ele", 1).alias("ele"))


def route_bounds(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the least and largest latitude and longitude; nulls do not count."""
    return points.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))))


def chart_series(profile: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, distance to two decimals, elevation to a whole metre (halves up)."""
    return profile.select(*keys, "seq", F.round("km", 2).alias("distance"), F.floor(F.col("ele") + 0.5).alias("elevation"))


def chart_axis(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y_min, y_max: tens around the elevations, padded by a tenth of their range and 5 m at least."""
    ends = series.groupBy(*keys).agg(F.min("elevation").alias("low"), F.max("elevation").alias("high"))
    pad = F.greatest((F.col("high") - F.col("low")) * 0.1, F.lit(5.0))
    return ends.select(*keys, (F.floor((F.col("low") - pad) / 10) * 10).alias("y_min"), (F.ceil((F.col("high") + pad) / 10) * 10).alias("y_max"))
