"""Requests, scores, ranks and the words that explain them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.functions.geo import grade_band, grade_pct

# Limits of a request, and the weights of a score.
DEFAULT_RESULTS, MOST_RESULTS = 5, 20
#: Longest distance asked for, in kilometres: the search box of a longer one is a continent.
MOST_KM = 1000.0
DISTANCE_WEIGHT, GAIN_WEIGHT = 0.4, 0.6
#: The number at the beginning of a text, after blanks.
NUMBER_PREFIX = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def validate_requests(requests: DataFrame, most_km: float = MOST_KM) -> DataFrame:
    """``requests`` with num_results filled and ``reason``: null if valid, else the first rule that it breaks.

    The service has no upper limit of a distance; ``most_km`` is one, and infinity takes it away.
    """
    filled = requests.withColumn("num_results", F.coalesce("num_results", F.lit(DEFAULT_RESULTS)))
    blank = F.coalesce(F.trim("location"), F.lit("")) == ""
    reason = (
        F.when(blank, "location is blank")
        .when(~F.coalesce(F.col("target_distance_km") > 0, F.lit(False)), "distance must be positive")
        .when((F.col("target_distance_km") > most_km) | F.isnan("target_distance_km"), F.lit(f"distance must be at most {most_km:g} km"))
        .when(~F.coalesce(F.col("target_elevation_gain_m") >= 0, F.lit(False)), "gain must not be negative")
        .when(~F.col("num_results").between(1, MOST_RESULTS), "num_results must be from 1 to 20")
    )
    return filled.withColumn("reason", reason)


def resolve_targets(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """request_id, distance_km, gain_m. ``requests`` has mode (gpx or manual), track_id, distance_km, grade (text)
    and gain_m; ``profiles`` has track_id, distance_km, elevation_gain_m. A grade counts by the number that it
    begins with ("2.5 %" is 2.5); without one gain_m counts."""
    known = profiles.select("track_id", F.col("distance_km").alias("p_km"), F.col("elevation_gain_m").alias("p_gain"))
    grade = F.regexp_extract(F.col("grade"), NUMBER_PREFIX, 1).try_cast("double")
    manual = F.coalesce(grade / 100 * (F.col("distance_km") * 1000), F.col("gain_m"))
    gpx = F.col("mode") == "gpx"
    return requests.join(known, "track_id", "left").select("request_id", F.when(gpx, F.col("p_km")).otherwise(F.col("distance_km")).alias("distance_km"), F.when(gpx, F.col("p_gain")).otherwise(manual).alias("gain_m"))


def score(distance: Column, gain: Column, target_km: Column, target_gain: Column) -> Column:
    """Similarity from 0 to 1, to 0.001; a flat target loses a hundredth for each metre climbed."""
    by_km = F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(distance - target_km), target_km))
    by_gain = F.when(target_gain > 0, F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(gain - target_gain), target_gain))).otherwise(F.greatest(F.lit(0.0), 1 - gain / 100))
    return F.round(DISTANCE_WEIGHT * by_km + GAIN_WEIGHT * by_gain, 3)


def score_routes(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates of requests with a positive distance, and their ``similarity_score``."""
    targets = requests.filter("target_distance_km > 0").select("request_id", "target_distance_km", "target_elevation_gain_m", "num_results")
    value = score(F.col("distance_km"), F.col("elevation_gain_m"), F.col("target_distance_km"), F.col("target_elevation_gain_m"))
    return candidates.join(targets, "request_id").withColumn("similarity_score", value)


def rank_routes(scored: DataFrame) -> DataFrame:
    """The first ``num_results`` of each request by score, earlier candidates first among equals; and their names."""
    best = Window.partitionBy("request_id").orderBy(F.desc("similarity_score"), "candidate_no")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.least(F.coalesce("num_results", F.lit(DEFAULT_RESULTS)), F.lit(MOST_RESULTS)))
    return ranked.withColumns({"rank": F.col("rank").cast("long"), "name": F.concat(F.lit("Route "), F.col("rank"))})


def summarise_routes(routes: DataFrame) -> DataFrame:
    """``routes`` (distance_km, elevation_gain_m, similarity_score and both targets) with a summary in words.

    A route that lacks one of these, or has no length, keeps its row with the fallback summary.
    """
    km, gain, score_, to_km, to_gain = (F.col(c) for c in ("distance_km", "elevation_gain_m", "similarity_score", "target_distance_km", "target_elevation_gain_m"))
    off_km, off_gain, grade = F.abs(km - to_km), F.abs(gain - to_gain), grade_pct(gain, km)
    usable = grade.isNotNull() & off_km.isNotNull() & off_gain.isNotNull() & score_.isNotNull()
    pros = F.array_compact(
        F.array(
            F.when(off_km < 0.5, "Distance matches perfectly").when(off_km < 1, "Distance is close to target"),
            F.when(off_gain < 20, "Elevation gain matches well").when(off_gain < 50, "Similar elevation profile"),
            F.when(score_ >= 0.8, "Great overall match for training"),
        )
    )
    cons = F.array_compact(
        F.array(
            F.when(off_km >= 1, F.concat(F.lit("Distance is "), F.when(km > to_km, "longer").otherwise("shorter"), F.lit(" than target"))),
            F.when(off_gain >= 50, F.concat(F.when(gain > to_gain, "More").otherwise("Less"), F.lit(" elevation than target"))),
        )
    )
    advice = F.when(score_ >= 0.75, "Highly recommended for your training goals").when(score_ >= 0.5, "Good alternative with some differences").otherwise("Consider if other options unavailable")
    none = F.array().cast("array<string>")
    return routes.withColumns(
        {
            "grade_desc": F.when(usable, grade_band(grade)).otherwise("unknown"),
            "avg_grade": F.when(usable, F.format_string("%.1f", F.round(grade, 1))).otherwise("0"),
            "pros": F.when(usable, pros).otherwise(none),
            "cons": F.when(usable, cons).otherwise(none),
            "recommendation": F.when(usable, advice).otherwise("Route data available"),
        }
    )


def compare_to_target(routes: DataFrame, keys: list[str]) -> DataFrame:
    """Three rows for each route: distance, gain and grade against the target, in numbers, a flag and bar lengths."""
    target_grade = grade_pct(F.col("target_elevation_gain_m"), F.col("target_distance_km"))
    line = lambda label, unit, target, actual: F.struct(F.lit(label).alias("label"), F.lit(unit).alias("unit"), target.alias("target"), actual.alias("actual"))
    lines = F.array(
        line("Distance", "km", F.col("target_distance_km"), F.col("distance_km")),
        line("Elevation Gain", "m", F.col("target_elevation_gain_m"), F.col("elevation_gain_m")),
        line("Avg Grade", "%", target_grade, grade_pct(F.col("elevation_gain_m"), F.col("distance_km"))),
    )
    rows = routes.select(*keys, F.explode(lines).alias("x")).select(*keys, "x.*").withColumn("diff", F.col("actual") - F.col("target"))
    rows = rows.withColumn("diff_pct", F.when(F.col("target") > 0, F.col("diff") / F.col("target") * 100).otherwise(0.0))
    bar = lambda c: F.least(F.try_divide(F.col(c), F.greatest("target", "actual")) * 100, F.lit(100.0))
    flag = F.when(F.abs("diff_pct") < 10, "close").when(F.col("diff") > 0, "over").otherwise("under")
    return rows.withColumns({"flag": flag, "target_bar": bar("target"), "actual_bar": bar("actual")})


def result_rows(ranked: DataFrame, coordinates: DataFrame, profile: DataFrame, keys: list[str]) -> DataFrame:
    """One nested record for each ranked route, with its coordinates and profile in order; others are not built."""
    wanted = ranked.select(*keys)
    line = coordinates.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.array(p["lat"], p["lon"])).alias("coordinates"))
    shape = profile.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "km", "ele"))), lambda p: F.array(p["km"], p["ele"])).alias("profile"))
    return ranked.join(line, keys, "left").join(shape, keys, "left")


def write_results(results: DataFrame, path: str, buckets: int = 64, form: str = "parquet") -> None:
    """Nested records below ``path``, in folders by a bucket of the request."""
    bucketed = results.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(buckets)))
    bucketed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").format(form).save(path)
