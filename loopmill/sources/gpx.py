"""GPX documents as point tables, with Spark's own XML parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopmill.functions.scratch import settle

_POINT = "STRUCT<_lat: DOUBLE, _lon: DOUBLE, ele: DOUBLE>"
SCHEMA = f"trk ARRAY<STRUCT<trkseg: ARRAY<STRUCT<trkpt: ARRAY<{_POINT}>>>>>, rte ARRAY<STRUCT<rtept: ARRAY<{_POINT}>>>, _corrupt_record STRING"
# What a rejected file is told.
NOT_GPX, BROKEN, NO_POINTS = "File must be a GPX file", "Failed to parse", "GPX file contains no points with elevation data"
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"


def as_text(content: str = "content") -> Column:
    """Bytes of a file as text; null if they are not UTF-8, so that one such file is rejected by itself."""
    return F.try_validate_utf8(F.col(content).cast("string"))


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """track_id (the path) and content (text; null if it cannot be decoded) of files."""
    return spark.read.format("binaryFile").load(paths).select(F.col("path").alias("track_id"), as_text().alias("content"))


def gpx_files_only(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files whose name ends in .gpx in any case, rejects of the others)."""
    fits = F.lower("track_id").endswith(".gpx")
    return files.filter(fits), files.filter(~F.coalesce(fits, F.lit(False))).select("track_id", F.lit(NOT_GPX).alias("reason"))


def _points_of(gpx: str) -> Column:
    """All points of a document in one array: tracks by segment, then routes; waypoints are left out."""
    none = F.array().cast(f"array<{_POINT}>")
    joined = lambda lists: F.flatten(F.filter(lists, lambda x: x.isNotNull()))
    tracks = joined(F.transform(f"{gpx}.trk", lambda t: joined(F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    routes = joined(F.transform(f"{gpx}.rte", lambda r: r["rtept"]))
    return F.concat(F.coalesce(tracks, none), F.coalesce(routes, none))


def parse(files: DataFrame) -> DataFrame:
    """track_id, points (an array) and reason (null if the file gives a profile) of ``files`` (track_id, content).

    Namespaces and waypoints are ignored. Content that is null, broken, or has a point without a place is told
    BROKEN, content without an elevated point NO_POINTS.
    """
    document = F.from_xml("content", SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    read = files.select("track_id", document.alias("gpx"))
    listed = read.select("track_id", (F.col("gpx").isNull() | F.col("gpx._corrupt_record").isNotNull()).alias("broken"), _points_of("gpx").alias("points"))
    lost = F.exists("points", lambda p: p["_lat"].isNull() | p["_lon"].isNull() | F.isnan(p["_lat"]) | F.isnan(p["_lon"]) | F.isnan(p["ele"]))
    raised = F.exists("points", lambda p: p["ele"].isNotNull())
    reason = F.when(F.col("broken") | F.coalesce(lost, F.lit(False)), BROKEN).when(~F.coalesce(raised, F.lit(False)), NO_POINTS)
    return listed.select("track_id", "points", reason.alias("reason"))


def flatten(parsed: DataFrame) -> DataFrame:
    """track_id, seq, lat, lon, ele: the points of each file in order. No exchange: a file is one row before."""
    rows = parsed.select("track_id", F.posexplode("points").alias("seq", "p"))
    return rows.select("track_id", F.col("seq").cast("long").alias("seq"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.ele").alias("ele"))


def rejects(parsed: DataFrame) -> DataFrame:
    """track_id, reason of files that give no profile."""
    return parsed.filter("reason IS NOT NULL").select("track_id", "reason")


def read_gpx(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, rejects) of ``files`` (track_id, content), each file's XML parsed once. A name that occurs twice
    gives the points of both files."""
    named, others = gpx_files_only(files)
    parsed = settle(parse(named))
    return flatten(parsed.filter("reason IS NULL")), others.unionByName(rejects(parsed))


def render(points: DataFrame, segment: int = 20) -> DataFrame:
    """track_id, content: GPX text of points; the first two parts of ``segment`` are track segments, the rest a route."""
    tag = F.when(F.col("seq") < 2 * segment, "trkpt").otherwise("rtept")
    ele = F.when(F.col("ele").isNotNull(), F.concat(F.lit("<ele>"), F.col("ele").cast("string"), F.lit("</ele>"))).otherwise("")
    text = F.concat(F.lit("<"), tag, F.lit(' lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('">'), ele, F.lit("</"), tag, F.lit(">"))
    part = F.least(F.floor(F.col("seq") / segment), F.lit(2))
    rows = points.select("track_id", "seq", part.alias("part"), text.alias("text"))
    joined = rows.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part", "text"))).alias("p"))
    of = lambda k: F.array_join(F.transform(F.filter("p", lambda x: x["part"] == k), lambda x: x["text"]), "")
    body = F.concat(F.lit('<?xml version="1.0"?><gpx><wpt lat="1" lon="1"><ele>5</ele></wpt><trk><name>t</name><trkseg>'), of(0), F.lit("</trkseg><trkseg>"), of(1), F.lit("</trkseg></trk><rte>"), of(2), F.lit("</rte></gpx>"))
    return joined.select("track_id", body.alias("content"))
