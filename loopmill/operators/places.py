"""Gazetteer lookups: by name, by position, and by the first letters of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.functions.scratch import unbroadcast
from loopmill.operators.graph import nearest_node

# Limits of suggestions, and the names of the United States.
LEAST_QUERY, MOST_HITS, MOST_SHOWN = 2, 7, 5
US_NAMES, US_CODE = ("United States", "United States of America"), "US"
#: Letters of a name that are its join key; longer queries are compared in full afterwards.
KEY_LETTERS = 12


def normal(text: Column) -> Column:
    """A name or query as it is compared: small letters, without blanks around it."""
    return F.lower(F.trim(text))


def geocode(requests: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, rejects): request_id, place_id, lat, lon of the most important place of the name; and the others.

    Ties go to the smaller place id; a place without importance comes after all others.
    """
    asked = requests.select("request_id", "location", normal(F.col("location")).alias("key"))
    named = places.select("place_id", "lat", "lon", "importance", normal(F.col("name")).alias("key"))
    last = F.coalesce(-F.nanvl("importance", F.lit(None)), F.lit(float("inf")))
    best = named.groupBy("key").agg(F.min_by(F.struct("place_id", "lat", "lon"), F.struct(last, F.col("place_id"))).alias("place"))
    found = asked.join(best, "key").select("request_id", "place.place_id", "place.lat", "place.lon")
    rejects = asked.join(best, "key", "left_anti").select("request_id", F.concat(F.lit("Location not found: "), F.coalesce("location", F.lit(""))).alias("reason"))
    return found, rejects


def reverse_geocode(points: DataFrame, places: DataFrame, cell: float = 0.01) -> DataFrame:
    """point_id, display_name of the nearest place; without a name its position in four decimals."""
    near = nearest_node(points.select(F.col("point_id"), "lat", "lon"), places.select(F.col("place_id").alias("node_id"), "lat", "lon"), ["point_id"], cell)
    named = near.join(unbroadcast(places.select(F.col("place_id").alias("node_id"), "display_name")), "node_id", "left")
    whole = unbroadcast(points.select("point_id", "lat", "lon")).join(named.select("point_id", "display_name"), "point_id", "left")
    return whole.select("point_id", F.coalesce("display_name", F.format_string("%.4f, %.4f", "lat", "lon")).alias("display_name"))


def is_us() -> Column:
    """Whether a place lies in the United States, by the name of the country or its code; false if neither is known."""
    return F.coalesce(F.col("country").isin(*US_NAMES), F.lit(False)) | F.coalesce(F.col("countrycode") == US_CODE, F.lit(False))


def place_display(places: DataFrame) -> DataFrame:
    """``places`` with is_us and display: what is known of a place, joined by commas."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    street = F.when(given("housenumber").isNotNull() & given("street").isNotNull(), F.concat_ws(" ", "housenumber", "street")).otherwise(given("street"))
    parts = [F.when(~F.col("name").eqNullSafe(F.col("city")), given("name")), street, given("city"), given("state"), F.when(~is_us(), given("country"))]
    text = F.nullif(F.concat_ws(", ", *parts), F.lit(""))
    return places.withColumns({"is_us": is_us(), "display": F.coalesce(text, given("name"), F.lit("Unknown location"))})


def place_suggest(queries: DataFrame, places: DataFrame) -> DataFrame:
    """query_id, rank and the shown fields of up to five places whose name begins with the query.

    Fields: place_id, display, city (else the name), state, country, country_code, lat, lon, is_us, type. The
    seven most important hits count, smaller ids first among equals; of them the United States come first.
    Queries of one letter, null or blank ones give nothing; a query_id that occurs twice is one query.

    Names are keyed by their first letters, up to KEY_LETTERS, and each key keeps its seven best places before
    it meets queries, however many names or queries share it. Longer queries meet the places of their own
    longest key and are compared in full.
    """
    asked = queries.select("query_id", normal(F.col("query")).alias("q"), F.length("query").alias("n")).filter(F.col("n") >= LEAST_QUERY).filter(F.length("q") > 0)
    asked = asked.select("query_id", "q", F.substring("q", 1, KEY_LETTERS).alias("key"), (F.length("q") > KEY_LETTERS).alias("long"))
    folded = places.select("place_id", "importance", normal(F.col("name")).alias("folded")).filter(F.length("folded") > 0)
    sizes = F.sequence(F.lit(1), F.least(F.length("folded"), F.lit(KEY_LETTERS)))
    keyed = folded.withColumn("key", F.explode(F.transform(sizes, lambda n: F.left(F.col("folded"), n))))
    keyed = keyed.join(asked.filter("NOT long").select("key").distinct(), "key", "left_semi")
    by_key = Window.partitionBy("key").orderBy(F.desc("importance"), "place_id")
    best = keyed.withColumn("hit", F.row_number().over(by_key)).filter(F.col("hit") <= MOST_HITS).select("key", "place_id", "hit")
    short_hits = asked.filter("NOT long").join(best, "key").select("query_id", "place_id", "hit")
    whole = folded.withColumn("key", F.left("folded", F.lit(KEY_LETTERS)))
    texts = asked.filter("long").select("q", "key").distinct().join(whole, "key").filter(F.startswith("folded", "q"))
    by_text = Window.partitionBy("q").orderBy(F.desc("importance"), "place_id")
    texts = texts.withColumn("hit", F.row_number().over(by_text)).filter(F.col("hit") <= MOST_HITS).select("q", "place_id", "hit")
    long_hits = asked.filter("long").join(texts, "q").select("query_id", "place_id", "hit")
    field = lambda c: F.nullif(F.col(c), F.lit("")) if c in places.columns else F.lit(None).cast("string")
    shown = place_display(places).select(
        "place_id",
        "display",
        F.coalesce(field("city"), F.col("name")).alias("city"),
        "state",
        "country",
        F.col("countrycode").alias("country_code"),
        "lat",
        "lon",
        "is_us",
        F.coalesce(field("osm_value"), field("type")).alias("type"),
    )
    hits = short_hits.unionByName(long_hits).join(shown, "place_id")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("is_us"), "hit")))
    kept = ranked.filter(F.col("rank") <= MOST_SHOWN).withColumn("rank", F.col("rank").cast("long"))
    return kept.select("query_id", "rank", *shown.columns)
