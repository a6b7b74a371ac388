"""Resampling and comparing elevation profiles (keys, seq from 0, km, ele)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loopmill.functions.scratch import settle
from loopmill.operators.tracks import cut, neighbour, null_safe

SAMPLES = 50
#: Profiles of a block that meets others as a matrix: 1 MB, and 32 MB of scores for two blocks.
BLOCK = 2000


def simplify_profile(profile: DataFrame, key: str, num_points: int = 100, chunk_points: int | None = None) -> DataFrame:
    """key, idx, km, ele: profiles longer than ``num_points`` at evenly spaced distances, others as they are.

    An as-of lookup the other way round: each point makes the targets that lie beyond it, up to its successor,
    so every target has the last point strictly below it (the first point also has what lies at the start), and
    no join is needed. With ``chunk_points`` a profile may have any length: a chunk's last point has its successor
    from the next chunk, and counts and lengths come from one row for each profile. Null keys are one profile.
    """
    if num_points < 2:
        raise ValueError("num_points must be 2 or more")
    last = num_points - 1
    points = profile.select(key, "seq", "km", "ele")
    if chunk_points is None:
        whole = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        points = points.withColumns({"n": F.count("*").over(Window.partitionBy(key)), "total": F.last("km").over(whole)})
    else:
        totals = points.groupBy(key).agg(F.count("*").alias("n"), F.max_by("km", "seq").alias("total"))
        points = null_safe(points, totals, [key])
    points = neighbour(cut(points, chunk_points), [key], ["km", "ele"], "next", chunk_points, ahead=True)
    points = points.withColumns({"next_km": F.col("next.km"), "next_ele": F.col("next.ele"), "step": F.col("total") / last})
    is_first, is_last = F.col("seq") == 0, F.col("next").isNull()
    # a little too many candidates, then the exact comparison that the lookup is defined by
    low = F.when(is_first, 0).otherwise(F.greatest(F.coalesce(F.floor(F.try_divide("km", "step")), F.lit(0)) - 1, F.lit(0)))
    high = F.when(is_last, last).otherwise(F.least(F.coalesce(F.ceil(F.try_divide("next_km", "step")), F.lit(last)) + 1, F.lit(last)))
    own = lambda i: (is_first | (i * F.col("step") > F.col("km"))) & (is_last | (i * F.col("step") <= F.col("next_km")))
    tried = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    targets = F.when(F.col("n") > num_points, F.filter(tried, own)).otherwise(F.array(F.lit(-1)))
    found = points.withColumn("i", F.explode(targets))
    at, span = F.col("i") * F.col("step"), F.col("next_km") - F.col("km")
    ele = F.when(is_last | (span <= 0), F.col("ele")).otherwise(F.col("ele") + F.try_divide(at - F.col("km"), span) * (F.col("next_ele") - F.col("ele")))
    kept = F.col("i") == -1
    made = {"idx": F.col("i").cast("long"), "km": F.round(at, 3), "ele": F.round(ele, 1)}
    return found.select(key, *(F.when(kept, F.col("seq" if n == "idx" else n)).otherwise(c).alias(n) for n, c in made.items()))


def profile_vectors(profile: DataFrame, key: str, num_points: int = SAMPLES) -> DataFrame:
    """key, n, norm and centred elevations (an array of at most ``num_points``), once for each profile."""
    samples = simplify_profile(profile, key, num_points)
    rows = samples.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ele"))), lambda x: x["ele"]).alias("e"))
    mean = F.aggregate("e", F.lit(0.0), lambda a, x: a + x) / F.size("e")
    centred = rows.withColumn("mean", mean).withColumn("c", F.transform("e", lambda x: x - F.col("mean")))
    return centred.select(key, F.size("c").alias("n"), F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"), "c")


def correlate(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """``pairs`` (id_a, id_b) with ``correlation``; 0 if a profile has under two points or is flat.

    Means and norms are over each whole profile, the product over what both have.
    """
    side = lambda s: vectors.select(F.col(key).alias(f"id_{s}"), *(F.col(x).alias(f"{x}_{s}") for x in ("n", "norm", "c")))
    joined = pairs.join(side("a"), "id_a").join(side("b"), "id_b")
    shared = F.least("n_a", "n_b")
    product = F.aggregate(F.zip_with(F.slice("c_a", F.lit(1), shared), F.slice("c_b", F.lit(1), shared), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    value = F.when((F.col("n_a") < 2) | (F.col("n_b") < 2), 0.0).otherwise(F.coalesce(F.try_divide(product, F.col("norm_a") * F.col("norm_b")), F.lit(0.0)))
    return joined.select(*pairs.columns, value.alias("correlation"))


def _best_of_blocks(k: int, key: str):
    """For two blocks of profiles, the k of either most like each of the other, from one matrix product."""

    def sides(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        rows = table.column("rows").combine_chunks().flatten()
        ids, n, norm, c = (rows.field(i) for i in range(4))
        scale = np.where((n.to_numpy() >= 2) & (norm.to_numpy() > 0), norm.to_numpy(), np.inf)
        return ids, scale, c.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def best(near: np.ndarray, own: pa.Array, others: pa.Array) -> list[pa.Array]:
        """The first k of each row by score to nine digits, then by id (blocks are sorted by id)."""
        score = np.rint(near * 1e9)
        score[np.isnan(score)] = -2e9  # a profile and itself
        rank = score.astype(np.int64) * near.shape[1] - np.arange(near.shape[1])
        first = np.argpartition(-rank, min(k, near.shape[1]) - 1, axis=1)[:, :k]
        row, col = np.repeat(np.arange(len(own)), first.shape[1]), first.ravel()
        kept = score[row, col] > -2e9
        row, col = row[kept], col[kept]
        return [own.take(pa.array(row)), others.take(pa.array(col)), pa.array(near[row, col]), pa.array(score[row, col].astype(np.int64))]

    def run(of: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        (ids_a, scale_a, a), (ids_b, scale_b, b) = sides(left), sides(right)
        near = (a @ b.T) / scale_a[:, None] / scale_b[None, :]
        same = ids_a.equals(ids_b)
        if same:
            np.fill_diagonal(near, np.nan)
        parts = [best(near, ids_a, ids_b)] + ([] if same else [best(near.T, ids_b, ids_a)])
        return pa.table([pa.concat_arrays([p[i] for p in parts]) for i in range(4)], names=["id_a", "id_b", "correlation", "sorted"])

    return run


def profile_knn(profile: DataFrame, summary: DataFrame, key: str, k: int = 3, km_band: float = 1.0, gain_band: float = 100.0, block: int = BLOCK) -> DataFrame:
    """id_a, id_b, correlation, rank: the k profiles most like each one, among those in its own and the
    neighbouring distance and gain bands. Ties (nine digits) go to the smaller id.

    Bands are cut into blocks of about ``block`` profiles, chosen by hash; each two blocks of neighbouring bands meet
    once, as one matrix product, and give k rows for each of their profiles. No pair of profiles is a row, so a band may
    hold many: rows are profiles times blocks. A profile without a summary, or with a null one, is like none.
    """
    vectors = profile_vectors(profile, key)
    padded = F.concat("c", F.array_repeat(F.lit(0.0), SAMPLES - F.size("c")))
    bands = summary.select(key, F.floor(F.col("distance_km") / km_band).alias("kb"), F.floor(F.col("elevation_gain_m") / gain_band).alias("gb"))
    held = settle(bands.filter("kb IS NOT NULL AND gb IS NOT NULL").join(vectors.select(key, "n", "norm", padded.alias("c")), key))
    counts = held.groupBy("kb", "gb").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = held.join(counts, ["kb", "gb"]).withColumn("block", F.struct("kb", "gb", F.pmod(F.xxhash64(key), "blocks").alias("no")))
    packed = settle(dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(key, "n", "norm", "c"))).alias("rows")))
    around = F.array(*(F.struct((F.col("block.kb") + i).alias("kb"), (F.col("block.gb") + j).alias("gb")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    names = packed.select("block")
    asked = names.select(F.col("block").alias("a"), F.explode(around).alias("band"))
    pairs = settle(asked.join(names.select(F.col("block").alias("b"), F.struct("block.kb", "block.gb").alias("band")), "band").filter("a <= b").select("a", "b"))
    side = lambda x: pairs.join(packed.withColumnRenamed("block", x), x).select("a", "b", "rows")
    left, right = side("a"), side("b")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    kind = held.schema[key].dataType.simpleString()
    scored = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_best_of_blocks(k, key), f"id_a {kind}, id_b {kind}, correlation double, sorted long")
    best = Window.partitionBy("id_a").orderBy(F.desc("sorted"), "id_b")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= k).drop("sorted")
