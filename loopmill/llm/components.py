"""Linking inside buckets and connected components, as joins and aggregations only.

No step gathers a bucket or a component into one task: buckets give a star to their hub by an aggregation and
a join (which Spark splits when it is skewed), and components are found by the alternating large-star and
small-star rewriting of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopmill.llm.common import materialize


def stars(members: DataFrame, hub_order: str = "node") -> DataFrame:
    """Distinct (node, hub) pairs: each bucket's members with that of least ``hub_order``.

    ``members`` has bucket, node and the column hub_order if it is another one.
    """
    hubs = members.groupBy("bucket").agg(F.min_by("node", F.struct(hub_order, "node")).alias("hub"), F.min("node").alias("low"), F.max("node").alias("high"))
    hubs = hubs.filter("low < high").select("bucket", "hub")
    return members.select("bucket", "node").join(hubs, "bucket").filter("node <> hub").select("node", "hub").distinct()


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with ``component`` and the bucket's largest, ``main``.

    ``labels`` has node and component; nodes without a row are their own component.
    """
    known = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").select("bucket", "main")
    return materialize(known.join(mixed, "bucket"))


def across(members: DataFrame, extra: list[str] | None = None, condition=None) -> DataFrame:
    """Distinct pairs (a, b) of one bucket in different components, from ``open_members``.

    A bucket's largest component is met by the others and never joined with itself. ``condition`` is a filter
    over a_/b_ prefixed ``extra`` columns that stands in the join.
    """
    extra = extra or []
    a = members.filter("component <> main").select("bucket", "main", F.col("node").alias("a"), F.col("component").alias("ca"), *[F.col(c).alias(f"a_{c}") for c in extra])
    b = members.select("bucket", F.col("node").alias("b"), F.col("component").alias("cb"), *[F.col(c).alias(f"b_{c}") for c in extra])
    pairs = a.join(b, "bucket").filter("ca <> cb AND (cb = main OR a < b)")
    if condition is not None:
        pairs = pairs.filter(condition)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b); only nodes that have an edge.

    Each round is written to the shared folder, so that the plan stays short and a lost executor costs a task.
    """
    stars_ = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    for _ in range(most_rounds):
        # large star: larger neighbours of each node move to its smallest neighbour
        both = stars_.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(stars_.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        # small star: smaller neighbours of each node, and itself, move to the smallest of them
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        moved = large.join(low, "node").select(F.explode(F.array("node", "root")).alias("node"), F.col("m").alias("root"))
        new = materialize(moved.filter("node <> root").distinct())
        if _is_stars(new):
            return new.select("node", F.col("root").alias("component")).unionByName(new.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct())
        stars_ = new
    raise RuntimeError("components did not settle")


def _is_stars(edges: DataFrame) -> bool:
    """Each node has one root, and no root is a node."""
    many = edges.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    chained = edges.select("node").join(edges.select(F.col("root").alias("node")).distinct(), "node", "left_semi").limit(1)
    return many.isEmpty() and chained.isEmpty()
