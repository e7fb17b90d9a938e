"""Connected components over an edge table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stage


def _largest(edges: DataFrame) -> DataFrame:
    """Link each greater neighbour of ``u`` to the smallest node of u's neighbourhood, u included."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of ``u``, and u, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (u, v); root is the smallest node reachable.

    Alternating large-star and small-star steps: O(log**2 n) rounds, each linear
    in the edges; each round is a table in the shared folder.  Hubs are joined,
    never gathered: the minimum is aggregated before the shuffle and a hub's
    edges are split by the adaptive skew join.  Self loops and repeated edges do
    no harm; an empty table gives an empty one.
    """
    now = stage(edges.where("u <> v").select("u", "v").distinct(), "cc")
    mark = None
    while True:
        now = stage(_smallest(_largest(now)), "cc")
        is_now = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if is_now == mark:
            break
        mark = is_now
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
