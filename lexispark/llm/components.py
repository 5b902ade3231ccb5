"""Connected components of a table of edges by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexispark.plans.checkpoints import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (smallest reachable id) for every node of an edge between two ids.

    Large stars move the larger neighbours of a node to the smallest one, small
    stars the smaller ones; both keep what is connected. When nothing moves, every
    node hangs on the smallest of its component. A round is two aggregations and
    joins by node; minima are taken before the shuffle, so a hub is no hot key.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").dropna()
    now = cut_lineage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            lowest.select("u", F.col("m").alias("v"))
        )
        now = cut_lineage(small.filter("u <> v").distinct())
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
