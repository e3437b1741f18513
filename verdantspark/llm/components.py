"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of edges(a, b); nodes are longs.

    A large star hangs each larger neighbour of a node on the smallest node it knows; a small star does so with its smaller
    neighbours. Both keep components as they are, and in a logarithmic number of rounds every node hangs on the smallest of
    its component. Minima are combined before the shuffle; the joins back are plain equi-joins, which adaptive execution
    splits where one node has very many edges. Each round is a written table, so a lost executor costs one round at most.
    Nulls, loops and repeated edges don't matter; no edges give no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "cc")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == seen:
            break
        seen = mark
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()
        then = cut(small, "cc")
        drop_cut(now)
        now = then
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
