"""Network reach: nodes within a distance along edges, and what lies near the edges between them."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import near_pairs


def edges_with_length(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, x0, y0, x1, y1, length of the straight edge where edges (u, v) has no geometry of its own."""
    a = nodes.select(F.col("node").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    b = nodes.select(F.col("node").alias("v"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.join(a, "u").join(b, "v").withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))


def ego_graph(origins: DataFrame, nodes: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """id, node, distance: nodes within `radius` along directed edges (u, v, x0, y0, length, ...) of each origin (id, node).

    An edge can only matter if it begins within the straight-line radius, as no path is shorter than that; such edges meet
    the origin by grid cell, and each origin's own small graph is searched by Dijkstra's algorithm.
    """
    at = origins.join(nodes.select("node", "x", "y"), "node")
    short = edges.groupBy("u", "v").agg(F.min("length").alias("length"), F.first("x0").alias("rx"), F.first("y0").alias("ry"))
    close = near_pairs(at, short, radius).filter(F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")) <= radius).select("id", "node", "u", "v", "length")
    lone = at.select("id", "node", F.lit(None).cast("long").alias("u"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("double").alias("length"))

    def reach(t: pa.Table) -> pa.Table:
        start = t["node"][0].as_py()
        out: dict = {}
        for u, v, n in zip(t["u"].to_pylist(), t["v"].to_pylist(), t["length"].to_pylist(), strict=True):
            out.setdefault(u, []).append((v, n))
        best, heap = {}, [(0.0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in best:
                continue
            best[u] = d
            for v, n in out.get(u, ()):
                if v not in best and d + n <= radius:
                    heapq.heappush(heap, (d + n, v))
        return pa.table({"id": pa.array([t["id"][0].as_py()] * len(best), t["id"].type), "node": pa.array(list(best), pa.int64()), "distance": pa.array(list(best.values()), pa.float64())})

    rows = close.withColumn("u", F.col("u").cast("long")).withColumn("v", F.col("v").cast("long")).unionByName(lone)
    return rows.groupBy("id").applyInArrow(reach, f"id {origins.schema['id'].dataType.simpleString()}, node long, distance double")


def reachable_edges(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """Per origin, the edges between nodes that it reaches."""
    a, b = reach.select("id", F.col("node").alias("u")), reach.select("id", F.col("node").alias("v"))
    return edges.join(a, "u").join(b, ["id", "v"]).select("id", "u", "v", "x0", "y0", "x1", "y1").distinct()


def isochrone_members(reach: DataFrame, edges: DataFrame, places: DataFrame, width: float = 25.0) -> DataFrame:
    """Pairs (id, place) of origins and places (place, x, y) within `width` of an edge between reached nodes.

    Edges are cut into pieces of `width`, whose middles meet places in neighbouring grid cells.
    """
    segs = reachable_edges(reach, edges)
    n = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / width), F.lit(1)).cast("int")
    cuts = segs.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = (F.col("_k") + 0.5) / F.col("_n")
    cuts = cuts.withColumn("rx", F.col("x0") + f * (F.col("x1") - F.col("x0"))).withColumn("ry", F.col("y0") + f * (F.col("y1") - F.col("y0")))
    met = near_pairs(places, cuts.select("id", "x0", "y0", "x1", "y1", "rx", "ry"), 2 * width)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.coalesce(F.least(F.greatest(F.try_divide((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    ex, ey = F.col("x") - (F.col("x0") + t * dx), F.col("y") - (F.col("y0") + t * dy)
    return met.filter(ex * ex + ey * ey <= width * width).select("id", "place").distinct()
