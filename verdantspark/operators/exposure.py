"""Exposure of places to greenness: areas of interest, checks of extent, land cover by name, rasters brought to a place's grid."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, masks
from .network import ego_graph, reachable_edges
from .order import row_index


def fill_ids(rows: DataFrame, *order: str | Column, name: str = "id") -> DataFrame:
    """rows with null ids replaced by the row's 1-based position in the given order."""
    numbered = row_index(rows, *order, name="_position")
    return numbered.withColumn(name, F.coalesce(F.col(name).cast("long"), F.col("_position") + 1)).drop("_position")


def map_centre(points: DataFrame) -> DataFrame:
    """One row: the mean x and y of the different points."""
    return points.select("x", "y").distinct().agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def bounds(points: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row: the points' box, wider by `margin` on each side."""
    return points.agg((F.min("x") - margin).alias("xmin"), (F.min("y") - margin).alias("ymin"), (F.max("x") + margin).alias("xmax"), (F.max("y") + margin).alias("ymax"))


def inside(x: Column, y: Column, xmin, ymin, xmax, ymax) -> Column:
    """Whether a point lies strictly inside a box: one on the border doesn't."""
    return (x > xmin) & (x < xmax) & (y > ymin) & (y < ymax)


def extent_counts(areas: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """One row: boxes (xmin, ymin, xmax, ymax) in all, those within the extent, and those that meet it. A point is within only
    off the border."""
    point = (F.col("xmin") == F.col("xmax")) & (F.col("ymin") == F.col("ymax"))
    closed = (F.col("xmin") >= xmin) & (F.col("ymin") >= ymin) & (F.col("xmax") <= xmax) & (F.col("ymax") <= ymax)
    strict = inside(F.col("xmin"), F.col("ymin"), xmin, ymin, xmax, ymax)
    meets = (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
    return areas.agg(F.count("*").alias("total"), F.count_if(F.when(point, strict).otherwise(closed)).alias("within"), F.count_if(meets).alias("meets"))


def check_extent(areas: DataFrame, extent: tuple[float, float, float, float], geometry: str) -> bool:
    """Whether all places lie within the data's extent. Points that don't raise; polygons raise if one doesn't even meet it, and
    warn otherwise."""
    total, within, meets = extent_counts(areas, *extent).first()
    if within == total:
        return True
    if geometry == "Point":
        raise ValueError("not all points of interest are within the data")
    if meets < total:
        raise ValueError("not all polygons of interest meet the data")
    warnings.warn("some polygons are not completely within the data: results are of the part that is", stacklevel=2)
    return False


def as_boxes(points: DataFrame) -> DataFrame:
    """Points (id, x, y) as boxes without extent."""
    return points.select("id", F.col("x").alias("xmin"), F.col("y").alias("ymin"), F.col("x").alias("xmax"), F.col("y").alias("ymax"))


def convex_buffer(ring: Column, radius: float, sides: int = 64) -> Column:
    """Corners of the buffer of a convex, counter-clockwise ring: each corner's arc of the regular polygon that stands for a
    circle, between the directions of its two edges."""
    n = F.size(ring)
    step = 2 * np.pi / sides

    def arc(p: Column, i: Column) -> Column:
        before, after = ring[F.pmod(i + n - 1, n)], ring[F.pmod(i + 1, n)]
        turn = F.pmod(F.atan2(after["y"] - p["y"], after["x"] - p["x"]) - F.atan2(p["y"] - before["y"], p["x"] - before["x"]), F.lit(2 * np.pi))
        outward = F.atan2(p["y"] - before["y"], p["x"] - before["x"]) - np.pi / 2
        cuts = F.ceil(turn / step).cast("int")
        return F.transform(F.sequence(F.lit(0), cuts), lambda k: F.struct((p["x"] + radius * F.cos(outward + F.try_divide(k * turn, cuts))).alias("x"), (p["y"] + radius * F.sin(outward + F.try_divide(k * turn, cuts))).alias("y")))

    return F.flatten(F.transform(ring, arc))


def build_aoi(places: DataFrame, buffer_type: str | None, distance: float | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """id and rings of each place's area of interest: its own polygon (no buffer; places have rings), the buffer around its
    point (x, y) or convex polygon, or, over a network, the outline-filled cells of its isochrone (id, cx, cy, see
    isochrone_cells; places have the nearest node)."""
    if buffer_type is None:
        return places.select("id", "rings")
    if buffer_type == "euclidean":
        ring = convex_buffer(F.col("rings")[0], distance) if "rings" in places.columns else geo.buffer_ring(F.col("x"), F.col("y"), distance)
        return places.select("id", F.array(ring).alias("rings"))
    if buffer_type == "network":
        return isochrone_cells(ego_graph(places.select("id", "node"), nodes, edges, distance), edges)
    raise ValueError("buffer_type must be euclidean, network or none")


def isochrone_cells(reach: DataFrame, edges: DataFrame, width: float = 25.0, size: float = 5.0) -> DataFrame:
    """id, cx, cy, hole: cells of `size` whose centre lies within `width` of an edge between reached nodes, and those that such
    cells surround (hole). An origin's cells are bounded by its reach, and each origin is one group."""
    segments = reachable_edges(reach, edges)
    kind = reach.schema["id"].dataType.simpleString()

    def fill(t: pa.Table) -> pa.Table:
        x0, y0, x1, y1 = (t[c].to_numpy() for c in ("x0", "y0", "x1", "y1"))
        low = np.floor(np.array([min(x0.min(), x1.min()), min(y0.min(), y1.min())]) / size - width / size).astype(int) - 2
        high = np.ceil(np.array([max(x0.max(), x1.max()), max(y0.max(), y1.max())]) / size + width / size).astype(int) + 2
        gx, gy = (np.arange(low[k], high[k] + 1) for k in (0, 1))
        px, py = (gx[:, None] + 0.5) * size, (gy[None, :] + 0.5) * size
        near = np.zeros((len(gx), len(gy)), bool)
        for a, b, c, d in zip(x0, y0, x1, y1, strict=True):
            dx, dy = c - a, d - b
            f = np.clip(((px - a) * dx + (py - b) * dy) / max(dx * dx + dy * dy, 1e-300), 0, 1)
            near |= (px - a - f * dx) ** 2 + (py - b - f * dy) ** 2 <= width * width
        outside = np.zeros_like(near)
        outside[[0, -1], :] = outside[:, [0, -1]] = True
        while True:
            wider = outside.copy()
            wider[1:] |= outside[:-1]
            wider[:-1] |= outside[1:]
            wider[:, 1:] |= outside[:, :-1]
            wider[:, :-1] |= outside[:, 1:]
            wider &= ~near
            if (wider == outside).all():
                break
            outside = wider
        i, j = np.nonzero(~outside)
        return pa.table({"id": pa.array([t["id"][0].as_py()] * len(i), t["id"].type), "cx": pa.array(gx[i]), "cy": pa.array(gy[j]), "hole": pa.array(~near[i, j])})

    return segments.groupBy("id").applyInArrow(fill, f"id {kind}, cx long, cy long, hole boolean")


def landcover_catalogue(items: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The first (seq) catalogue item whose box meets the area, with its classes."""
    meets = (F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin)
    return items.filter(meets).orderBy("seq").limit(1)


def named_classes(shares: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """shares (id, landcover, percentage) with the class's description by classes (value, description), or class_<value>."""
    if classes is None:
        return shares.withColumn("name", F.concat(F.lit("class_"), F.col("landcover").cast("string")))
    return shares.join(classes.select(F.col("value").alias("landcover"), "description"), "landcover", "left").withColumn("name", F.coalesce("description", F.col("landcover").cast("string"))).drop("description")


def concat_columns(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """left with the other columns of right, by key; rows of left without a partner stay."""
    return left.join(right, key, "left")


def flatten_features(tiles: DataFrame, features: str = "features") -> DataFrame:
    """One row for each feature of each tile's list, with its place in the list; empty lists give none."""
    return tiles.select("*", F.posexplode(features).alias("place", "feature")).drop(features)


def footprint_contains(scenes: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Scenes whose box (xmin, ymin, xmax, ymax) contains the area, borders included."""
    return scenes.filter((F.col("xmin") <= xmin) & (F.col("ymin") <= ymin) & (F.col("xmax") >= xmax) & (F.col("ymax") >= ymax))


def edge_lines(edges: DataFrame, nodes: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Edges (u, v, geometry) with `line`: their own geometry, or the straight line between their nodes (node, x, y)."""
    end = lambda n: nodes.select(F.col("node").alias(n), F.struct("x", "y").alias(f"_{n}"))
    return edges.join(end("u"), "u").join(end("v"), "v").withColumn("line", F.coalesce(geometry, F.array("_u", "_v"))).drop("_u", "_v")


def reproject_nearest(cells: DataFrame, target: DataFrame, inverse, x0: float, y0: float, size: float, value: str) -> DataFrame:
    """target cells (cell_id, x, y) with the value of the source raster's cell nearest to their centre: `inverse` takes a
    target's (x, y) to the source's coordinates, and the source's (col, row) from its corner is an equi-join."""
    column = lambda v, o: F.floor((v - o) / size).cast("long")
    x, y = inverse(F.col("x"), F.col("y"))
    source = cells.select(column(F.col("x"), x0).alias("_col"), column(F.col("y"), y0).alias("_row"), value)
    return target.withColumns({"_col": column(x, x0), "_row": column(y, y0)}).join(source, ["_col", "_row"], "left").drop("_col", "_row")


def class_colours(pixels: DataFrame, cls: str = "cls") -> DataFrame:
    """pixels with the colour (r, g, b) of their class; classes off the palette drop out."""
    palette = pixels.sparkSession.createDataFrame(list(masks.PALETTE), f"{cls} int, r int, g int, b int")
    return pixels.join(F.broadcast(palette), cls)  # one row a class of the fixed palette
