"""Spatial joins as equi-joins on grid cells, zonal statistics, cover shares and polygon clipping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_buffer
from ..sources.sinks import work_dir, write_layer


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (x, y) and right (rx, ry) rows in the same or neighbouring cells of side `radius`: each left row probes
    nine cells of one right row each, and the join is an equi-join on the cell."""
    probe = left.withColumn("_dx", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_dy", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    probe = probe.withColumns({"_cx": cell(F.col("x"), radius) + F.col("_dx"), "_cy": cell(F.col("y"), radius) + F.col("_dy")}).drop("_dx", "_dy")
    return probe.join(right.withColumns({"_cx": cell(F.col("rx"), radius), "_cy": cell(F.col("ry"), radius)}), ["_cx", "_cy"]).drop("_cx", "_cy")


def nearest_image_join(points: DataFrame, images: DataFrame, max_distance: float = 50.0) -> DataFrame:
    """Points (id, x, y, ...) with the nearest image (image_id, x, y, is_pano) closer than half of max_distance: distance,
    image_id ("" for none) and is_panoramic. Ties go to the smallest image_id."""
    radius = max_distance / 2
    right = images.select("image_id", F.col("x").alias("rx"), F.col("y").alias("ry"), "is_pano")
    d2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    best = near_pairs(points.select("id", "x", "y"), right, radius).withColumn("_d2", d2).filter(F.col("_d2") < radius * radius).groupBy("id").agg(F.min(F.struct("_d2", "image_id", "is_pano")).alias("_b"))
    return points.join(best, "id", "left").select(*points.columns, F.sqrt("_b._d2").alias("distance"), F.coalesce(F.col("_b.image_id").cast("string"), F.lit("")).alias("image_id"), F.coalesce(F.col("_b.is_pano"), F.lit(False)).alias("is_panoramic"))


class Tiles:
    """Places in tiles of about the same number, with each tile's bounds; a search reads only tiles that may hold the nearest."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.y = x, y
        side = max(1, round(len(x) ** 0.25))
        strips = np.array_split(np.argsort(x, kind="stable"), side)
        tiles = [np.sort(t) for s in strips for t in np.array_split(s[np.argsort(y[s], kind="stable")], side) if len(t)]
        self.grid = np.full((len(tiles), max(map(len, tiles), default=0)), -1)
        for i, t in enumerate(tiles):
            self.grid[i, : len(t)] = t
        self.bounds = [np.array([f(v[t]) for t in tiles]) for v in (x, y) for f in (np.min, np.max)]

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest place to each of (x, y), the smaller at a tie, and the squared distance."""
        x0, x1, y0, y1 = self.bounds
        bound = (x[:, None] - np.clip(x[:, None], x0, x1)) ** 2 + (y[:, None] - np.clip(y[:, None], y0, y1)) ** 2
        order = np.argsort(bound, axis=1)
        best, which, open_ = np.full(len(x), np.inf), np.full(len(x), len(self.x)), np.arange(len(x))
        for r in range(len(self.grid)):
            open_ = open_[bound[open_, order[open_, r]] <= best[open_]]
            if not len(open_):
                break
            g = self.grid[order[open_, r]]
            d2 = np.where(g < 0, np.inf, (x[open_, None] - self.x[g]) ** 2 + (y[open_, None] - self.y[g]) ** 2)
            k = d2.argmin(1)
            d2, g = d2[np.arange(len(k)), k], g[np.arange(len(k)), k]
            closer = (d2 < best[open_]) | ((d2 == best[open_]) & (g < which[open_]))
            best[open_[closer]], which[open_[closer]] = d2[closer], g[closer]
        return which, best

    def search(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """nearest() of any number of places, so many at a time that temporaries stay small."""
        step = max(1, 2_000_000 // max(1, *self.grid.shape))
        found = [self.nearest(x[a : a + step], y[a : a + step]) for a in range(0, len(x), step)]
        return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0))


class Plane:
    """The plane in tiles: cut in halves of the given places, each half across its longer side, until a tile has `most` of them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, most: int) -> None:
        places, axis, at, after = np.array([x, y]), [0], [0.0], [-1]
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, rows = todo.pop()
            if len(rows) <= most:
                continue
            v = places[:, rows]
            axis[k] = int(np.ptp(v[1]) > np.ptp(v[0]))
            own = np.sort(v[axis[k]])
            if own[0] == own[-1]:
                continue
            at[k] = max(own[len(own) // 2], own[np.searchsorted(own, own[0], "right")])  # both sides have some
            high, after[k] = v[axis[k]] >= at[k], len(axis)
            todo += [(len(axis), rows[~high]), (len(axis) + 1, rows[high])]
            axis, at, after = [*axis, 0, 0], [*at, 0.0, 0.0], [*after, -1, -1]
        self.axis, self.at, self.after = np.array(axis), np.array(at), np.array(after)

    def tile(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of the tile that each of (x, y) lies in."""
        k = np.zeros(len(x), np.int64)
        while (inner := self.after[k] >= 0).any():
            k = np.where(inner, self.after[k] + (np.where(self.axis[k], y, x) >= self.at[k]), k)
        return k


#: Nodes that are sent to all tasks at most; with more, points and nodes meet by tile.
SENT_NODES = 20_000
#: Sent nodes in a tile, at most.
TILE_NODES = 32
#: Points that are searched in a tile by one task, at most about; more are cut into pieces.
PIECE_POINTS = 100_000


def _xy(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch[c].to_numpy(zero_copy_only=False) for c in ("x", "y"))


def nearest_node(points: DataFrame, nodes: DataFrame, start: float) -> DataFrame:
    """id, node and distance of each point's nearest node, however far; ties go to the smallest node. Of points that repeat an id,
    the one nearest to a node counts. Points without both coordinates and nodes without finite ones drop out; without nodes
    there are no rows.

    Up to SENT_NODES places of nodes, a counted bound, are sent to the points and searched tile by tile. Of more, so many are sent,
    picked by hash: the nearest of them bounds the distance, and a point goes to each tile of the plane whose nodes' box is no
    farther than that. A tile has about TILE_NODES in SENT_NODES of all nodes; the points of a full tile are cut into pieces that
    get its nodes each. It takes one round, whatever the distances; `start`, the first radius of an earlier search in rings,
    changes nothing.
    """
    spark, kind = points.sparkSession, points.schema["id"].dataType.simpleString()
    rows = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).na.drop(subset=["x", "y"])
    places = nodes.select(F.col("node").cast("long"), F.col("x").cast("double"), F.col("y").cast("double")).na.drop()
    places = places.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).groupBy("x", "y").agg(F.min("node").alias("node"))
    sent = places.orderBy(F.xxhash64("x", "y"), "x", "y").limit(SENT_NODES + 1).toPandas()
    every = len(sent) <= SENT_NODES
    sent = sent[:SENT_NODES].sort_values("node")
    ids, tiles = sent["node"].to_numpy(), Tiles(sent["x"].to_numpy(), sent["y"].to_numpy())
    nearest = lambda met: met.groupBy("id").agg(F.min(F.struct("d2", "node")).alias("_b")).select("id", F.col("_b.node").alias("node"), F.sqrt("_b.d2").alias("distance"))

    if every:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches if len(ids) else ():
                k, d2 = tiles.search(*_xy(b))
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(ids[k]), pa.array(d2)], names=["id", "node", "d2"])

        return nearest(rows.mapInArrow(run, f"id {kind}, node long, d2 double"))

    plane = Plane(tiles.x, tiles.y, TILE_NODES)

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(plane.tile(*_xy(b))), *b.columns], names=["tile", *b.schema.names])

    homes = write_layer(places.select("node", "x", "y").mapInArrow(tiled, "tile long, node long, x double, y double"), work_dir(spark))
    boxes = homes.groupBy("tile").agg(*(f(c) for c in "xy" for f in (F.min, F.max))).toPandas().to_numpy(np.float64)  # at most SENT_NODES rows
    numbers, (x0, x1, y0, y1) = boxes[:, 0].astype(np.int64), boxes[:, 1:].T

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 2_000_000 // len(numbers))
        for b in batches:
            for a in range(0, b.num_rows, step):
                part = b.slice(a, step)
                x, y = _xy(part)
                bound = (x[:, None] - np.clip(x[:, None], x0, x1)) ** 2 + (y[:, None] - np.clip(y[:, None], y0, y1)) ** 2
                i, t = np.nonzero(bound <= tiles.search(x, y)[1][:, None])
                yield pa.RecordBatch.from_arrays([pa.array(numbers[t]), *part.take(pa.array(i)).columns], names=["tile", "id", "x", "y"])

    asked = write_layer(rows.mapInArrow(reached, f"tile long, id {kind}, x double, y double"), work_dir(spark))
    pieces = asked.groupBy("tile").agg(F.ceil(F.count("*") / PIECE_POINTS).alias("n"))
    here = asked.join(F.broadcast(pieces), "tile").select("tile", F.pmod(F.xxhash64("id", "x", "y"), F.col("n")).alias("piece"), F.lit(True).alias("asks"), "id", F.lit(None).cast("long").alias("node"), "x", "y")
    there = homes.join(F.broadcast(pieces), "tile").select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("piece"), F.lit(False).alias("asks"), F.lit(None).cast(kind).alias("id"), "node", "x", "y")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, own, names = None, [], None, np.zeros(0, np.int64)
        for b in batches:
            tile, piece = (b[c].to_numpy() for c in ("tile", "piece"))
            asks = b["asks"].to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (piece[1:] != piece[:-1]) | (asks[1:] != asks[:-1]))[: len(tile)])
            for a, e in zip(first.tolist(), [*first[1:].tolist(), len(tile)], strict=False):
                part = b.slice(a, e - a)
                if last != (key := (tile[a], piece[a])):
                    last, held, own = key, [], None
                if not asks[a]:
                    held.append((part["node"].to_numpy(), *_xy(part)))
                    continue
                if own is None:
                    names, x, y = (np.concatenate(v) for v in zip(*held, strict=True))
                    own, held = Tiles(x, y), []
                k, d2 = own.search(*_xy(part))
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(names[k]), pa.array(d2)], names=["id", "node", "d2"])

    met = here.unionByName(there).repartition("tile", "piece").sortWithinPartitions("tile", "piece", "asks", "node")
    return nearest(met.mapInArrow(search, f"id {kind}, node long, d2 double"))


def bbox_filter(points: DataFrame, extent: DataFrame) -> DataFrame:
    """Points inside the bounds of extent (x, y), borders included; the bounds are one row."""
    box = extent.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    return points.join(F.broadcast(box), (F.col("x") >= F.col("_x0")) & (F.col("x") <= F.col("_x1")) & (F.col("y") >= F.col("_y0")) & (F.col("y") <= F.col("_y1"))).select(*points.columns)


def zonal_join(points: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (id, x, y) and raster cells (x, y, ...) whose centre lies in the point's buffer polygon."""
    right = cells.withColumnsRenamed({"x": "rx", "y": "ry"})
    return near_pairs(points.select("id", "x", "y"), right, radius).filter(in_buffer(F.col("rx") - F.col("x"), F.col("ry") - F.col("y"), radius)).drop("x", "y")


def zonal_mean_ndvi(points: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """id and the mean of the cells' ndvi, negative values as 0, over each point's buffer; null without cells."""
    v = F.when(F.col("ndvi").isNotNull(), F.greatest("ndvi", F.lit(0.0)))
    means = zonal_join(points, cells, radius).groupBy("id").agg(F.avg(v).alias("_m"))
    return points.select("id").join(means, "id", "left").select("id", F.round("_m", 3).alias("mean_ndvi"))


def landcover_percentages(points: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """id, landcover and the share of the buffer's cells that have it, in percent; long form."""
    counts = zonal_join(points, cells, radius).groupBy("id", "landcover").count()
    total = counts.groupBy("id").agg(F.sum("count").alias("_n"))
    return counts.join(total, "id").select("id", "landcover", F.round(F.col("count") / F.col("_n") * 100, 3).alias("percentage"))


def landcover_wide(long: DataFrame, classes: list[str]) -> DataFrame:
    """A column per given class, 0 where a buffer has none of it."""
    return long.groupBy("id").pivot("landcover", classes).agg(F.first("percentage")).na.fill(0.0, classes)


def box_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of rows with overlapping boxes (xmin, ymin, xmax, ymax; right ones with the prefix r): each box covers grid
    cells, boxes meet in cells, and the cell of the overlap's lower left corner tells one meeting from its repeats."""
    spread = lambda df, p: df.withColumn("_cx", F.explode(F.sequence(cell(F.col(f"{p}xmin"), size), cell(F.col(f"{p}xmax"), size)))).withColumn("_cy", F.explode(F.sequence(cell(F.col(f"{p}ymin"), size), cell(F.col(f"{p}ymax"), size))))
    met = spread(left, "").join(spread(right, "r"), ["_cx", "_cy"])
    met = met.filter((F.col("xmin") <= F.col("rxmax")) & (F.col("rxmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("rymax")) & (F.col("rymin") <= F.col("ymax")))
    corner = (F.col("_cx") == cell(F.greatest("xmin", "rxmin"), size)) & (F.col("_cy") == cell(F.greatest("ymin", "rymin"), size))
    return met.filter(corner).drop("_cx", "_cy")


def triangles(ring: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """A ring as signed triangles around its first corner."""
    out = []
    for i in range(1, len(ring) - 1):
        t = np.array([ring[0], ring[i], ring[i + 1]])
        a = (t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])
        if a:
            out.append((1.0, t) if a > 0 else (-1.0, t[::-1]))
    return out


def convex_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection of two convex rings, both counter-clockwise."""
    points = [tuple(p) for p in a]
    for i in range(len(b)):
        (x0, y0), (x1, y1) = b[i], b[(i + 1) % len(b)]
        side = [(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) for x, y in points]
        out = []
        for j, (p, s) in enumerate(zip(points, side, strict=True)):
            q, t = points[j - 1], side[j - 1]
            if (s >= 0) != (t >= 0):
                f = t / (t - s)
                out.append((q[0] + f * (p[0] - q[0]), q[1] + f * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
        points = out
        if len(points) < 3:
            return 0.0
    return abs(sum(points[i - 1][0] * p[1] - p[0] * points[i - 1][1] for i, p in enumerate(points))) / 2


def polygon_area(rings: list[np.ndarray]) -> float:
    """Area of a polygon: its shell less its holes."""
    areas = [abs(sum(s * abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) / 2 for s, t in triangles(r))) for r in rings]
    return areas[0] - sum(areas[1:]) if areas else 0.0


def clip_area(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Area of the intersection of two polygons (shell, then holes; simple rings of either direction)."""

    def fans(rings):
        out = []
        for k, ring in enumerate(rings):
            own = triangles(ring)
            turn = 1.0 if sum(s * abs(np.linalg.det(np.column_stack([t, np.ones(3)]))) for s, t in own) > 0 else -1.0
            out += [(s * turn * (-1.0 if k else 1.0), t) for s, t in own]
        return out

    return sum(s * t * convex_overlap(p, q) for s, p in fans(a) for t, q in fans(b))


def polygon_clip_join(areas: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """id, poly_id and overlap for areas (id, rings, box) and polygons (poly_id, rings, box) that overlap.

    Boxes meet by grid cells; the exact area is computed batch by batch where the pair is.
    """
    right = polygons.select("poly_id", F.col("rings").alias("rrings"), *[F.col(c).alias(f"r{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    pairs = box_pairs(areas, right, size).select("id", "poly_id", "rings", "rrings")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = lambda v: [np.array([(p["x"], p["y"]) for p in r]) for r in v]
        for b in batches:
            got = [clip_area(rings(x), rings(y)) for x, y in zip(b["rings"].to_pylist(), b["rrings"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], b["poly_id"], pa.array(got, pa.float64())], names=["id", "poly_id", "overlap"])

    schema = f"id {areas.schema['id'].dataType.simpleString()}, poly_id {polygons.schema['poly_id'].dataType.simpleString()}, overlap double"
    return pairs.mapInArrow(run, schema)


def cover_percentage(areas: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """id and the polygons' share of each area (id, rings, box, area) in percent; overlapping polygons add up."""
    cover = polygon_clip_join(areas, polygons, size).groupBy("id").agg(F.sum("overlap").alias("_o"))
    return areas.select("id", "area").join(cover, "id", "left").select("id", F.round(F.coalesce("_o", F.lit(0.0)) / F.col("area") * 100, 2).alias("percentage"))


def box_rings(df: DataFrame) -> DataFrame:
    """Boxes as polygons of one ring, with their area."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return df.withColumn("rings", F.array(F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax")))).withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))


#: Tags of areas that count as parks.
PARK_LANDUSE = ("allotments", "forest", "greenfield", "village_green")
PARK_LEISURE = ("garden", "fitness_station", "nature_reserve", "park", "playground")
PARK_NATURAL = ("grassland",)


def park_tag_filter(features: DataFrame) -> DataFrame:
    """Polygonal features (landuse, leisure, natural, geom_type) that count as parks."""
    tagged = F.col("landuse").isin(*PARK_LANDUSE) | F.col("leisure").isin(*PARK_LEISURE) | F.col("natural").isin(*PARK_NATURAL)
    return features.filter(F.coalesce(tagged, F.lit(False)) & F.col("geom_type").isin("Polygon", "MultiPolygon"))


def scene_selection(scenes: DataFrame, begin: str, end: str, xmin: float, xmax: float, max_cloud: float = 20.0) -> DataFrame:
    """The least cloudy scene (captured_at, cloud_cover, xmin, xmax, scene_id) of a time span that contains the area; ties to
    the smallest id."""
    fits = (F.col("captured_at") >= F.lit(begin).cast("timestamp")) & (F.col("captured_at") <= F.lit(end).cast("timestamp")) & (F.col("cloud_cover") < max_cloud) & (F.col("xmin") <= xmin) & (F.col("xmax") >= xmax)
    return scenes.filter(fits).orderBy("cloud_cover", "scene_id").limit(1)
