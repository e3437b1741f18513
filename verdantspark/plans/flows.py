"""The engine's flows from sources to reports, each one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import web_mercator_tile
from ..operators import images, metrics, models, roads, spatial


def sample_points(lines: DataFrame, spacing: int = 50) -> DataFrame:
    """Numbered points (id, road_index, x, y) along lines (seq, road_index, line), one per place."""
    points = roads.point_dedup(roads.sample_points_on_lines(lines, spacing), ["seq", "d"])
    return roads.number_points(points, "seq", "d").select("id", "road_index", "x", "y")


def points_with_images(points: DataFrame, features: DataFrame, max_distance: float = 50.0, zoom: int = 14) -> DataFrame:
    """points (id, x, y, lng, lat, ...) with their tile and nearest image among features (image_id, x, y, lng, lat, is_pano)
    of tiles that hold a point."""
    seen = roads.tile_semi_join(features, points, zoom)
    tiled = points.withColumn("tile", web_mercator_tile(F.col("lng"), F.col("lat"), zoom))
    return spatial.nearest_image_join(tiled, seen, max_distance)


def greenery(points: DataFrame, masks: DataFrame, cut_by_road_centres: bool = False) -> DataFrame:
    """Result rows (id, x, y, gvi, is_panoramic, missing, error) of points with images and the images' masks (image_id, mask)."""
    met = points.join(masks.select("image_id", "mask"), "image_id", "left")
    return points.select("id", "x", "y").join(images.gvi_for_images(met, cut_by_road_centres), "id")


def imputed(results: DataFrame, cells: DataFrame, distance: float = 50.0, smooth: bool = False) -> DataFrame:
    """Results inside the raster's bounds with mean_ndvi of half the distance around, and gvi filled where it is missing, by a
    line or by a spline model."""
    inside = spatial.bbox_filter(results, cells)
    known = inside.join(spatial.zonal_mean_ndvi(inside, cells, distance / 2), "id")
    return models.gam_impute(known) if smooth else models.ols_impute(known)


def report(streets: DataFrame, points: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The streets' roll-up, and one row of all scores."""
    return metrics.street_gvi_rollup(streets, points, results), metrics.all_scores(metrics.with_roads(streets, points, results))
