"""Reports: per-street greenery, missing images, availability and usability scores, colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def street_gvi_rollup(roads: DataFrame, points: DataFrame, gvi: DataFrame) -> DataFrame:
    """roads with avg_gvi, null_points_count and total_points of their points; null for roads without points."""
    met = points.select("id", "road_index").join(gvi.select("id", "gvi"), "id").join(roads.select(F.col("road_id").alias("road_index")), "road_index")
    stats = met.groupBy("road_index").agg(F.avg("gvi").alias("avg_gvi"), F.count_if(F.col("gvi").isNull()).alias("null_points_count"), F.count("*").alias("total_points"))
    return roads.join(stats.withColumnRenamed("road_index", "road_id"), "road_id", "left")


def with_roads(roads: DataFrame, points: DataFrame, gvi: DataFrame) -> DataFrame:
    """Points with their gvi and their road's length, highway and city: what the metrics are computed from."""
    met = points.select("id", "road_index", "image_id", "is_panoramic").join(gvi.select("id", "gvi"), "id")
    return met.join(roads.withColumnRenamed("road_id", "road_index"), "road_index")


def unavailable_by_highway(rows: DataFrame, corrected: bool = False) -> DataFrame:
    """Per highway, total_null and its proportion of all rows. Literally, rows with any image_id, the empty one too, are
    counted; corrected counts those without an image."""
    none = F.count_if(F.col("image_id") == "") if corrected else F.count("image_id")
    per = rows.groupBy("highway").agg(none.alias("total_null"), F.count("*").alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"))
    return per.join(F.broadcast(total)).select("highway", "total_null", F.try_divide("total_null", "_all").alias("proportion"))


def top_highways_missing(rows: DataFrame, k: int = 5) -> DataFrame:
    """highway, city, total_null of the k highways with most, by total over cities; ties to the first name."""
    per = rows.groupBy("highway", "city").agg(F.count("image_id").alias("total_null"), F.count("*").alias("_n"))
    total = per.agg(F.sum("_n").alias("_all"))
    top = per.groupBy("highway").agg(F.sum("total_null").alias("_t")).orderBy(F.desc("_t"), "highway").limit(k).select("highway")
    return per.join(F.broadcast(top), "highway", "left_semi").join(F.broadcast(total)).select("highway", "city", "total_null", F.try_divide("total_null", "_all").alias("proportion"))


def missing_image_metrics(rows: DataFrame) -> DataFrame:
    """One row: images unavailable, unsuitable ones, all points without gvi, their proportion, points."""
    none, empty = F.col("gvi").isNull(), F.col("image_id") == ""
    return rows.agg(F.count_if(none & empty).alias("unavailable"), F.count_if(none & ~empty).alias("unsuitable"), F.count_if(none).alias("total_null"), F.try_divide(F.count_if(none), F.count("*")).alias("proportion"), F.count("*").alias("total"))


def panoramic_metrics(rows: DataFrame) -> DataFrame:
    """One row: panoramic images, all images, and the proportion."""
    has = F.col("image_id") != ""
    return rows.agg(F.count_if("is_panoramic").alias("panoramic"), F.count_if(has).alias("images"), F.try_divide(F.count_if("is_panoramic"), F.count_if(has)).alias("proportion"))


def _length() -> Column:
    """The logarithm of the rows' summed length in km; null where there is none."""
    km = F.sum("length") / 1000
    return F.when(km > 0, F.ln(km))


def availability_score(rows: DataFrame) -> DataFrame:
    """One row: the share of points with an image, and that share times the log of the summed length. Each point adds its
    road's length."""
    share = F.try_divide(F.count_if(F.col("image_id") != ""), F.count("*"))
    return rows.agg(share.alias("score"), (share * _length()).alias("adjusted"))


def usability_score(rows: DataFrame) -> DataFrame:
    """One row: the share of images with a gvi, and that share times the log of the summed length of all rows."""
    has = F.col("image_id") != ""
    share = F.try_divide(F.count_if(has & F.col("gvi").isNotNull()), F.count_if(has))
    return rows.agg(share.alias("score"), (share * _length()).alias("adjusted"))


def all_scores(rows: DataFrame) -> DataFrame:
    """Every metric above in one pass over the rows."""
    none, has = F.col("gvi").isNull(), F.col("image_id") != ""
    a, u = F.try_divide(F.count_if(has), F.count("*")), F.try_divide(F.count_if(has & ~none), F.count_if(has))
    return rows.agg(F.count_if(none & ~has).alias("unavailable"), F.count_if(none & has).alias("unsuitable"), F.count_if(none).alias("total_null"), F.count("*").alias("total"), F.count_if("is_panoramic").alias("panoramic"), a.alias("availability"), (a * _length()).alias("adjusted_availability"), u.alias("usability"), (u * _length()).alias("adjusted_usability"))


def gvi_colour_scale(gvi: DataFrame) -> DataFrame:
    """gvi rows with their place between the smallest and the largest value, and colour "red" where there is none."""
    ends = gvi.agg(F.min("gvi").alias("_lo"), F.max("gvi").alias("_hi"))
    scaled = F.try_divide(F.col("gvi") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return gvi.join(F.broadcast(ends)).select(*gvi.columns, scaled.alias("scaled"), F.when(F.col("gvi").isNull(), "red").otherwise("scale").alias("colour"))


def validate_exposure(geometry: str, polygon_type: str | None, buffer_type: str | None, buffer_dist: float | None, trip_time: float | None, speed: float | None, network_type: str | None) -> None:
    """The rules for an exposure's arguments, once for all exposures."""
    if geometry not in ("Point", "Polygon"):
        raise ValueError("geometries must all be points or all be polygons")
    if geometry == "Polygon" and polygon_type not in ("neighbourhood", "house"):
        raise ValueError("polygon_type must be neighbourhood or house")
    if geometry == "Point" or polygon_type == "house":
        if buffer_type not in ("euclidean", "network"):
            raise ValueError("buffer_type must be euclidean or network")
    elif buffer_type not in ("euclidean", "network", None):
        raise ValueError("buffer_type must be euclidean, network or none")
    if buffer_type == "euclidean" and (buffer_dist is None or buffer_dist <= 0):
        raise ValueError("a euclidean buffer needs a positive distance")
    if buffer_type == "network":
        if (buffer_dist is None) == (trip_time is None or speed is None):
            raise ValueError("a network buffer needs a distance, or a trip time and a speed, not both")
        if network_type not in ("walk", "bike", "drive", "all"):
            raise ValueError("network_type must be walk, bike, drive or all")
