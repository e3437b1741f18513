"""Greenery of images from their class masks: road centres and the decision for each image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.masks import ROAD, VEGETATION, bottom_band_crop, columns_of, gvi_pixel_ratio, max_run_length, quad_crop, road_centre_crop, width, without_duplicates, wrap_widen


def find_peaks(v: np.ndarray, distance: int, prominence: float) -> list[int]:
    """Local maxima (the middle of a plateau), the higher first wherever two are closer than distance, then those that rise
    by prominence or more over the higher of the lowest points on the way to higher ground."""
    if distance < 1:
        raise ValueError("distance must be 1 or more")
    peaks, i, n = [], 1, len(v)
    while i < n - 1:
        if v[i] > v[i - 1]:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if j < n - 1 and v[j + 1] < v[i]:
                peaks.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    keep = np.ones(len(peaks), bool)
    for k in sorted(range(len(peaks)), key=lambda k: (v[peaks[k]], k), reverse=True):
        if keep[k]:
            for o in range(len(peaks)):
                if o != k and abs(peaks[o] - peaks[k]) < distance:
                    keep[o] = False
    out = []
    for p in (p for p, k in zip(peaks, keep, strict=True) if k):
        low = []
        for step in (-1, 1):
            i = least = p
            while 0 <= i < n and v[i] <= v[p]:
                least = i if v[i] < v[least] else least
                i += step
            low.append(v[least])
        if v[p] - max(low) >= prominence:
            out.append(p)
    return out


def road_centres(masks: DataFrame, mask: str = "mask", name: str = "centres") -> DataFrame:
    """masks with the columns of their road centres: peaks of the longest vertical run of road; null if the mask is too narrow
    for the peaks' distance, or empty."""
    profiled = masks.withColumn("_w", width(F.col(mask))).withColumn("_h", F.size(mask)).withColumn("_profile", F.when(F.col("_w") > 0, F.transform(columns_of(F.col(mask)), lambda c: max_run_length(c, ROAD))))
    schema = T.StructType([*profiled.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for p, w, h in zip(b["_profile"].to_pylist(), b["_w"].to_pylist(), b["_h"].to_pylist(), strict=True):
                distance = 2000 * (w or 0) // 5760
                got.append(find_peaks(np.array(p), distance, 100 * h // 2880) if p and distance >= 1 else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int32()))], names=[*b.schema.names, name])

    return profiled.mapInArrow(run, schema).drop("_w", "_h", "_profile")


def gvi_for_images(images: DataFrame, cut_by_road_centres: bool = False) -> DataFrame:
    """id, gvi, is_panoramic, missing and error for images (id, image_id, is_panoramic, mask).

    No image_id: missing. No readable mask, or one too narrow: missing, error. A panorama loses its bottom band; its greenery
    is that of four quarter windows, or of the windows around its road centres after widening, 0 without centres. A flat
    image counts as a whole if it shows a road centre, and is missing otherwise.
    """
    pano = F.col("is_panoramic")
    base = images.withColumn("_mask", F.when(pano, bottom_band_crop(F.col("mask"))).otherwise(F.col("mask")))
    if cut_by_road_centres:
        base = base.withColumn("_full", width(F.col("_mask"))).withColumn("_mask", F.when(pano, wrap_widen(F.col("_mask"))).otherwise(F.col("_mask")))
    found = road_centres(base, "_mask", "_centres")
    if cut_by_road_centres:
        crops = F.transform(without_duplicates(F.col("_centres"), F.col("_full")), lambda c: road_centre_crop(F.col("_mask"), c))
        bad = F.col("_centres").isNull()
    else:
        crops = quad_crop(F.col("_mask"))
        bad = F.when(pano, F.coalesce(width(F.col("_mask")), F.lit(0)) == 0).otherwise(F.col("_centres").isNull())
    none, error = F.col("image_id") == "", F.col("mask").isNull() | bad
    flat_ok = F.size("_centres") > 0
    value = F.when(none | error, None).when(pano, gvi_pixel_ratio(crops)).when(flat_ok, gvi_pixel_ratio(F.array("_mask")))
    return found.select("id", value.alias("gvi"), F.when(none | error, None).otherwise(pano).alias("is_panoramic"), (none | error | (~pano & ~F.coalesce(flat_ok, F.lit(False)))).alias("missing"), (~none & error).alias("error"))


def segment(images: DataFrame, segmenter) -> DataFrame:
    """images (…, content) with a mask by a pluggable function from bytes to rows of class numbers; null where it fails."""
    schema = T.StructType([*images.schema.fields, T.StructField("mask", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for content in b["content"].to_pylist():
                try:
                    got.append(segmenter(content))
                except Exception:  # noqa: BLE001  an unreadable image is an error row, not a failed job
                    got.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.list_(pa.int32())))], names=[*b.schema.names, "mask"])

    return images.mapInArrow(run, schema)


__all__ = ["ROAD", "VEGETATION", "find_peaks", "gvi_for_images", "road_centres", "segment"]
