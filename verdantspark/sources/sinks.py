"""Sinks: layers of roads, points, results and exposures, CSVs, tables that are built once; images as bytes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an exposure's output adds to its input's name.
EXPOSURES = {"ndvi": "ndvi_added", "landcover": "LCperc_added", "canopy": "CanopyPerc_added", "park": "ParkPerc_added"}
#: The merged CSV beside its parts, which a later union must not read again.
MERGED = "gvi-points.csv"


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a local one only where the driver executes."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verdantspark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_layer(df: DataFrame, path: str) -> DataFrame:
    """Write a layer, replacing it, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_roads(roads: DataFrame, path: str) -> DataFrame:
    """The roads' layer: index and highway as text, length as a number, and the geometry, if there is one."""
    kinds = {"index": "string", "geometry": None, "length": "double", "highway": "string"}
    return write_layer(roads.select(*[F.col(c).cast(k) if k else F.col(c) for c, k in kinds.items() if c in roads.columns]), path)


def write_exposure(result: DataFrame, folder: str, source: str, kind: str) -> str:
    """Write an exposure beside the name of the file that its places came from; returns the path."""
    name = re.sub(r"\.[^.]*$", "", source.rsplit("/", 1)[-1])
    path = f"{folder.rstrip('/')}/{name}_{EXPOSURES[kind]}"
    write_layer(result, path)
    return path


def overwrite_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV folder, with a header and no index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def built_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; built and written first if it isn't there. A folder without a finished write counts as absent."""
    return spark.read.parquet(path) if exists(spark, f"{path.rstrip('/')}/_SUCCESS") else write_layer(build(), path)


def result_csvs(spark: SparkSession, folder: str) -> list[str]:
    """CSVs of a folder, in order, without the merged one that an earlier union has left there."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.csv")
    status = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    return sorted(str(s.getPath()) for s in (status or ()) if s.getPath().getName() != MERGED)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image files as image_id, their name without its ending, and content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("image_id"), "content")
