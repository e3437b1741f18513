"""Sources and sinks: result CSVs, appends that can be resumed, nulls, GeoPackage layers."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The result rows' columns.
GVI_COLUMNS = ("id", "x", "y", "GVI", "is_panoramic", "missing", "error")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in every floating-point column: Spark's averages would be NaN otherwise."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema.fields])


def csv_union(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All result CSVs as strings, with their file's name; headers are the columns of GVI_COLUMNS."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in GVI_COLUMNS])
    return spark.read.schema(schema).option("header", True).csv(paths).withColumn("file", F.input_file_name())


def csv_row_validation(rows: DataFrame) -> DataFrame:
    """Rows whose x and y are numbers or null, as numbers."""
    ok = lambda c: F.col(c).isNull() | F.expr(f"try_cast({c} as double)").isNotNull()
    return rows.filter(ok("x") & ok("y")).withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("x", "y")})


def append_new(df: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose key is not in the CSV folder yet; a run that was stopped goes on where it was. Returns how many."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df = df.join(spark.read.option("header", True).csv(path).select(F.col(key).cast(df.schema[key].dataType)), key, "left_anti")
    df = df.persist()
    n = df.count()
    if n:
        df.write.mode("append").option("header", True).csv(path)
    df.unpersist()
    return n


class GpkgReader(DataSourceReader):
    """Reads a layer's rows in ranges of their row numbers."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path, self.layer = schema, options["path"], options["layer"]
        self.parts = int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.layer}"').fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.parts)
        return [InputPartition((a, min(a + step, high + 1))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [f.name for f in self.schema.fields]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'select {", ".join(chr(34) + n + chr(34) for n in names)} from "{self.layer}" where rowid >= ? and rowid < ?', partition.value):
                yield tuple(strip_header(v) if isinstance(v, bytes) else v for v in row)


class GpkgSource(DataSource):
    """Format "gpkg": options path and layer; geometries are WKB. Register with spark.dataSource.register(GpkgSource)."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> T.StructType:
        kinds = {"INTEGER": T.LongType(), "MEDIUMINT": T.LongType(), "INT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TEXT": T.StringType()}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            cols = db.execute(f'pragma table_info("{self.options["layer"]}")').fetchall()
        return T.StructType([T.StructField(c[1], kinds.get(c[2].upper(), T.BinaryType() if "(" not in c[2] else T.StringType())) for c in cols])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GpkgReader(schema, dict(self.options))


def strip_header(blob: bytes) -> bytes:
    """The WKB in a GeoPackage geometry; other blobs are as they are."""
    if blob[:2] != b"GP":
        return blob
    return blob[8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7] :]


def wkb_points(wkb: bytes) -> list[tuple[float, float]]:
    """The coordinates of a WKB point, line or polygon shell, in order."""
    order = "<" if wkb[0] else ">"
    kind = struct.unpack_from(f"{order}I", wkb, 1)[0]
    if kind == 1:
        return [struct.unpack_from(f"{order}2d", wkb, 5)]
    at = 5 if kind == 2 else 9 if kind == 3 else None
    if at is None:
        raise ValueError(f"not a point, line or polygon: {kind}")
    n = struct.unpack_from(f"{order}I", wkb, at)[0]
    return [struct.unpack_from(f"{order}2d", wkb, at + 4 + 16 * i) for i in range(n)]
