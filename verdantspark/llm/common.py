"""What the corpus operators share: the documents' contract, durable cuts and Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that carries texts; Spark's own default of 10,000 may be a gigabyte of long ones.
TEXT_ROWS = 500
#: Bytes of text that one numpy pass works on; temporaries are about 30 times as large.
SLICE_BYTES = 2 << 20


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """The columns an operator reads, typed; other columns, whatever their names, stay out."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by TEXT_ROWS, so that neither the JVM nor Python holds very many texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, TEXT_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session whose executors are the
    driver itself (tests) gets a new one; any other raises, as a folder of one machine would not be shared."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="verdantspark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df into the shared folder and read it back: later jobs neither recompute it nor depend on one executor.

    With `narrow`, for rows much smaller than those that the tasks read, partitions are first merged to a good file size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if narrow else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until none is taken, whatever its case."""
    known, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in known:
            n = f"_{n}"
        known.add(n.lower())
        out.append(n)
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by cut(), once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most `limit` bytes of text; a longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    lengths = batch.column(column).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + n + 1]
    a = 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield batch.slice(a, b - a)
        a = b


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes and row offsets, without copies where Arrow allows; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def append_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]] | None, fields: list[T.StructField], setup: Callable[[], Callable] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """df with more columns, computed batch by batch in Arrow; rows keep their partition, so nothing is shuffled.

    fn gets a record batch with all columns of df; setup, if given, is called once a task and makes fn.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in fields]
    added = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup() if setup else fn
        for batch in batches:
            for part in slices(batch, limit=limit):
                new = work(part)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, type=t) if not isinstance(c, pa.Array) else c for c, t in zip(new, added.types, strict=True)]], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)
