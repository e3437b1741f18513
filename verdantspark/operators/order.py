"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import work_dir, write_layer


def row_index(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """df with its 0-based position in the given order, which should be total.

    Rows are range partitioned, sorted and written once; each partition's count gives the others' offsets, so only one row per
    partition meets in one place. The sorted rows are a table in the shared folder: range borders are sampled, and both uses
    must see the same ones, also after an executor was lost.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = write_layer(placed, work_dir(spark))
    before = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")  # one row a partition


def range_slice(df: DataFrame, order: str, begin: int | None, end: int | None) -> DataFrame:
    """Rows begin to end (exclusive) in order; all rows unless both are given."""
    return df if begin is None or end is None else row_index(df, order).filter((F.col("row_index") >= begin) & (F.col("row_index") < end)).drop("row_index")


def kfold_assign(df: DataFrame, order: str, k: int = 5) -> DataFrame:
    """df with contiguous folds 1..k; the first n mod k folds have one row more."""
    n = df.count()
    size, more = divmod(n, k)
    i = F.col("row_index")
    fold = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / max(size, 1))) + 1
    return row_index(df, order).withColumn("fold", fold.cast("int")).drop("row_index")


#: Rows that a sample may have to be sent to all tasks; a larger one is joined.
SENT_SAMPLE = 100_000


def sample_flag(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """df with a flag on n rows, those with the smallest MD5 of their key and the seed; ties to the smaller key."""
    chance = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    picked = df.select(key).orderBy(chance, key).limit(n).withColumn("save_sample", F.lit(True))
    return df.join(F.broadcast(picked) if n <= SENT_SAMPLE else picked, key, "left").withColumn("save_sample", F.coalesce("save_sample", F.lit(False)))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; minima are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    return df.groupBy(*keys).agg(least).select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
