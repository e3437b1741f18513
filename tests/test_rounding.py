"""Texts of numbers and rounded views, against DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from verdantspark.functions import text
from verdantspark.sources.adapters import VIEWS, view

NUMBERS = [0.285, 0.575, 1.005, 0.125, -0.285, -0.001, 0.0, 99.995, 9999999.994, 12345678.5, 123456789012345.67, 1.5e16, 1e22, 1e308, float("nan"), float("inf"), float("-inf"), None]


def in_sql(sql):
    con = duckdb.connect()
    con.execute("create table numbers (i integer, v double)")
    con.executemany("insert into numbers values (?, ?)", list(enumerate(NUMBERS)))
    return [r[0] for r in con.execute(f"select {sql} from numbers order by i").fetchall()]


def in_spark(spark, column):
    return [r.v for r in spark.createDataFrame(list(enumerate(NUMBERS)), "i int, v double").orderBy("i").select(column.alias("v")).collect()]


def test_marker_label_rounds_as_sql(spark):
    assert in_spark(spark, text.marker_label(F.lit(7), F.col("v"))) == in_sql("'ID: ' || 7 || ' / GVI: ' || coalesce(cast(round(v, 2) as varchar), 'none')")


def test_percentage_text_rounds_as_sql(spark):
    assert in_spark(spark, text.percentage_text(F.col("v"))) == in_sql("cast(round(v, 2) as varchar) || '%'")


@pytest.mark.parametrize("key,price", [(2100, 72572.5), (13790, 72847.5), (59580, 31852.5), (96740, 243837.5)])
def test_view_rounds_as_sql(spark, tmp_path, key, price):
    con = duckdb.connect()
    con.execute(f"create table orders as select {key}::bigint as o_orderkey, 1::bigint as o_custkey, 'F' as o_orderstatus, {price}e0 as o_totalprice")
    con.execute(f"copy orders to '{tmp_path}/orders.parquet' (format parquet)")
    assert view(spark, str(tmp_path), "v_gvi").first().mean_ndvi == con.execute(f"select mean_ndvi from ({VIEWS['v_gvi']})").fetchall()[0][0]
