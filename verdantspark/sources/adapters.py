"""Views that give the engine's input schemas from the star-schema tables; the SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Double literals have an exponent: without it they would be decimals.
VIEWS = {
    "v_nodes": "select c_custkey as n, (c_custkey % 10) * 130.0e0 as x, floor(c_custkey / 10e0) * 170.0e0 as y from customer",
    "v_edges": "select o_orderkey as seq, o_custkey as u, o_custkey - o_custkey % 100 + (o_custkey + o_orderkey % 7 + 97) % 100 as v, cast(row_number() over (partition by o_custkey, o_custkey - o_custkey % 100 + (o_custkey + o_orderkey % 7 + 97) % 100 order by o_orderkey) - 1 as bigint) as k, o_orderpriority as highway from orders",
    "v_roads": "select cast(c_custkey as varchar(20)) as road_id, abs(c_acctbal) + 1.0e0 as length, c_mktsegment as highway, n_name as city from customer join nation on c_nationkey = n_nationkey",
    "v_points": "select o_orderkey as id, cast(case when o_custkey % 10 = 0 then o_custkey + 1 else o_custkey end as varchar(20)) as road_index, case when o_orderstatus = 'P' then '' else cast(o_orderkey as varchar(20)) end as image_id, o_orderstatus = 'O' and o_orderkey % 3 = 0 as is_panoramic from orders",
    "v_gvi": "select o_orderkey as id, o_orderkey % 360 - 180e0 as x, o_orderkey % 160 - 80.0e0 as y, case when o_orderstatus = 'O' then (o_totalprice % 1000) / 1000.0e0 end as gvi, o_orderstatus <> 'O' as missing, o_orderkey % 50 = 0 and o_orderstatus = 'F' as error, round((o_totalprice % 1000) / 1000.0e0 * 0.6e0 + (o_orderkey % 10) / 33.0e0, 3) as mean_ndvi from orders",
    "v_images": "select event_id as image_id, user_id * 8.7e0 + value as x, (event_id % 1200) * 1.0e0 as y, event_type = 'view' as is_pano from events",
    "v_raster": "select p_partkey as cell_id, (p_partkey % 50 + 0.5e0) * 10 as x, (floor(p_partkey / 50e0) + 0.5e0) * 10 as y, (p_size - 15) / 35.0e0 as ndvi, p_type as landcover from part",
    "v_rects": "select s_suppkey as poly_id, s_suppkey % 10 * 50.0e0 as xmin, floor(s_suppkey / 10e0) * 40.0e0 as ymin, s_suppkey % 10 * 50.0e0 + 10 + s_nationkey as xmax, floor(s_suppkey / 10e0) * 40.0e0 + 10 + s_nationkey as ymax from supplier",
    "v_bands": "select l_orderkey, l_linenumber, l_extendedprice as nir, l_quantity * 1000 as red from lineitem",
    "v_scenes": "select event_id as scene_id, ts as captured_at, value as cloud_cover, user_id * 1.0e0 as xmin, user_id + 40.0e0 as xmax from events",
}
MASKS = {
    "spark": "select vec_id, transform(embedding, x -> cast(floor(abs(cast(x as double)) * 97) as int) % 19) as mask from embeddings",
    "duckdb": "select vec_id, list_transform(embedding, lambda x: cast(floor(abs(cast(x as double)) * 97) as integer) % 19) as mask from embeddings",
}


def spark_sql(name: str) -> str:
    """A view's SQL for Spark: its round() rounds the double itself as DuckDB does, not the decimal that stands for it."""
    import re

    sql = MASKS["spark"] if name == "v_masks" else VIEWS[name]
    return re.sub(r"\bround\((.+), (\d)\)( as \w+)", r"signum(\1) * round(abs(\1) * 1e\2, 0) / 1e\2\3", sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of the tables in sf_dir."""
    import re

    sql = spark_sql(name)
    for t in set(re.findall(r"\b(?:from|join) (\w+)", sql)):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names in front."""
    import re

    names = [n for n in (*VIEWS, "v_masks") if re.search(rf"\b{n}\b", sql)]
    heads = [f"{n} as ({MASKS['duckdb'] if n == 'v_masks' else VIEWS[n]})" for n in names]
    sql = sql.strip()
    if not heads:
        return sql
    return "with " + ", ".join(heads) + (", " + sql[5:] if sql.lower().startswith("with ") else " " + sql)
