"""Queries of the exposure operators, texts and sinks, and the same in DuckDB's SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import exposure, metrics, order, roads, spatial
from ..sources import sinks, tables
from ..sources.adapters import view
from .queries import _TILE, _TILEY, _ZONE, _graph, _lines, _zones, query

_URL = "https://tiles.example/{z}/{x}/{y}.pbf"


@query(f"select id, 'https://tiles.example/6/' || {_TILE.format(x='x')} || '/' || {_TILEY.format(y='y')} || '.pbf' as url from v_gvi")
def tile_url(spark, d):
    return view(spark, d, "v_gvi").select("id", text.tile_url(_URL, geo.web_mercator_tile(F.col("x"), F.col("y"), 6)).alias("url"))


@query("select id, cast(round(mean_ndvi * 100, 2) as varchar) || '%' as share from v_gvi")
def percentage_text(spark, d):
    return view(spark, d, "v_gvi").select("id", text.percentage_text(F.col("mean_ndvi") * 100).alias("share"))


@query("select id as k, case when id % 5 = 0 then row_number() over (order by id) else id end as id from v_gvi")
def id_null_fill(spark, d):
    rows = view(spark, d, "v_gvi").select(F.col("id").alias("k"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("id"))
    return exposure.fill_ids(rows, "k")


@query("select round(avg(x), 6) as x, round(avg(y), 6) as y from (select distinct x, y from v_gvi)")
def map_centre(spark, d):
    return exposure.map_centre(view(spark, d, "v_gvi")).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("select id, 'ID: ' || id || ' / GVI: ' || coalesce(cast(round(gvi, 2) as varchar), 'none') as label, y as lat, x as lng from v_gvi")
def marker_label(spark, d):
    at = text.latitude_first(F.col("x"), F.col("y"))
    return view(spark, d, "v_gvi").select("id", text.marker_label(F.col("id"), F.col("gvi")).alias("label"), at["lat"].alias("lat"), at["lng"].alias("lng"))


@query("select road_id, round(length / (5 * 1000 / 60e0), 6) as minutes from v_roads")
def edge_travel_time(spark, d):
    return view(spark, d, "v_roads").select("road_id", F.round(text.travel_minutes(F.col("length"), F.lit(5)), 6).alias("minutes"))


@query("select min(x) - 25 as xmin, min(y) - 25 as ymin, max(x) + 25 as xmax, max(y) + 25 as ymax from v_images")
def point_bounds(spark, d):
    return exposure.bounds(view(spark, d, "v_images"), 25.0)


@query("select 'rects' as kind, count(*) as total, count(*) filter (where xmin >= 50 and ymin >= 40 and xmax <= 400 and ymax <= 300) as within, count(*) filter (where xmin <= 400 and xmax >= 50 and ymin <= 300 and ymax >= 40) as meets from v_rects union all select 'points', count(*), count(*) filter (where x > -90 and y > -40 and x < 90 and y < 40), count(*) filter (where x >= -90 and y >= -40 and x <= 90 and y <= 40) from v_gvi")
def extent_check(spark, d):
    rects = exposure.extent_counts(view(spark, d, "v_rects"), 50, 40, 400, 300).select(F.lit("rects").alias("kind"), "*")
    points = exposure.extent_counts(exposure.as_boxes(view(spark, d, "v_gvi")), -90, -40, 90, 40).select(F.lit("points").alias("kind"), "*")
    return rects.union(points)


@query(f"with {_ZONE}, p as (select id, landcover, round(count(*) / sum(count(*)) over (partition by id)::double * 100, 3) as percentage from z group by id, landcover) select id, landcover, percentage, case when length(landcover) % 2 = 0 then 'cover: ' || landcover else landcover end as name from p")
def landcover_named(spark, d):
    points, cells = _zones(spark, d)
    value = F.col("landcover")
    classes = cells.select(value.alias("value")).distinct().filter(F.length("value") % 2 == 0).withColumn("description", F.concat(F.lit("cover: "), F.col("value")))
    return exposure.named_classes(spatial.landcover_percentages(points, cells, 40.0), classes)


@query(f"with {_ZONE} select id, landcover, 'class_' || landcover as name from z group by id, landcover")
def landcover_class_names(spark, d):
    return exposure.named_classes(spatial.landcover_percentages(*_zones(spark, d), 40.0)).select("id", "landcover", "name")


@query("select poly_id as seq, xmin, ymax from v_rects where xmin <= 260 and xmax >= 200 and ymin <= 130 and ymax >= 90 order by seq limit 1")
def landcover_catalogue(spark, d):
    items = view(spark, d, "v_rects").withColumnRenamed("poly_id", "seq")
    return exposure.landcover_catalogue(items, 200, 90, 260, 130).select("seq", "xmin", "ymax")


@query("select l_orderkey as tile, cast(row_number() over (partition by l_orderkey order by l_linenumber) - 1 as integer) as place, l_linenumber as feature from lineitem")
def feature_flatten(spark, d):
    tiles = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("tile")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("features"))
    return exposure.flatten_features(tiles)


@query("select r.road_id, round(r.length, 6) as length, p.n from v_roads r left join (select road_index, count(*) as n from v_points group by 1) p on r.road_id = p.road_index")
def column_concat(spark, d):
    n = view(spark, d, "v_points").groupBy(F.col("road_index").alias("road_id")).agg(F.count("*").alias("n"))
    return exposure.concat_columns(view(spark, d, "v_roads").select("road_id", F.round("length", 6).alias("length")), n, "road_id")


@query("with t as (select cell_id, x * 2 + 1003 as x, y * 3 - 500 as y from v_raster), s as (select floor(x / 10) as c, floor(y / 10) as r, ndvi from v_raster) select t.cell_id, s.ndvi from t left join s on floor((t.x - 1000) / 2 / 10) = s.c and floor((t.y + 500) / 3 / 10) = s.r")
def raster_reproject(spark, d):
    cells = view(spark, d, "v_raster")
    target = cells.select("cell_id", (F.col("x") * 2 + 1003).alias("x"), (F.col("y") * 3 - 500).alias("y"))
    out = exposure.reproject_nearest(cells, target, lambda x, y: ((x - 1000) / 2, (y + 500) / 3), 0.0, 0.0, 10.0, "ndvi")
    return out.select("cell_id", "ndvi")


@query("select poly_id from v_rects where xmin <= 105 and ymin <= 82 and xmax >= 112 and ymax >= 90")
def footprint_contains(spark, d):
    return exposure.footprint_contains(view(spark, d, "v_rects"), 105, 82, 112, 90).select("poly_id")


@query("select seq, case when seq % 3 = 0 then 3 else 2 end as corners, case when seq % 3 = 0 then 0e0 else a.x end as x0 from v_edges join v_nodes a on u = a.n join v_nodes b on v = b.n")
def edge_geometry(spark, d):
    nodes = view(spark, d, "v_nodes").withColumnRenamed("n", "node")
    corner = F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    edges = view(spark, d, "v_edges").select("seq", "u", "v", F.when(F.col("seq") % 3 == 0, F.array(corner, corner, corner)).alias("geometry"))
    return exposure.edge_lines(edges, nodes.select("node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).select("seq", F.size("line").alias("corners"), F.col("line")[0]["x"].alias("x0"))


@query(f"select poly_id, round((xmax - xmin) * (ymax - ymin) + 2 * (xmax - xmin + ymax - ymin) * 25 + {0.5 * 64 * 25**2 * math.sin(2 * math.pi / 64)!r}::double, 4) as area from v_rects")
def polygon_buffer(spark, d):
    areas = exposure.build_aoi(spatial.box_rings(view(spark, d, "v_rects")).withColumnRenamed("poly_id", "id"), "euclidean", 25.0)
    return areas.select(F.col("id").alias("poly_id"), F.round(geo.polygon_area2(F.col("rings")[0]) / 2, 4).alias("area"))


@query()
def isochrone_holes(spark, d):
    """Cells of each origin's isochrone, and those that it surrounds."""
    origins, nodes, edges = _graph(spark, d)
    return exposure.build_aoi(origins, "network", 400.0, nodes, edges).groupBy("id").agg(F.count("*").alias("cells"), F.count_if("hole").alias("holes"))


@query("select id, cast(x as varchar) as x, cast(y as varchar) as y, cast(id % 7 as varchar) as part from v_gvi")
def csv_union(spark, d):
    """Result CSVs, one folder of files a part, beside a merged file of an earlier run that must not come in again."""
    folder = sinks.work_dir(spark)
    rows = view(spark, d, "v_gvi").select("id", "x", "y", F.col("gvi").alias("GVI"), F.lit(True).alias("is_panoramic"), "missing", "error", (F.col("id") % 7).alias("part"))
    rows.repartition("part").write.partitionBy("part").option("header", True).csv(folder)
    names = [f"{folder}/part={k}" for k in range(7) if sinks.exists(spark, f"{folder}/part={k}")]
    sinks.overwrite_csv(rows.drop("part").limit(9), f"{names[0]}/{sinks.MERGED}")
    parts = [p for n in names for p in sinks.result_csvs(spark, n)]
    return tables.csv_union(spark, parts).select(F.col("id").cast("long").alias("id"), "x", "y", F.regexp_extract("file", r"part=(\d+)", 1).alias("part"))


@query("select road_id as index, round(length, 6) as length, highway from v_roads")
def roads_layer(spark, d):
    roads = view(spark, d, "v_roads").withColumnRenamed("road_id", "index")
    return sinks.write_roads(roads, sinks.work_dir(spark)).withColumn("length", F.round("length", 6))


@query(f"with {_ZONE} select n as id, m as mean_ndvi from v_nodes left join (select id, round(avg(greatest(ndvi, 0)), 3) as m from z group by id) on n = id")
def exposure_output(spark, d):
    folder = sinks.work_dir(spark)
    return spark.read.parquet(sinks.write_exposure(spatial.zonal_mean_ndvi(*_zones(spark, d), 40.0), folder, "places.gpkg", "ndvi"))


@query("with l as (select road_id, length, length * 0.6e0 as a from v_roads) select road_id, cast(unnest(range(0, cast(floor(length + 1e-9) as bigint), 500)) as integer) as d from l where length >= 1")
def cached_points(spark, d):
    """Points that are built at first and read at the second time."""
    lines = _lines(spark, d).withColumn("line", F.expr("transform(line, (p, i) -> if(i = 2, named_struct('x', p.x, 'y', p.y + 1e-9), p))"))
    path = sinks.work_dir(spark)
    sinks.built_once(spark, path, lambda: roads.sample_points_on_lines(lines, 500).select("road_id", "d"))
    return sinks.built_once(spark, path, lambda: lines.select("no_such_column"))


@query("select id, row_number() over (order by md5(cast(id as varchar) || ':42'), id) <= 100 as save_sample from v_gvi")
def sample_flag(spark, d):
    return order.sample_flag(view(spark, d, "v_gvi").select("id"), 100)


@query("with m as (select p.id, p.image_id, p.is_panoramic, g.gvi, r.length from v_points p join v_gvi g on p.id = g.id join v_roads r on p.road_index = r.road_id) select count(*) filter (where gvi is null and image_id = '') as unavailable, count(*) filter (where gvi is null and image_id <> '') as unsuitable, count(*) as total, round(count(*) filter (where image_id <> '') / count(*)::double, 9) as availability, round(count(*) filter (where image_id <> '' and gvi is not null) / (count(*) filter (where image_id <> ''))::double, 9) as usability from m")
def all_scores(spark, d):
    rows = metrics.with_roads(view(spark, d, "v_roads"), view(spark, d, "v_points"), view(spark, d, "v_gvi"))
    return metrics.all_scores(rows).select("unavailable", "unsuitable", "total", F.round("availability", 9).alias("availability"), F.round("usability", 9).alias("usability"))

