"""A query for each operator, over whole tables, and the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, masks, text
from ..operators import exposure, images, metrics, models, network, order, roads, spatial
from ..sources import tables
from ..sources.adapters import VIEWS, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return add


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.with_roads(view(spark, d, "v_roads"), view(spark, d, "v_points"), view(spark, d, "v_gvi"))


_MET = "with m as (select p.id, p.image_id, p.is_panoramic, g.gvi, r.length, r.highway, r.city from v_points p join v_gvi g on p.id = g.id join v_roads r on p.road_index = r.road_id) "


@query("select r.road_id, s.avg_gvi, s.null_points_count, s.total_points from v_roads r left join (select p.road_index, round(avg(g.gvi), 6) as avg_gvi, count(*) - count(g.gvi) as null_points_count, count(*) as total_points from v_points p join v_gvi g on p.id = g.id group by 1) s on r.road_id = s.road_index")
def street_gvi_rollup(spark, d):
    out = metrics.street_gvi_rollup(view(spark, d, "v_roads"), view(spark, d, "v_points"), view(spark, d, "v_gvi"))
    return out.select("road_id", F.round("avg_gvi", 6).alias("avg_gvi"), "null_points_count", "total_points")


@query(_MET + "select highway, count(image_id) as total_null, round(count(image_id) / (select count(*) from m)::double, 9) as proportion from m group by highway")
def unavailable_by_highway(spark, d):
    return metrics.unavailable_by_highway(_rows(spark, d)).withColumn("proportion", F.round("proportion", 9))


@query(_MET + ", t as (select highway from m group by highway order by count(image_id) desc, highway limit 5) select highway, city, count(image_id) as total_null, round(count(image_id) / (select count(*) from m)::double, 9) as proportion from m where highway in (select highway from t) group by 1, 2")
def top_highways_missing(spark, d):
    return metrics.top_highways_missing(_rows(spark, d)).withColumn("proportion", F.round("proportion", 9))


@query(_MET + "select count(*) filter (where gvi is null and image_id = '') as unavailable, count(*) filter (where gvi is null and image_id <> '') as unsuitable, count(*) filter (where gvi is null) as total_null, round(count(*) filter (where gvi is null) / nullif(count(*), 0)::double, 9) as proportion, count(*) as total from m")
def missing_image_metrics(spark, d):
    return metrics.missing_image_metrics(_rows(spark, d)).withColumn("proportion", F.round("proportion", 9))


@query(_MET + "select count(*) filter (where is_panoramic) as panoramic, count(*) filter (where image_id <> '') as images, round(count(*) filter (where is_panoramic) / nullif(count(*) filter (where image_id <> ''), 0)::double, 9) as proportion from m")
def panoramic_metrics(spark, d):
    return metrics.panoramic_metrics(_rows(spark, d)).withColumn("proportion", F.round("proportion", 9))


_SCORES = "select round({s}, 9) as score, round({s} * ln(sum(length) / 1000), 6) as adjusted from m"


@query(_MET + _SCORES.format(s="count(*) filter (where image_id <> '') / count(*)::double"))
def availability_score(spark, d):
    return metrics.availability_score(_rows(spark, d)).select(F.round("score", 9).alias("score"), F.round("adjusted", 6).alias("adjusted"))


@query(_MET + _SCORES.format(s="count(*) filter (where image_id <> '' and gvi is not null) / (count(*) filter (where image_id <> ''))::double"))
def usability_score(spark, d):
    return metrics.usability_score(_rows(spark, d)).select(F.round("score", 9).alias("score"), F.round("adjusted", 6).alias("adjusted"))


@query("select id, gvi, round((gvi - min(gvi) over ()) / nullif(max(gvi) over () - min(gvi) over (), 0), 9) as scaled, case when gvi is null then 'red' else 'scale' end as colour from v_gvi")
def gvi_colour_scale(spark, d):
    return metrics.gvi_colour_scale(view(spark, d, "v_gvi").select("id", "gvi")).withColumn("scaled", F.round("scaled", 9))


@query("select e.seq, e.u, e.v, e.k from (select *, first_value(u) over w as f, row_number() over w as n from v_edges window w as (partition by least(u, v), greatest(u, v) order by seq)) e where case when u = v then n = 1 else u = f end")
def reverse_edge_dedup(spark, d):
    return roads.reverse_edge_dedup(view(spark, d, "v_edges")).select("seq", "u", "v", "k")


_LINES = "with l as (select road_id, length, length * 0.6e0 as a from v_roads), p as (select road_id, a, cast(unnest(range(0, cast(floor(length + 1e-9) as bigint), 500)) as integer) as d from l where length >= 1) "


def _lines(spark, d):
    r = view(spark, d, "v_roads").select("road_id", "length")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, zero = F.col("length") * 0.6, F.col("length") * 0.4, F.lit(0.0)
    return r.withColumn("line", F.array(p(zero, zero), p(a, zero), p(a, b)))


@query(_LINES + "select road_id, d, round(least(d, a), 6) as x, round(greatest(d - a, 0), 6) as y from p")
def sample_points_on_lines(spark, d):
    # the lines' lengths are sums of two parts, so a whole length may miss its last digit
    lines = _lines(spark, d).withColumn("line", F.expr("transform(line, (p, i) -> if(i = 2, named_struct('x', p.x, 'y', p.y + 1e-9), p))"))
    out = roads.sample_points_on_lines(lines, 500)
    return out.select("road_id", "d", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("select id, x, y from (select *, row_number() over (partition by x, y order by id) as n from v_gvi) where n = 1")
def point_dedup(spark, d):
    return roads.point_dedup(view(spark, d, "v_gvi").select("id", "x", "y"), ["id"])


@query("select id, x, y, gvi from (select o_orderkey % 5000 as id, o_orderkey % 360 - 180e0 as x, o_orderkey % 160 - 80.0e0 as y, o_totalprice as gvi, row_number() over (partition by o_orderkey % 5000 order by o_orderkey) as n from orders) where n = 1")
def id_dedup(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    rows = o.select((k % 5000).alias("id"), k.alias("line"), (k % 360 - 180).cast("double").alias("x"), (k % 160 - 80).cast("double").alias("y"), F.col("o_totalprice").alias("gvi"))
    return order.first_per(rows, ["id"], ["line"]).drop("line")


_TILE = "cast(floor(({x} / 360 + 0.5e0) * 64) as integer)"
_TILEY = "cast(floor((0.5e0 - 0.25e0 * ln((1 + sin(radians({y}))) / (1 - sin(radians({y})))) / pi()) * 64) as integer)"


@query(f"select id, {_TILE.format(x='x')} as tx, {_TILEY.format(y='y')} as ty from v_gvi")
def web_mercator_tile(spark, d):
    t = geo.web_mercator_tile(F.col("x"), F.col("y"), 6)
    return view(spark, d, "v_gvi").select("id", t["x"].alias("tx"), t["y"].alias("ty"))


@query(f"with f as (select image_id, x / 50 - 90 as lng, y / 20 - 30 as lat from v_images), t as (select distinct {_TILE.format(x='x')} as tx, {_TILEY.format(y='y')} as ty from v_gvi) select image_id from f where ({_TILE.format(x='lng')}, {_TILEY.format(y='lat')}) in (select (tx, ty) from t)")
def tile_semi_join(spark, d):
    f = view(spark, d, "v_images").select("image_id", (F.col("x") / 50 - 90).alias("lng"), (F.col("y") / 20 - 30).alias("lat"))
    p = view(spark, d, "v_gvi").select(F.col("x").alias("lng"), F.col("y").alias("lat"))
    return roads.tile_semi_join(f, p, 6).select("image_id")


_N = geo.N
_UTM = f"""
with p as (select id, x / 60 + 5 as lng, y / 8 + 52 as lat from v_gvi),
z as (select *, cast(floor((lng + 180) / 6) + 1 as integer) as zone from p),
t as (select *, sinh(atanh(sin(radians(lat))) - {2 * math.sqrt(_N) / (1 + _N)!r} * atanh({2 * math.sqrt(_N) / (1 + _N)!r} * sin(radians(lat)))) as t, radians(lng - (zone * 6 - 183)) as l from z),
e as (select *, atan(t / cos(l)) as xi, atanh(sin(l) / sqrt(1 + t * t)) as eta from t)
select id, zone,
  round(500000 + 0.9996e0 * {geo.A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)!r} * (eta + {_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16!r} * cos(2 * xi) * sinh(2 * eta) + {13 * _N**2 / 48 - 3 * _N**3 / 5!r} * cos(4 * xi) * sinh(4 * eta) + {61 * _N**3 / 240!r} * cos(6 * xi) * sinh(6 * eta)), 3) as x,
  round(case when lat < 0 then 1e7 else 0 end + 0.9996e0 * {geo.A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)!r} * (xi + {_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16!r} * sin(2 * xi) * cosh(2 * eta) + {13 * _N**2 / 48 - 3 * _N**3 / 5!r} * sin(4 * xi) * cosh(4 * eta) + {61 * _N**3 / 240!r} * sin(6 * xi) * cosh(6 * eta)), 3) as y
from e"""


@query(_UTM)
def utm_project(spark, d):
    p = view(spark, d, "v_gvi").select("id", (F.col("x") / 60 + 5).alias("lng"), (F.col("y") / 8 + 52).alias("lat"))
    u = geo.utm_project(F.col("lng"), F.col("lat"), geo.utm_zone(F.col("lng")))
    return p.select("id", geo.utm_zone(F.col("lng")).alias("zone"), F.round(u["x"], 3).alias("x"), F.round(u["y"], 3).alias("y"))


@query("select id, round(6378137.0e0 * radians(x), 4) as mx, round(6378137.0e0 * ln(tan(pi() / 4 + radians(y) / 2) * pow((1 - 0.0818191908426215e0 * sin(radians(y))) / (1 + 0.0818191908426215e0 * sin(radians(y))), 0.0818191908426215e0 / 2)), 4) as my from v_gvi")
def world_mercator(spark, d):
    m = geo.world_mercator(F.col("x"), F.col("y"))
    return view(spark, d, "v_gvi").select("id", F.round(m["x"], 4).alias("mx"), F.round(m["y"], 4).alias("my"))


@query("select l_orderkey, l_linenumber, round((nir - red) / nullif(nir + red, 0), 9) as ndvi from v_bands")
def ndvi_band_math(spark, d):
    b = view(spark, d, "v_bands")
    return b.select("l_orderkey", "l_linenumber", F.round(text.ndvi(F.col("nir"), F.col("red")), 9).alias("ndvi"))


@query("select cell_id, case when ndvi is not null then greatest(ndvi, 0e0) end as ndvi from v_raster")
def ndvi_clamp(spark, d):
    return view(spark, d, "v_raster").select("cell_id", text.ndvi_clamp(F.col("ndvi")).alias("ndvi"))


@query("with p(cls, r, g, b) as (values " + ", ".join(map(str, masks.PALETTE)) + ") select cls, r, g, b, count(*) as pixels from (select unnest(mask) as c from v_masks) m join p on p.cls = m.c group by 1, 2, 3, 4")
def class_palette(spark, d):
    pixels = view(spark, d, "v_masks").select(F.explode("mask").alias("cls")).groupBy("cls").agg(F.count("*").alias("pixels"))
    return exposure.class_colours(pixels).select("cls", "r", "g", "b", "pixels")


@query("select id, round((3 + id % 5) * 1000 / 60e0, 6) as pace, round((3 + id % 5) * 1000 / 60e0 * (5 + id % 20) * 1.25e0, 6) as buffer from v_gvi")
def speed_to_buffer(spark, d):
    s = geo.speed_to_buffer((F.col("id") % 20 + 5).cast("double"), (F.col("id") % 5 + 3).cast("double"))
    return view(spark, d, "v_gvi").select("id", F.round(s["metres_per_minute"], 6).alias("pace"), F.round(s["buffer"], 6).alias("buffer"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def json_field(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def _masks(spark, d):
    return view(spark, d, "v_masks").select("vec_id", masks.rows_of(F.col("mask"), 8).alias("mask"))


@query("select vec_id, len(list_filter(mask[1:56], lambda x: x = 8)) as veg, 7 as h from v_masks")
def bottom_band_crop(spark, d):
    c = masks.bottom_band_crop(F.col("mask"))
    return _masks(spark, d).select("vec_id", masks.count_of(c, 8).alias("veg"), F.size(c).alias("h"))


@query("select vec_id, len(list_filter(mask, lambda x: x = 8)) + len(list_filter(list_filter(mask, lambda x, i: (i - 1) % 8 < 2), lambda x: x = 8)) as veg, 10 as w from v_masks")
def wrap_widen(spark, d):
    c = masks.wrap_widen(F.col("mask"))
    return _masks(spark, d).select("vec_id", masks.count_of(c, 8).alias("veg"), masks.width(c).alias("w"))


@query("select vec_id, k, cast((mask[17 + 2 * k] = 8) as integer) + cast((mask[18 + 2 * k] = 8) as integer) as veg, 2 as px from v_masks, (select unnest(range(0, 4)) as k)")
def quad_crop(spark, d):
    c = _masks(spark, d).select("vec_id", F.posexplode(masks.quad_crop(F.col("mask"))).alias("k", "m"))
    return c.select("vec_id", F.col("k").cast("long").alias("k"), masks.count_of(F.col("m"), 8).cast("int").alias("veg"), masks.pixels(F.col("m")).cast("int").alias("px"))


@query("select vec_id, round(len(list_filter(mask[17:24], lambda x: x = 8)) / 8e0, 9) as gvi from v_masks")
def gvi_pixel_ratio(spark, d):
    return _masks(spark, d).select("vec_id", F.round(masks.gvi_pixel_ratio(masks.quad_crop(F.col("mask"))), 9).alias("gvi"))


@query("with p as (select vec_id, (i - 1) % 8 as col, (i - 1) // 8 as r, v from (select vec_id, unnest(mask) as v, generate_subscripts(mask, 1) as i from v_masks)), g as (select vec_id, col, r - row_number() over (partition by vec_id, col order by r) as island from p where v = 0), n as (select vec_id, col, count(*) as len from g group by vec_id, col, island) select vec_id, cast(col as integer) as col, cast(max(len) as integer) as run from (select vec_id, col, 0 as len from p union all select * from n) group by 1, 2")
def max_run_length(spark, d):
    c = _masks(spark, d).select("vec_id", F.posexplode(masks.columns_of(F.col("mask"))).alias("col", "v"))
    return c.select("vec_id", "col", masks.max_run_length(F.col("v"), 0).alias("run"))


@query("with p as (select vec_id, i, v, case when lag(v) over (partition by vec_id order by i) is distinct from v or i = 1 then 1 else 0 end as b from (select vec_id, unnest(mask) as v, generate_subscripts(mask, 1) as i from v_masks)), q as (select *, sum(b) over (partition by vec_id order by i) as run from p) select vec_id, v as value, cast(min(i) - 1 as integer) as begin, cast(count(*) as integer) as length from q group by vec_id, run, v")
def run_length_encode(spark, d):
    return view(spark, d, "v_masks").select("vec_id", F.explode(masks.run_length_encode(F.col("mask"))).alias("r")).select("vec_id", "r.value", "r.begin", "r.length")


@query()
def road_centres(spark, d):
    return images.road_centres(_masks(spark, d)).select("vec_id", "centres")


@query("select vec_id, c as centre, cast((mask[17 + ((c + 9) % 10) % 8] = 8) as bigint) + cast((mask[17 + c % 8] = 8) as bigint) as veg, cast(2 as bigint) as px from v_masks, (select cast(unnest(range(0, 10)) as integer) as c)")
def road_centre_crop(spark, d):
    m = _masks(spark, d).withColumn("wide", masks.wrap_widen(F.col("mask")))
    c = m.select("vec_id", "wide", F.explode(F.sequence(F.lit(0), masks.width(F.col("wide")) - 1)).alias("centre"))
    crop = masks.road_centre_crop(F.col("wide"), F.col("centre"))
    return c.select("vec_id", "centre", masks.count_of(crop, 8).alias("veg"), masks.pixels(crop).alias("px"))


@query()
def usable_image_test(spark, d):
    return images.road_centres(_masks(spark, d)).select("vec_id", (F.size("centres") > 0).alias("usable"))


@query()
def gvi_for_image(spark, d):
    m = _masks(spark, d).withColumns({"id": F.col("vec_id"), "image_id": F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.col("vec_id").cast("string")), "is_panoramic": F.col("vec_id") % 3 == 0})
    return images.gvi_for_images(m, cut_by_road_centres=True)


_NODES = "points as (select n as id, x, y from v_nodes)"


@query(f"with {_NODES}, c as (select p.id, i.image_id, i.is_pano, (p.x - i.x) * (p.x - i.x) + (p.y - i.y) * (p.y - i.y) as d2, row_number() over (partition by p.id order by (p.x - i.x) * (p.x - i.x) + (p.y - i.y) * (p.y - i.y), i.image_id) as n from points p join v_images i on i.x between p.x - 25 and p.x + 25 and i.y between p.y - 25 and p.y + 25 where (p.x - i.x) * (p.x - i.x) + (p.y - i.y) * (p.y - i.y) < 625) select p.id, round(sqrt(c.d2), 6) as distance, coalesce(cast(c.image_id as varchar), '') as image_id, coalesce(c.is_pano, false) as is_panoramic from points p left join c on p.id = c.id and c.n = 1")
def nearest_image_join(spark, d):
    p = view(spark, d, "v_nodes").withColumnRenamed("n", "id")
    return roads_select(spatial.nearest_image_join(p, view(spark, d, "v_images")))


def roads_select(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("distance", 6).alias("distance"), "image_id", "is_panoramic")


@query(f"with {_NODES}, c as (select i.image_id as id, p.id as node, row_number() over (partition by i.image_id order by (p.x - i.x) * (p.x - i.x) + (p.y - i.y) * (p.y - i.y), p.id) as k from v_images i cross join points p) select id, node from c where k = 1")
def nearest_node(spark, d):
    p = view(spark, d, "v_images").select(F.col("image_id").alias("id"), "x", "y")
    return spatial.nearest_node(p, view(spark, d, "v_nodes").withColumnRenamed("n", "node"), 100.0).select("id", "node")


_IN = "abs(atan2(c.y - p.y, c.x - p.x) - 2 * pi() / 64 * (floor(atan2(c.y - p.y, c.x - p.x) / (2 * pi() / 64)) + 0.5e0))"
_ZONE = f"z as (select p.id, c.cell_id, c.ndvi, c.landcover from (select n as id, x * 0.4e0 as x, y * 0.2e0 as y from v_nodes) p join v_raster c on c.x between p.x - 40 and p.x + 40 and c.y between p.y - 40 and p.y + 40 where sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) * cos({_IN}) <= 40 * cos(pi() / 64))"


def _zones(spark, d):
    p = view(spark, d, "v_nodes").select(F.col("n").alias("id"), (F.col("x") * 0.4).alias("x"), (F.col("y") * 0.2).alias("y"))
    return p, view(spark, d, "v_raster")


@query(f"with {_ZONE} select id, cell_id from z")
def zonal_join(spark, d):
    return spatial.zonal_join(*_zones(spark, d), 40.0).select("id", "cell_id")


@query(f"with {_ZONE} select n as id, m as mean_ndvi from v_nodes left join (select id, round(avg(greatest(ndvi, 0)), 3) as m from z group by id) on n = id")
def zonal_mean_ndvi(spark, d):
    return spatial.zonal_mean_ndvi(*_zones(spark, d), 40.0)


@query(f"with {_ZONE} select id, landcover, round(count(*) / sum(count(*)) over (partition by id)::double * 100, 3) as percentage from z group by id, landcover")
def landcover_percentages(spark, d):
    return spatial.landcover_percentages(*_zones(spark, d), 40.0)


@query(f"select n as id, round({0.5 * 64 * 25**2 * math.sin(2 * math.pi / 64)!r}::double, 6) as area from v_nodes")
def point_buffer(spark, d):
    ring = geo.buffer_ring(F.col("x"), F.col("y"), 25.0)
    return view(spark, d, "v_nodes").select(F.col("n").alias("id"), F.round(geo.polygon_area2(ring) / 2, 6).alias("area"))


@query("select poly_id, round((xmin + xmax) / 2, 6) as cx, round((ymin + ymax) / 2, 6) as cy from v_rects")
def polygon_centroid(spark, d):
    c = spatial.box_rings(view(spark, d, "v_rects")).select("poly_id", geo.polygon_centroid(F.col("rings")[0]).alias("c"))
    return c.select("poly_id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


def _areas(spark, d):
    p, r = view(spark, d, "v_nodes"), 60.0
    x, y = F.col("x") * 0.4, F.col("y") * 0.2
    a = p.select(F.col("n").alias("id"), (x - r).alias("xmin"), (y - r).alias("ymin"), (x + r).alias("xmax"), (y + r).alias("ymax"))
    return spatial.box_rings(a), spatial.box_rings(view(spark, d, "v_rects"))


_CLIP = "a as (select n as id, x * 0.4e0 - 60 as xmin, x * 0.4e0 + 60 as xmax, y * 0.2e0 - 60 as ymin, y * 0.2e0 + 60 as ymax from v_nodes), o as (select a.id, r.poly_id, (least(a.xmax, r.xmax) - greatest(a.xmin, r.xmin)) * (least(a.ymax, r.ymax) - greatest(a.ymin, r.ymin)) as overlap from a join v_rects r on a.xmin < r.xmax and r.xmin < a.xmax and a.ymin < r.ymax and r.ymin < a.ymax)"


@query(f"with {_CLIP} select id, poly_id, round(overlap, 4) as overlap from o")
def polygon_clip_join(spark, d):
    return spatial.polygon_clip_join(*_areas(spark, d), 100.0).filter("overlap > 1e-9").withColumn("overlap", F.round("overlap", 4))


@query(f"with {_CLIP} select a.id, round(coalesce(sum(overlap), 0) / 14400 * 100, 2) as percentage from a left join o on a.id = o.id group by a.id")
def canopy_cover(spark, d):
    return spatial.cover_percentage(*_areas(spark, d), 100.0)


@query(f"with {_CLIP} select a.id, round(coalesce(sum(overlap) filter (where poly_id % 3 = 0), 0) / 14400 * 100, 2) as percentage from a left join o on a.id = o.id group by a.id")
def park_cover(spark, d):
    a, polys = _areas(spark, d)
    k = F.col("poly_id") % 3
    tagged = polys.withColumns({"landuse": F.lit(None).cast("string"), "leisure": F.when(k == 0, "park").when(k == 1, "pitch"), "natural": F.lit(None).cast("string"), "geom_type": F.lit("Polygon")})
    return spatial.cover_percentage(a, spatial.park_tag_filter(tagged), 100.0)


@query("select p_partkey from (select p_partkey, case when p_size % 5 = 0 then 'forest' when p_size % 5 = 1 then 'industrial' end as landuse, case when p_size % 7 = 0 then 'park' when p_size % 7 = 1 then 'pitch' end as leisure, case when p_size % 11 = 0 then 'grassland' end as nature, case when p_size % 3 = 0 then 'Point' else 'Polygon' end as geom from part) where geom = 'Polygon' and (landuse = 'forest' or leisure = 'park' or nature = 'grassland')")
def park_tag_filter(spark, d):
    s = F.col("p_size")
    f = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.when(s % 5 == 0, "forest").when(s % 5 == 1, "industrial").alias("landuse"), F.when(s % 7 == 0, "park").when(s % 7 == 1, "pitch").alias("leisure"), F.when(s % 11 == 0, "grassland").alias("natural"), F.when(s % 3 == 0, "Point").otherwise("Polygon").alias("geom_type"))
    return spatial.park_tag_filter(f).select("p_partkey")


@query("select scene_id, cloud_cover from v_scenes where captured_at >= timestamp '2024-01-01' and captured_at <= timestamp '2024-12-31' and cloud_cover < 20 and xmin <= 30 and xmax >= 35 order by cloud_cover, scene_id limit 1")
def stac_scene_selection(spark, d):
    return spatial.scene_selection(view(spark, d, "v_scenes"), "2024-01-01", "2024-12-31", 30.0, 35.0).select("scene_id", "cloud_cover")


@query("select id, x, y from v_gvi, (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from v_raster) where x between x0 and x1 and y between y0 and y1")
def bbox_filter(spark, d):
    return spatial.bbox_filter(view(spark, d, "v_gvi").select("id", "x", "y"), view(spark, d, "v_raster"))


@query("select cell_id, ndvi from v_raster where x between 100 and 300 and y between 50 and 250")
def raster_clip_box(spark, d):
    return view(spark, d, "v_raster").filter(F.col("x").between(100, 300) & F.col("y").between(50, 250)).select("cell_id", "ndvi")


@query("select s_suppkey as id, try_cast(x as double) as x, try_cast(y as double) as y from (select s_suppkey, case when s_suppkey % 4 = 0 then 'x' when s_suppkey % 5 = 0 then null else cast(s_suppkey as varchar) end as x, case when s_suppkey % 7 = 0 then '' else '1.5' end as y from supplier) where (x is null or try_cast(x as double) is not null) and (y is null or try_cast(y as double) is not null)")
def csv_row_validation(spark, d):
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("id"), F.when(k % 4 == 0, "x").when(k % 5 != 0, k.cast("string")).alias("x"), F.when(k % 7 == 0, "").otherwise("1.5").alias("y"))
    return tables.csv_row_validation(rows)


@query("select id from (select id, row_number() over (order by id) - 1 as i from v_gvi) where i >= 100 and i < 1100")
def range_slice(spark, d):
    return order.range_slice(view(spark, d, "v_gvi").select("id"), "id", 100, 1100)


@query("select id, cast(row_number() over (order by id) - 1 as bigint) as seq from v_gvi")
def row_numbers(spark, d):
    return order.row_index(view(spark, d, "v_gvi").select("id"), "id", name="seq")


@query("select id, cast(ntile(5) over (order by id) as integer) as fold from v_gvi where not missing")
def kfold_assign(spark, d):
    return order.kfold_assign(view(spark, d, "v_gvi").filter("not missing").select("id"), "id")


@query("with f as (select regr_slope(gvi, mean_ndvi) as a, regr_intercept(gvi, mean_ndvi) as b from v_gvi where not missing) select id, round(case when missing then a * mean_ndvi + b else gvi end, 6) as gvi from v_gvi, f")
def ols_impute(spark, d):
    return models.ols_impute(view(spark, d, "v_gvi")).select("id", F.round("gvi", 6).alias("gvi"))


@query("with f as (select regr_slope(gvi, mean_ndvi) as a, regr_intercept(gvi, mean_ndvi) as b from v_gvi where not missing) select id, round(gvi, 6) as gvi, missing from v_gvi where not missing union all select id, round(a * mean_ndvi + b, 6), missing from v_gvi, f where missing")
def impute_union(spark, d):
    g = models.ols_impute(view(spark, d, "v_gvi"))
    both = models.impute_union(g.filter(~F.col("missing")), g.filter("missing"))
    return both.select("id", F.round("gvi", 6).alias("gvi"), "missing")


_CV = "with k as (select gvi, mean_ndvi, ntile(5) over (order by id) as fold from v_gvi where not missing), l as (select f.fold, regr_slope(k.gvi, k.mean_ndvi) as a, regr_intercept(k.gvi, k.mean_ndvi) as b from (select distinct fold from k) f join k on k.fold <> f.fold group by 1), s as (select k.fold, sqrt(avg((gvi - a * mean_ndvi - b) * (gvi - a * mean_ndvi - b))) as rmse, 1 - sum((gvi - a * mean_ndvi - b) * (gvi - a * mean_ndvi - b)) / (var_pop(gvi) * count(*)) as r2, count(*) as n from k join l on k.fold = l.fold group by 1) "


def _cv(spark, d):
    known = view(spark, d, "v_gvi").filter("not missing").select("id", "gvi", "mean_ndvi")
    return models.cv_rmse_r2(order.kfold_assign(known, "id"), "mean_ndvi", "gvi")


@query(_CV + "select round(avg(rmse), 6) as rmse, round(avg(r2), 6) as r2, cast(sum(n) as bigint) as n from s")
def cv_rmse_r2(spark, d):
    return _cv(spark, d).select(F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"), "n")


@query(_CV + "select round(avg(rmse), 6) as rmse, round(sum(n) * ln(avg(rmse) * avg(rmse)) + 4, 4) as aic, cast(sum(n) as bigint) as n from s")
def aic_from_rmse(spark, d):
    return models.aic_from_rmse(_cv(spark, d)).select(F.round("rmse", 6).alias("rmse"), F.round("aic", 4).alias("aic"), "n")


@query()
def gam_impute(spark, d):
    return models.gam_impute(view(spark, d, "v_gvi")).select("id", F.round("gvi", 6).alias("gvi"))


@query()
def gam_statistics(spark, d):
    model = models.fit_gam(view(spark, d, "v_gvi").filter("not missing"), "mean_ndvi", "gvi")
    return spark.createDataFrame([{k: float(v) for k, v in model.statistics.items()}])


@query()
def gam_summary(spark, d):
    """All statistics of the imputation model, and the tests of its terms."""
    return spark.createDataFrame(models.fit_gam(view(spark, d, "v_gvi").filter("not missing"), "mean_ndvi", "gvi").summary(), "name string, value double")


@query()
def poisson_exposure_gam(spark, d):
    """Counts with exposures: the rate by mean_ndvi."""
    rows = view(spark, d, "v_gvi").filter("not missing").withColumns({"n": F.floor(F.col("gvi") * 10).cast("double"), "exposure": 1.0 + F.col("id") % 3})
    return models.predict(rows, models.fit_counts(rows, "mean_ndvi", "n", "exposure", lams=PENALTIES), "mean_ndvi", "rate").select("id", F.round("rate", 6).alias("rate"))


@query()
def quantile_gam(spark, d):
    rows = view(spark, d, "v_gvi").filter("not missing")
    return models.predict(rows, models.fit_quantile(rows, "mean_ndvi", "gvi", 0.8, lams=[1.0]), "mean_ndvi", "upper").select("id", F.round("upper", 6).alias("upper"))


@query()
def gam_intervals(spark, d):
    """Bounds of the mean and of new values over a grid."""
    model = models.fit_gam(view(spark, d, "v_gvi").filter("not missing"), "mean_ndvi", "gvi")
    x = model.partial_dependence(50)[0]
    rows = [tuple(map(float, r)) for r in zip(x, *model.intervals(x).T, *model.intervals(x, prediction=True).T, strict=True)]
    return spark.createDataFrame(rows, "x double, low double, high double, new_low double, new_high double")


#: The grid of penalties of models other than the imputation's.
PENALTIES = [10.0**k for k in (-3, -2.4, -1.8, -1.2, -0.6, 0, 0.6, 1.2, 1.8, 2.4, 3)]


def _fit(spark, d, y, **more):
    rows = view(spark, d, "v_gvi").filter("not missing").withColumn("y", y)
    model = models.fit_gam(rows, "mean_ndvi", "y", lams=PENALTIES, **more)
    return models.predict(rows, model, "mean_ndvi", "mean").select("id", "y", F.round("mean", 6).alias("mean"))


@query()
def logistic_gam(spark, d):
    """The chance that gvi is above one half."""
    return _fit(spark, d, (F.col("gvi") > 0.5).cast("double"), family="binomial").withColumn("predicted", F.col("mean") > 0.5)


@query()
def poisson_gam(spark, d):
    return _fit(spark, d, F.floor(F.col("gvi") * 10).cast("double"), family="poisson")


@query()
def gamma_gam(spark, d):
    return _fit(spark, d, F.col("gvi") + 0.1, family="gamma")


@query()
def inv_gauss_gam(spark, d):
    return _fit(spark, d, F.col("gvi") + 0.1, family="inv_gauss")


@query()
def expectile_gam(spark, d):
    return _fit(spark, d, F.col("gvi"), expectile=0.8)


@query()
def gam_partial_dependence(spark, d):
    x, part = models.fit_gam(view(spark, d, "v_gvi").filter("not missing"), "mean_ndvi", "gvi").partial_dependence()
    return spark.createDataFrame([(float(a), round(float(b), 6)) for a, b in zip(x, part, strict=True)], "x double, effect double")


def _graph(spark, d):
    nodes = view(spark, d, "v_nodes").withColumnRenamed("n", "node")
    edges = network.edges_with_length(view(spark, d, "v_edges").select("u", "v"), nodes)
    return nodes.select(F.col("node").alias("id"), "node"), nodes, edges


_EGO = "e as (select distinct u, v, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as l, a.x as x0, a.y as y0, b.x as x1, b.y as y1 from v_edges join v_nodes a on u = a.n join v_nodes b on v = b.n), h0 as (select n as id, n as node, 0e0 as d from v_nodes), h1 as (select id, node, min(d) as d from (select * from h0 union all select id, v, d + l from h0 join e on node = u where d + l <= 400) group by 1, 2), h2 as (select id, node, min(d) as d from (select * from h1 union all select id, v, d + l from h1 join e on node = u where d + l <= 400) group by 1, 2), h3 as (select id, node, min(d) as d from (select * from h2 union all select id, v, d + l from h2 join e on node = u where d + l <= 400) group by 1, 2)"


@query(f"with {_EGO} select id, node, round(d, 6) as distance from h3")
def ego_graph(spark, d):
    return network.ego_graph(*_graph(spark, d), 400.0).withColumn("distance", F.round("distance", 6))


@query(f"with {_EGO}, s as (select distinct a.id, e.* from e join h3 a on a.node = e.u join h3 b on b.node = e.v and a.id = b.id), t as (select s.*, i.image_id, i.x, i.y, case when (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) = 0 then 0 else least(greatest(((i.x - x0) * (x1 - x0) + (i.y - y0) * (y1 - y0)) / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0), 0), 1) end as f from s join v_images i on i.x between least(x0, x1) - 25 and greatest(x0, x1) + 25 and i.y between least(y0, y1) - 25 and greatest(y0, y1) + 25) select distinct id, image_id as place from t where (x - x0 - f * (x1 - x0)) * (x - x0 - f * (x1 - x0)) + (y - y0 - f * (y1 - y0)) * (y - y0 - f * (y1 - y0)) <= 625")
def isochrone_polygon(spark, d):
    origins, nodes, edges = _graph(spark, d)
    places = view(spark, d, "v_images").select(F.col("image_id").alias("place"), "x", "y")
    return network.isochrone_members(network.ego_graph(origins, nodes, edges, 400.0), edges, places)


from . import exposure_queries  # noqa: E402, F401  registers more queries

__all__ = ["ORACLES", "QUERIES", "VIEWS"]
