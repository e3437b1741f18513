"""Golden values, and plain restatements of the operators on small inputs."""

import math
import sqlite3
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdantspark.functions import geo, masks
from verdantspark.operators import images, metrics, models, order, roads, spatial
from verdantspark.sources import tables
from verdantspark.streaming.ingest import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_tile_golden(spark):
    t = one(spark, geo.web_mercator_tile(F.lit(5.18339), F.lit(52.08099)))
    assert (t.x, t.y, t.z) == (8427, 5405, 14)


def test_utm_golden(spark):
    u = one(spark, geo.utm_project(F.lit(5.18339), F.lit(52.08099), geo.utm_zone(F.lit(5.18339))))
    assert abs(u.x - 649611.43) < 0.01 and abs(u.y - 5772295.51) < 0.01


def test_spacing(spark):
    p = lambda x: F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y"))
    for length, want in ((0.9, []), (50, [0]), (50.9, [0]), (51, [0, 50]), (100, [0, 50])):
        got = roads.sample_points_on_lines(spark.range(1).select(F.array(p(0), p(length)).alias("line")), 50).collect()
        assert sorted(r.d for r in got) == want and all(r.x == r.d for r in got)


def test_reverse_edges(spark):
    rng = np.random.default_rng(3)
    edges = [(i, int(u), int(v)) for i, (u, v) in enumerate(rng.integers(0, 8, (60, 2)))]
    kept, seen = set(), set()
    for i, u, v in edges:
        if u == v and (u, v) in seen or u != v and (v, u) in seen:
            continue
        seen.add((u, v))
        kept.add(i)
    got = roads.reverse_edge_dedup(spark.createDataFrame(edges, "seq long, u long, v long"))
    assert {r.seq for r in got.collect()} == kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=3, max_size=30), st.integers(1, 5), st.integers(0, 3))
def test_peaks(v, distance, prominence):
    v = np.array(v)
    got = images.find_peaks(v, distance, prominence)
    assert all(b - a >= distance for a, b in zip(got, got[1:], strict=False))
    for p in got:
        assert 0 < p < len(v) - 1 and v[p] >= v[p - 1] and v[p] >= v[p + 1]


def test_peaks_need_distance():
    with pytest.raises(ValueError, match="distance"):
        images.find_peaks(np.array([0, 1, 0]), 0, 0)


def crop(mask, centre):
    h, w = mask.shape
    w4, h4 = int(w / 4), int(h / 4)
    rows = mask[h4 : h4 + int(w4 * 3 / 4)]
    cols = [(int(centre - w4 / 2) + j) for j in range(w4)]
    if centre > int(w * 7 / 8):
        return np.array([[r[c] if c < w else r[c - w] for c in cols] for r in rows])
    if centre < w4 / 2:
        over = int(w4 / 2 - centre)
        return np.array([[*r[w - over :], *r[: w4 - over]] if over else list(r[:w4]) for r in rows])
    return rows[:, cols[0] : cols[0] + w4]


@pytest.mark.parametrize("shape", [(16, 24), (12, 20), (9, 18)])
def test_road_centre_crop(spark, shape):
    mask = np.random.default_rng(1).integers(0, 19, shape)
    df = spark.createDataFrame([(mask.tolist(),)], "mask array<array<int>>")
    for c in range(shape[1]):
        got = df.select(masks.road_centre_crop(F.col("mask"), F.lit(c)).alias("v")).first().v
        assert got == crop(mask, c).tolist(), c


def test_image_decisions(spark):
    road = [[0 if j == 2 and i > 0 else 8 for j in range(8)] for i in range(8)]
    none = [[8] * 8 for _ in range(8)]
    rows = [(1, "", False, road), (2, "a", False, None), (3, "a", False, road), (4, "a", False, none), (5, "a", True, none), (6, "a", False, [[0, 8]])]
    df = spark.createDataFrame(rows, "id long, image_id string, is_panoramic boolean, mask array<array<int>>")
    got = {r.id: (r.gvi, r.is_panoramic, r.missing, r.error) for r in images.gvi_for_images(df, True).collect()}
    assert got[1] == (None, None, True, False) and got[2] == (None, None, True, True) and got[6] == (None, None, True, True)
    assert got[3] == (57 / 64, False, False, False) and got[4] == (None, False, True, False) and got[5] == (0.0, True, False, False)
    quad = {r.id: r.gvi for r in images.gvi_for_images(df).collect()}
    assert quad[5] == 1.0


def test_polygon_overlap():
    star = np.array([(0, 0), (4, 1), (8, 0), (7, 4), (8, 8), (4, 7), (0, 8), (1, 4)], float)
    square = np.array([(2, 2), (6, 2), (6, 6), (2, 6)], float)
    assert math.isclose(spatial.clip_area([star], [square]), 16.0)
    assert math.isclose(spatial.clip_area([star[::-1]], [square]), 16.0)
    hole = np.array([(3, 3), (5, 3), (5, 5), (3, 5)], float)
    assert math.isclose(spatial.clip_area([star, hole], [square]), 12.0)
    assert math.isclose(spatial.clip_area([star], [star]), spatial.polygon_area([star]))


def test_nearest_node_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)) * 1000)], "id long, x double, y double")
    n = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((25, 2)) * 300)], "node long, x double, y double")
    sent = {(r.id, r.node) for r in spatial.nearest_node(p, n, 50.0).collect()}
    monkeypatch.setattr(spatial, "SENT_NODES", 1)
    assert sent == {(r.id, r.node) for r in spatial.nearest_node(p, n, 50.0).collect()} and len(sent) == 60


@pytest.mark.parametrize("n", [1, 2, 17, 600])
@pytest.mark.parametrize("ties", [True, False])
def test_tiles_find_the_nearest(n, ties):
    rng = np.random.default_rng(n)
    x, y = (rng.integers(0, 20, (2, n)) * 1.0) if ties else rng.normal(size=(2, n)) * [[50], [1]]
    px, py = rng.integers(-30, 50, (2, 300)) * 0.5
    d2 = (px[:, None] - x) ** 2 + (py[:, None] - y) ** 2
    which, best = spatial.Tiles(x, y).nearest(px, py)
    assert (which == d2.argmin(1)).all() and (best == d2.min(1)).all()


def test_nearest_node_without_coordinates(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "id long, x double, y double")
    n = spark.createDataFrame([(5, None, 0.0), (6, 3.0, 4.0), (7, -3.0, 4.0)], "node long, x double, y double")
    assert [tuple(r) for r in spatial.nearest_node(p, n, 1.0).collect()] == [(1, 6, 5.0)]
    assert spatial.nearest_node(p, n.filter("node < 6"), 1.0).count() == 0


def test_spline_limits():
    s = models.Spline(0.0, 1.0, 12)
    x = np.linspace(0, 1, 50)
    b = s.basis(x)
    assert np.allclose(b.sum(1), 1) and (b >= -1e-12).all()
    d = np.diff(s.basis(np.array([1.1, 1.2, 1.3])), axis=0)
    assert np.allclose(d[0], d[1], atol=1e-6)


def test_gam_against_dense(spark):
    rng = np.random.default_rng(0)
    x = rng.random(400)
    y = np.sin(6 * x) + rng.normal(0, 0.2, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    m = models.fit_gam(df, "x", "y", lams=[0.6])
    b = m.matrix(x)
    p = np.zeros((26, 26))
    p[1:, 1:] = m.spline.penalty()
    want = np.linalg.solve(b.T @ b + 0.6 * p + math.sqrt(np.finfo(float).eps) * np.eye(26), b.T @ y)
    assert np.allclose(b @ m.coef, b @ want, atol=1e-6)
    assert 3 < m.statistics["edof"] < 26
    straight = models.fit_gam(df, "x", "y", lams=[1e9])
    assert abs(straight.statistics["edof"] - 2) < 0.1
    lo, hi = m.intervals(x[:5]).T
    assert (lo < m.predict(x[:5])).all() and (m.predict(x[:5]) < hi).all()


def test_aic_golden(spark):
    got = models.aic_from_rmse(spark.createDataFrame([(0.1707, 250), (0.1640, 250)], "rmse double, n long")).collect()
    assert abs(got[0].aic + 879.7232) < 1 and abs(got[1].aic + 899.8143) < 1


def test_folds(spark):
    got = order.kfold_assign(spark.range(13).withColumnRenamed("id", "id"), "id").groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in got) == [(1, 3), (2, 3), (3, 3), (4, 2), (5, 2)]


def test_csv_round_trip_and_resume(spark, tmp_path):
    df = spark.createDataFrame([(1, "1.5", "2"), (2, "x", "2"), (3, None, "nan")], "id long, x string, y string").selectExpr("id", "x", "y", "0.5 as GVI", "true as is_panoramic", "false as missing", "false as error")
    path = str(tmp_path / "gvi")
    assert tables.append_new(df, path) == 3 and tables.append_new(df, path) == 0
    read = tables.csv_union(spark, path)
    ok = tables.nan_to_null(tables.csv_row_validation(read))
    assert {(r.id, r.x, r.y) for r in ok.collect()} == {("1", 1.5, 2.0), ("3", None, None)}


def test_stream(spark, tmp_path):
    spark.range(5).selectExpr("id", "id * 2 as v").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
    ingest(src, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5


def test_gpkg(spark, tmp_path):
    path = str(tmp_path / "p.gpkg")
    wkb = struct.pack("<BI2d", 1, 1, 3.0, 4.0)
    with sqlite3.connect(path) as db:
        db.execute("create table points (fid integer primary key, geom POINT, name TEXT)")
        db.executemany("insert into points values (?, ?, ?)", [(i, b"GP\x00\x01" + struct.pack("<i", 4326) + wkb, f"p{i}") for i in range(7)])
    spark.dataSource.register(tables.GpkgSource)
    rows = spark.read.format("gpkg").option("path", path).option("layer", "points").load().collect()
    assert len(rows) == 7 and tables.wkb_points(bytes(rows[0].geom)) == [(3.0, 4.0)]


def test_validation():
    metrics.validate_exposure("Point", None, "euclidean", 100, None, None, None)
    metrics.validate_exposure("Polygon", "neighbourhood", None, None, None, None, None)
    for bad in (("Line", None, "euclidean", 1, None, None, None), ("Point", None, "network", 100, 5, 5, "walk"), ("Point", None, "euclidean", None, None, None, None), ("Polygon", "barn", None, None, None, None, None)):
        with pytest.raises(ValueError, match="must|needs"):
            metrics.validate_exposure(*bad)


def test_tile_semi_join_beyond_the_map(spark):
    f = spark.createDataFrame([(1, 179.0, 1.0), (2, 181.0, 1.0), (3, 542.0, 1.0), (4, -181.0, 1.0)], "image_id long, lng double, lat double")
    p = spark.createDataFrame([(179.5, 1.0), (-179.5, 1.0)], "lng double, lat double")
    assert [r.image_id for r in roads.tile_semi_join(f, p, 6).collect()] == [1]


def test_nearest_node_in_one_round(spark, monkeypatch):
    rng = np.random.default_rng(4)
    nodes = np.concatenate([rng.integers(0, 20, (150, 2)) * 10.0, rng.normal(0, 3000, (150, 2))])
    points = np.concatenate([rng.integers(0, 40, (80, 2)) * 5.0, rng.normal(0, 3000, (40, 2)), rng.normal(0, 2e6, (40, 2))])
    d2 = (points[:, :1] - nodes[:, 0]) ** 2 + (points[:, 1:] - nodes[:, 1]) ** 2
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(points)], "id long, x double, y double")
    n = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(nodes)], "node long, x double, y double")
    written, write = [], spatial.write_layer
    monkeypatch.setattr(spatial, "SENT_NODES", 40)
    monkeypatch.setattr(spatial, "TILE_NODES", 2, raising=False)
    monkeypatch.setattr(spatial, "PIECE_POINTS", 7, raising=False)
    monkeypatch.setattr(spatial, "write_layer", lambda df, path: written.append(path) or write(df, path))
    got = {r.id: (r.node, r.distance) for r in spatial.nearest_node(p, n, 1.0).collect()}
    assert got == {i: (int(d2[i].argmin()), math.sqrt(d2[i].min())) for i in range(len(points))}
    assert len(written) == 2


@pytest.mark.parametrize("sent", [1, 20_000])
def test_nearest_node_of_repeated_ids(spark, monkeypatch, sent):
    monkeypatch.setattr(spatial, "SENT_NODES", sent)
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 9.0, 0.0), (2, 2.0, 0.0)], "id long, x double, y double")
    n = spark.createDataFrame([(5, 3.0, 0.0), (6, 10.0, 0.0), (4, 10.0, 0.0), (7, float("inf"), 0.0)], "node long, x double, y double")
    assert sorted(tuple(r) for r in spatial.nearest_node(p, n, 1.0).collect()) == [(1, 4, 1.0), (2, 5, 1.0)]
