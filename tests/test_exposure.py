"""Exposure operators and sinks on small cases."""

import numpy as np
import pytest

from verdantspark.functions import text
from verdantspark.operators import exposure, spatial
from verdantspark.sources import sinks


def test_nearest_node_in_rings(spark, monkeypatch):
    rng = np.random.default_rng(4)
    nodes = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((40, 2)) * 100)] + [(99, 1e6, 1e6)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((60, 2)) * 300 - 100)] + [(100, 9e5, 1e6), (101, None, 1.0), (102, -5e5, 0.0)]
    n, p = spark.createDataFrame(nodes, "node long, x double, y double"), spark.createDataFrame(points, "id long, x double, y double")
    want = {r.id: (r.node, round(r.distance, 6)) for r in spatial.nearest_node(p, n, 3.0).collect()}
    monkeypatch.setattr(spatial, "SENT_NODES", 5)
    assert {r.id: (r.node, round(r.distance, 6)) for r in spatial.nearest_node(p, n, 3.0).collect()} == want
    assert len(want) == 62 and want[100][0] == 99


def test_extent(spark):
    inner = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, 0.0, 0.0, 3.0, 3.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    assert exposure.check_extent(inner, (0, 0, 3, 3), "Polygon")
    with pytest.warns(UserWarning):
        assert not exposure.check_extent(inner, (0.5, 0.5, 3, 3), "Polygon")
    with pytest.raises(ValueError):
        exposure.check_extent(inner, (1.5, 1.5, 1.7, 1.7), "Point")
    with pytest.raises(ValueError):
        exposure.check_extent(inner, (5, 5, 6, 6), "Polygon")
    border = spark.createDataFrame([(1, 0.0, 1.0)], "id int, x double, y double")
    with pytest.raises(ValueError):
        exposure.check_extent(exposure.as_boxes(border), (0, 0, 3, 3), "Point")


def test_isochrone_holes_are_filled(spark):
    """A square of streets: its inside is surrounded, what an open end leaves is not."""
    corners = {0: (0.0, 0.0), 1: (200.0, 0.0), 2: (200.0, 200.0), 3: (0.0, 200.0), 4: (400.0, 0.0)}
    ends = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 4)]
    edges = spark.createDataFrame([(u, v, *corners[u], *corners[v], 200.0) for a, b in ends for u, v in ((a, b), (b, a))], "u long, v long, x0 double, y0 double, x1 double, y1 double, length double")
    nodes = spark.createDataFrame([(n, *xy) for n, xy in corners.items()], "node long, x double, y double")
    places = spark.createDataFrame([(7, 0)], "id long, node long")
    cells = {(r.cx, r.cy): r.hole for r in exposure.build_aoi(places, "network", 900.0, nodes, edges).collect()}
    assert cells[20, 20] and not cells[20, 0] and (60, 20) not in cells and not cells[60, 0]
    assert sum(cells.values()) == 30 * 30


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    built = []

    def build():
        built.append(1)
        return df

    path = f"file://{tmp_path}/once"
    assert sinks.built_once(spark, path, build).count() == sinks.built_once(spark, path, build).count() == 2 and len(built) == 1
    assert sinks.write_exposure(df, f"file://{tmp_path}", "/x/y/homes.v1.gpkg", "park").endswith("homes.v1_ParkPerc_added")
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "12.jpg").write_bytes(b"abc")
    assert [(r.image_id, bytes(r.content)) for r in sinks.read_images(spark, f"file://{tmp_path}/img", "*.jpg").collect()] == [("12", b"abc")]
    assert text.elapsed(3661) == "1:01:01"
