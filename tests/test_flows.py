"""From lines to reports on a small made-up street."""

from pyspark.sql import functions as F

from verdantspark.plans import flows


def test_street(spark):
    p = lambda x, y: {"x": float(x), "y": float(y)}
    lines = spark.createDataFrame([(0, "a", [p(0, 0), p(120, 0)]), (1, "b", [p(0, 0), p(0, 160)]), (2, "c", [p(500, 500), p(500.5, 500)])], "seq long, road_index string, line array<struct<x:double,y:double>>")
    points = flows.sample_points(lines, 50)
    assert {(r.id, r.road_index, r.x, r.y) for r in points.collect()} == {(0, "a", 0, 0), (1, "a", 50, 0), (2, "a", 100, 0), (3, "b", 0, 50), (4, "b", 0, 100), (5, "b", 0, 150)}
    geo = lambda df: df.withColumns({"lng": F.col("x") / 1e5 + 5, "lat": F.col("y") / 1e5 + 52})
    features = spark.createDataFrame([("i1", 3.0, 4.0, False), ("i2", 52.0, 0.0, False), ("i3", 0.0, 120.0, True), ("i4", 9e5, 9e5, True)], "image_id string, x double, y double, is_pano boolean")
    met = flows.points_with_images(geo(points), geo(features))
    assert {r.id: (r.image_id, r.distance) for r in met.collect()} == {0: ("i1", 5.0), 1: ("i2", 2.0), 2: ("", None), 3: ("", None), 4: ("i3", 20.0), 5: ("", None)}
    road = [[0 if j == 2 and i > 0 else 8 for j in range(8)] for i in range(8)]
    masks = spark.createDataFrame([("i1", road), ("i3", [[8] * 8] * 8)], "image_id string, mask array<array<int>>")
    results = flows.greenery(met, masks)
    got = {r.id: (r.gvi, r.missing, r.error) for r in results.collect()}
    assert got[0] == (57 / 64, False, False) and got[1] == (None, True, True) and got[2] == (None, True, False) and got[4] == (1.0, False, False)
    cells = spark.createDataFrame([(float(x), float(y), (x + y) / 400) for x in range(0, 160, 10) for y in range(0, 160, 10)], "x double, y double, ndvi double")
    filled = flows.imputed(results, cells)
    assert filled.count() == 6 and filled.filter("gvi is null").count() == 0
    streets = spark.createDataFrame([("a", 120.0, "x", "t"), ("b", 160.0, "y", "t"), ("c", 0.5, "y", "t")], "road_id string, length double, highway string, city string")
    rollup, scores = flows.report(streets, met, results)
    assert {r.road_id: (r.null_points_count, r.total_points) for r in rollup.collect()} == {"a": (2, 3), "b": (2, 3), "c": (None, None)}
    s = scores.first()
    assert (s.total, s.total_null, s.unavailable, s.unsuitable) == (6, 4, 3, 1) and s.availability == 0.5
