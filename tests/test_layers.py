"""Layers from shapes and points, and the pipeline's checks."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import grid, spatial
from lodestrata.operators.grid import Meta
from lodestrata.plans import layers, pipeline
from tests.test_grid import array, cells

META = Meta(20, 20, 500_000, 4_000_000, 100, -100, "EPSG:32612")


def test_points_become_values_or_proximity(spark):
    points = spark.createDataFrame([(500_050.0 + 300 * i, 3_999_950.0 - 200 * i, 10.0 * i) for i in range(6)], "x double, y double, v double")
    a = array(layers.point_layer(points, META, True), (20, 20))
    assert abs(a[0, 0] - 0) < 0.5 and a.max() <= 50
    b = array(layers.point_layer(points, META, False), (20, 20))
    assert b[0, 0] == 1 and abs(b[0, 1] - (1 - 100 / 5_000)) < 1e-9
    assert array(layers.point_layer(points.limit(0), META, True), (20, 20)).max() == 0
    c = array(layers.nearest_layer(points, META), (20, 20))
    assert 0 < c.min() and c.max() == 1
    with pytest.raises(ValueError):
        layers.nearest_layer(points.limit(1), META)


def test_geographic_points_are_projected(spark):
    p = spark.createDataFrame([(-111.0, 36.1)], "x double, y double")
    assert abs(layers.to_grid_crs(p, META).first()["x"] - 500_000) < 1e-3
    metres = spark.createDataFrame([(500_100.0, 3_999_000.0)], "x double, y double")
    assert layers.to_grid_crs(metres, META).first()["x"] == 500_100
    w, s, e, n = layers.wgs84_bounds(spark, META)
    assert -111.001 < w < e < -110.97 and 36.1 < s < n < 36.2


def test_lines_and_polygons(spark):
    line = array(layers.line_layer([[(500_050, 3_999_050), (501_950, 3_999_050)]], META, spark), (20, 20))
    assert np.allclose(line[9], 1) and np.allclose(line[11], np.exp(-200 / 2_500))
    ring = [(500_500, 3_999_500), (501_000, 3_999_500), (501_000, 3_999_000), (500_500, 3_999_000)]
    box = array(layers.polygon_layer([ring], META, spark), (20, 20))
    assert (box[5:10, 5:10] == 1).all() and 0 < box[0, 0] < 1


def test_gaps_are_filled_before_stretching(spark):
    a = np.array([[1.0, np.nan], [np.nan, 3.0]])
    out = array(layers.fill_and_stretch(cells(spark, a), Meta(2, 2), Meta(4, 7)), (4, 7))
    assert out[0, 0] == 1 and out[3, 6] == 3 and np.allclose(out, np.array([[1, 1], [1, 3]])[0, 0] + 2 * np.outer(np.arange(4) / 3, np.arange(7) / 6))
    one = array(layers.fill_and_stretch(cells(spark, a[:1, :1]), Meta(1, 1), Meta(4, 7)), (4, 7))
    assert (one == 1).all()


def test_config():
    c = pipeline.Config(commodity="ree", trees=7)
    assert pipeline.Config.from_json(c.to_json()) == c
    for bad in ({"commodity": "tin"}, {"blend": 0.6}, {"depth_window": 20}):
        with pytest.raises(ValueError):
            pipeline.Config(**bad).check()


def test_too_few_deposits(spark, tmp_path):
    rng = np.random.default_rng(2)
    dem = cells(spark, rng.normal(size=(20, 20)).cumsum(axis=0))
    few = spark.createDataFrame([(i, i, i, "d", 1) for i in range(4)], "r int, c int, ord long, name string, rank int")
    with pytest.raises(ValueError, match="fewer"):
        pipeline.run(spark, dem, META, few, {}, str(tmp_path / "o"), pipeline.Config(terrain_scale_m=300))


def test_query_point(spark):
    layer = cells(spark, np.arange(400.0).reshape(20, 20))
    top = spark.createDataFrame([(1, 0, 0), (2, 19, 19)], "rank int, r int, c int")
    row = pipeline.query_point({"p": layer}, top, META, 501_950.0, 3_998_150.0).first()
    assert (row["r"], row["c"], row["p"], row["target"]) == (18, 19, 379.0, 2)
    assert pipeline.value_grid(layer, META, 10).count() == 100


def test_ree_grades(spark):
    maps = spark.createDataFrame([(0, 0, 0.1, 0.0), (0, 1, 0.5, 0.0), (0, 2, 0.5, 4.0)], "r int, c int, probability double, th double")
    assert [round(r["v"], 3) for r in layers.ree_grade_map(maps).orderBy("c").collect()] == [0.0, 5.25, 7.15]
    assert maps.filter(F.col("th") > 0).count() == 1


def write_shapes(path, kind, shapes):
    """A .shp of shapes, each a list of parts."""
    out = b"\0" * 100
    for parts in shapes:
        points = [p for part in parts for p in part]
        xy = struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
        starts = np.cumsum([0] + [len(p) for p in parts])[:-1].tolist()
        counts = struct.pack("<i", len(points)) if kind == 8 else struct.pack(f"<2i{len(parts)}i", len(parts), len(points), *starts)
        body = struct.pack("<i4d", kind, 0, 0, 0, 0) + counts + xy
        out += struct.pack(">2i", 1, len(body) // 2) + body
    path.write_bytes(out)
    return str(path)


def test_shapefile_has_every_shape(spark, tmp_path):
    corner = [[(500_010.0, 3_999_990.0), (500_020.0, 3_999_980.0)]]
    last = [[(501_910.0, 3_998_090.0), (501_920.0, 3_998_080.0)]]
    a = array(layers.shapefile_layer(spark, write_shapes(tmp_path / "l.shp", 3, [corner] * 10_001 + [last]), META), (20, 20))
    assert a[0, 0] == 1 and a[19, 19] == 1 and a[0, 19] < 1
    box = lambda x, y: [[(x, y), (x + 150, y), (x + 150, y - 150), (x, y - 150), (x, y)]]
    a = array(layers.shapefile_layer(spark, write_shapes(tmp_path / "p.shp", 5, [box(500_010.0, 3_999_990.0)] * 10_001 + [box(501_810.0, 3_998_190.0)]), META), (20, 20))
    assert (a[18:, 18:] == 1).all() and a[0, 19] < 1


def test_multipoint_has_every_point(spark, tmp_path):
    path = write_shapes(tmp_path / "m.shp", 8, [[[(500_050.0, 3_999_950.0), (501_950.0, 3_998_050.0)]]])
    a = array(layers.shapefile_layer(spark, path, META), (20, 20))
    assert a[0, 0] == 1 and a[19, 19] == 1


def test_many_shapes_burn_as_one_does(spark):
    rng = np.random.default_rng(8)
    parts = [[tuple(map(float, p)) for p in rng.uniform((499_600, 3_997_600), (502_400, 4_000_400), (n, 2)).round(-2 if n == 4 else 1)] for n in (2, 3, 4, 6)]
    x, y = grid.pixel_to_world(META, F.col("r"), F.col("c"))
    every = grid.cells(spark, META)
    keys = lambda d: {tuple(r) for r in d.collect()}
    parts += [[(500_050.0, 3_999_050.0), (501_950.0, 3_999_050.0)], [(500_300.0, 3_999_950.0), (500_300.0, 3_998_500.0)]]
    for part in parts:
        table = layers._parts([part], spark)
        assert keys(spatial.burn_segments(spatial.segments(table, False), META)) == keys(spatial.burn_line(META, part, every))
        assert keys(spatial.fill_rings(spatial.segments(table, True), META)) == keys(every.filter(spatial.inside_ring(x, y, part)))
    point = spatial.segments(layers._parts([[(500_150.0, 3_999_850.0)] * 2], spark), False)
    assert keys(spatial.burn_segments(point, META)) == {(1, 1)}
