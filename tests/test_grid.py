"""Grids and windows against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import grid, spatial, terrain
from lodestrata.operators.grid import Meta


def cells(spark, a):
    rows = [(int(r), int(c), float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1]) if np.isfinite(a[r, c])]
    return spark.createDataFrame(rows, "r int, c int, v double")


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for row in df.collect():
        if row[name] is not None:
            out[row["r"], row["c"]] = row[name]
    return out


@pytest.fixture
def world():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(13, 17))
    a[4, 5] = a[0, 0] = np.nan
    return a, Meta(13, 17, 500_000, 4_000_000, 100, -100)


def test_box_mean(spark, world):
    a, meta = world
    pad = np.pad(a, 2, mode="symmetric")
    want = np.array([[np.nanmean(pad[r : r + 5, c : c + 5]) for c in range(17)] for r in range(13)])
    assert np.allclose(array(terrain.box_mean(cells(spark, a), meta, 5), a.shape), want)


def test_gradients(spark, world):
    a, meta = world
    gy, gx = np.gradient(a, 100.0)
    got = array(terrain.slope(cells(spark, a), meta), a.shape)
    assert np.allclose(got, np.hypot(gx, gy), equal_nan=True)
    curve = np.gradient(gx, 100.0, axis=1) + np.gradient(gy, 100.0, axis=0)
    assert np.allclose(array(terrain.curvature(cells(spark, a), meta), a.shape), curve, equal_nan=True)


def test_max_filter(spark, world):
    a, meta = world
    pad = np.pad(a, 2, constant_values=np.nan)
    want = np.array([[np.nanmax(pad[r : r + 5, c : c + 5]) for c in range(17)] for r in range(13)])
    assert np.allclose(array(terrain.max_filter(cells(spark, a), meta, 5), a.shape), want)


def test_odd_window():
    assert [terrain.odd_window(s, 100) for s in (0, 90, 1000, 250, 350)] == [1, 1, 11, 3, 5]


def test_distance_is_exact(spark):
    meta = Meta(20, 15, 0, 0, 100, -50)
    marks = [(2, 3), (17, 1), (9, 14)]
    want = np.array([[min(np.hypot((r - a) * 50, (c - b) * 100) for a, b in marks) for c in range(15)] for r in range(20)])
    got = spatial.distance(spark.createDataFrame(marks, "r int, c int"), meta)
    assert np.allclose(array(got, (20, 15), "d"), want)
    assert spatial.distance(spark.createDataFrame([], "r int, c int"), meta).count() == 0


def test_align_to_itself(spark, world):
    a, meta = world
    assert np.allclose(array(grid.align(cells(spark, a), meta, meta), a.shape), a, equal_nan=True)


def test_decimate_moves_the_cell_size(spark):
    a = np.arange(36.0).reshape(6, 6)
    out, meta = grid.decimate(cells(spark, a), Meta(6, 6, 0, 0, 10, -10), 3, 2)
    assert (meta.dx, meta.dy) == (30, -20)
    assert np.allclose(array(out, (3, 2)), a.reshape(3, 2, 2, 3).mean(axis=(1, 3)))


def test_crop_and_mask(spark):
    a = np.arange(64.0).reshape(8, 8)
    out, meta = grid.center_crop(cells(spark, a), Meta(8, 8, 0, 0, 1, -1))
    assert (meta.x0, meta.y0) == (2, -2) and np.allclose(array(out, (4, 4)), a[2:6, 2:6])
    m = grid.mask(spark.createDataFrame([(0, 0, -9999.0), (0, 1, 1e31), (0, 2, 5.0), (0, 3, float("nan"))], "r int, c int, v double"), -9999.0)
    assert [r["v"] for r in m.orderBy("c").collect()] == [None, None, 5.0, None]


def test_median_fill_of_an_empty_layer(spark):
    wide = spark.createDataFrame([(0, 0, 1.0, None), (0, 1, None, None), (0, 2, 5.0, None)], "r int, c int, a double, b double")
    rows = grid.median_fill(wide, ["a", "b"]).orderBy("c").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, 0), (3, 0), (5, 0)]


def test_polygon_and_line(spark):
    meta = Meta(10, 10, 0, 10, 1, -1)
    x, y = grid.pixel_to_world(meta, F.col("r"), F.col("c"))
    inside = grid.cells(spark, meta).filter(spatial.inside_ring(x, y, [(2, 2), (6, 2), (6, 7), (2, 7)]))
    assert {(r["r"], r["c"]) for r in inside.collect()} == {(r, c) for r in range(3, 8) for c in range(2, 6)}
    line = spatial.burn_line(meta, [(0.5, 9.5), (3.5, 9.5)], grid.cells(spark, meta))
    assert {(r["r"], r["c"]) for r in line.collect()} == {(0, c) for c in range(4)}


def test_geographic_metres():
    dx, dy = Meta(10, 10, 0, 60.05, 0.01, -0.01, geographic=True).metres()
    assert abs(dx / dy - 0.5) < 0.01 and abs(dy - 1113.2) < 0.1


def test_points_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([(int(a), int(b), i, float(v)) for i, (a, b, v) in enumerate(rng.integers(0, 12, (30, 3)))], "r int, c int, ord long, v double")
    every = grid.cells(spark, Meta(12, 12))
    whole = array(spatial.idw(every, points), (12, 12))
    one = sorted(map(tuple, spatial.nearest(every, points).select("r", "c", "dist", "p_ord").collect()))
    assert one == sorted(map(tuple, spatial.nearest_on_grid(points, Meta(12, 12, dx=1.0, dy=-1.0)).select("r", "c", "dist", "p_ord").collect()))
    monkeypatch.setattr(spatial, "FEW", 7)
    assert np.allclose(whole, array(spatial.idw(every, points), (12, 12)))
    assert one == sorted(map(tuple, spatial.nearest(every, points).select("r", "c", "dist", "p_ord").collect()))
