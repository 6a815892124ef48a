"""What is read of a raster: blocks of a window, of pushed filters, and overviews."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import grid
from lodestrata.operators.grid import Meta
from lodestrata.sources import geotiff
from tests.test_files import tiff
from tests.test_grid import array, cells


def blocks(path, window):
    meta, layout, all_ = geotiff._layout(path)
    return len(geotiff.within(layout, all_, window)), len(all_)


def test_windows_read_their_blocks(spark, tmp_path):
    a = np.random.default_rng(3).normal(size=(128, 160)).astype("f4")
    path = tiff(tmp_path / "a.tif", a, 8, 3, (16, 16))
    assert blocks(path, (32, 95, 40, 119)) == (4 * 6, 8 * 10) and blocks(path, (0, 0, 0, 0))[0] == 1
    for window in ((32, 95, 40, 119), (5, 5, 0, 159), (17, 30, 33, 33)):
        _, rows = geotiff.read(spark, path, window)
        got = array(rows, a.shape)
        want = np.full(a.shape, np.nan)
        r0, r1, c0, c1 = window
        want[r0 : r1 + 1, c0 : c1 + 1] = a[r0 : r1 + 1, c0 : c1 + 1]
        assert np.allclose(got, want, equal_nan=True)


def test_the_middle_is_a_quarter(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(4).normal(size=(128, 128))
    geotiff.write(cells(spark, a), Meta(128, 128, 0, 0, 10, -10, "EPSG:32612"), str(tmp_path / "d.tif"), 32612, rows=8)
    seen = []
    plain = geotiff.read
    monkeypatch.setattr(geotiff, "read", lambda s, p, window=None, overview=0: (seen.append(window), plain(s, p, window, overview))[1])
    for most in (0, 64, 50):
        meta, rows = geotiff.load(spark, str(tmp_path / "d.tif"), "center", most)
        whole, m = grid.center_crop(*grid.limited(plain(spark, str(tmp_path / "d.tif"))[1], plain(spark, str(tmp_path / "d.tif"))[0], most))
        assert m == meta and np.allclose(array(rows, (meta.h, meta.w)), array(whole, (meta.h, meta.w)))
        read, all_ = blocks(str(tmp_path / "d.tif"), seen[-1])
        assert all_ == 16 and read <= 10  # of strips that span the file, the middle half and one more on each side


def test_filters_become_a_window(spark, tmp_path):
    a = np.random.default_rng(5).normal(size=(64, 64)).astype("f4")
    path = tiff(tmp_path / "a.tif", a, 1, 1, (16, 16))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        _, rows = geotiff.read(spark, path)
        some = rows.filter((F.col("r") >= 20) & (F.col("r") < 40) & (F.col("c") == 7) & (F.col("v") > 0))
        got = {(x["r"], x["c"]) for x in some.collect()}
        assert got == {(r, 7) for r in range(20, 40) if a[r, 7] > 0}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    meta, layout, all_ = geotiff._layout(path)
    reader = geotiff._PushingReader(layout, all_, (0, 63, 0, 63))
    assert list(reader.pushFilters([GreaterThanOrEqual(("r",), 20), LessThan(("r",), 40), EqualTo(("c",), 7)])) == []
    assert reader.window == (20, 39, 7, 7) and len(reader.blocks) == 2


def two_sizes(path, a, b):
    """An uncompressed file of a and of an overview b, one strip each."""
    data, at = b"", 8
    place, directories = [], []
    for x in (a, b):
        place.append(at + len(data))
        data += x.astype("<f4").tobytes()
    data += struct.pack("<3d", 10.0, 10.0, 0.0) + struct.pack("<6d", 0, 0, 0, 500.0, 900.0, 0)
    scale, tie = at + len(data) - 72, at + len(data) - 48
    first = at + len(data)
    for k, x in enumerate((a, b)):
        h, w = x.shape
        fields = [(254, 4, 1, k), (256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, place[k]), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, 4 * h * w), (339, 3, 1, 3)]
        fields += [(33550, 12, 3, scale), (33922, 12, 6, tie)] if k == 0 else []
        body = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields)
        after = first + len(body) + 4 if k == 0 else 0
        directories.append(body + struct.pack("<I", after))
        first = after
    path.write_bytes(b"II" + struct.pack("<HI", 42, at + len(data)) + data + b"".join(directories))
    return str(path)


def test_overviews(spark, tmp_path):
    a = np.random.default_rng(6).normal(size=(40, 60))
    b = a.reshape(20, 2, 30, 2).mean(axis=(1, 3))
    path = two_sizes(tmp_path / "o.tif", a, b)
    assert geotiff.overviews(path) == [(1, 20, 30)]
    meta, rows = geotiff.read(spark, path, overview=1)
    assert (meta.h, meta.w, meta.dx, meta.dy, meta.x0, meta.y0) == (20, 30, 20.0, -20.0, 500.0, 900.0) and np.allclose(array(rows, (20, 30)), b)
    meta, rows = geotiff.load(spark, path, "full", 30)  # the overview as it is
    assert np.allclose(array(rows, (20, 30)), b)
    meta, rows = geotiff.load(spark, path, "full", 45)  # the overview has too few cells
    assert (meta.h, meta.w) == (30, 45) and np.isclose(meta.dx, 60 * 10 / 45)
    meta, rows = geotiff.load(spark, path, "center", 15)
    half = b.reshape(10, 2, 15, 2).mean(axis=(1, 3))
    assert (meta.h, meta.w) == (5, 7) and np.allclose(array(rows, (5, 7)), half[2:7, 3:10], atol=1e-6)


def test_aligned_rasters_read_what_lies_under(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(7).normal(size=(90, 90))
    source = Meta(90, 90, 0.0, 900.0, 10.0, -10.0, "EPSG:32612")
    geotiff.write(cells(spark, a), source, str(tmp_path / "a.tif"), 32612, rows=6)
    target = Meta(12, 9, 333.0, 555.0, 7.0, -9.0, "EPSG:32612")
    seen = []
    plain = geotiff.read
    monkeypatch.setattr(geotiff, "read", lambda s, p, window=None, overview=0: (seen.append(window), plain(s, p, window, overview))[1])
    got = array(geotiff.load_aligned(spark, str(tmp_path / "a.tif"), target), (12, 9))
    want = array(grid.align(plain(spark, str(tmp_path / "a.tif"))[1], source, target), (12, 9))
    assert np.allclose(got, want, equal_nan=True) and blocks(str(tmp_path / "a.tif"), seen[-1])[0] <= 5


@pytest.mark.parametrize("end", ["<", ">"])
def test_windows_of_strips(spark, tmp_path, end):
    a = np.random.default_rng(8).integers(0, 99, (21, 37)).astype("u1")
    path = tiff(tmp_path / "a.tif", a, 5, 2, None, end)
    _, rows = geotiff.read(spark, path, (10, 10, 3, 36))
    assert rows.count() == 34 and blocks(path, (10, 10, 3, 36)) == (1, 7)
