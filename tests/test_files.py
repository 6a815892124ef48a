"""Files in and out: rasters, shapes, deposits, and the pipeline over a world with a planted signal."""

import csv
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import crs
from lodestrata.operators import grid, spatial
from lodestrata.operators.grid import Meta
from lodestrata.operators import depth, targets
from lodestrata.plans import layers, pipeline
from lodestrata.plans.catalog import Store
from lodestrata.sources import geotiff
from tests.test_grid import array, cells
from tests import worlds
from tests.test_layers import META, write_shapes


def lzw(data: bytes) -> bytes:
    """A plain LZW encoder of the format's kind."""
    out, bits, have = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, have
        bits, have = (bits << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append((bits >> have) & 255)
        bits &= (1 << have) - 1

    table, size, width, word = {bytes([i]): i for i in range(256)}, 258, 9, b""
    put(256, 9)
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word], width)
        table[word + bytes([b])] = size
        size += 1
        width = max(9, min(12, size.bit_length()))
        word = bytes([b])
        if size == 4094:
            put(256, width)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
    put(table[word], width)
    size += 1
    put(257, max(9, min(12, size.bit_length())))
    if have:
        out.append((bits << (8 - have)) & 255)
    return bytes(out)


def tiff(path, a, packed, predictor, tile=None, end="<", apart=False, big=False):
    """A file of a (rows, columns) or of bands (rows, columns, bands), interleaved or apart."""
    a = a.reshape(*a.shape[:2], -1)
    h, w, s = a.shape
    bh, bw = tile or (3, w)
    fill = np.zeros((-(-h // bh) * bh, -(-w // bw) * bw, s), a.dtype)
    fill[:h, :w] = a
    blocks = []
    for own in [fill[:, :, i : i + 1] for i in range(s)] if apart else [fill]:
        for r in range(0, len(fill) if tile else h, bh):
            for c in range(0, fill.shape[1], bw):
                b = np.ascontiguousarray(own[r : r + bh if tile else min(r + bh, h), c : c + bw])
                if predictor == 2:
                    b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])).astype(b.dtype)
                raw = b.astype(b.dtype.newbyteorder(end)).tobytes()
                if predictor == 3:
                    planes = b.astype(b.dtype.newbyteorder(">")).view(np.uint8).reshape(len(b), -1, b.dtype.itemsize).transpose(0, 2, 1).reshape(len(b), -1, b.shape[2])
                    raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).astype(np.uint8).tobytes()
                blocks.append({1: bytes, 5: lzw, 8: zlib.compress, 32773: lambda x: b"".join(bytes([len(x[i : i + 100]) - 1]) + x[i : i + 100] for i in range(0, len(x), 100))}[packed](raw))
    word, room, head = ("Q", 8, 16) if big else ("I", 4, 8)
    offsets = np.cumsum([head] + [len(b) for b in blocks]).tolist()
    number = 16 if big else 4
    places, sizes = (number, offsets[:-1]), (number, [len(b) for b in blocks])
    fields = {256: (4, [w]), 257: (4, [h]), 258: (3, [a.dtype.itemsize * 8] * s), 259: (3, [packed]), 277: (3, [s]), 284: (3, [2 if apart else 1]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * s)}
    fields |= {322: (3, [bw]), 323: (3, [bh]), 324: places, 325: sizes} if tile else {273: places, 278: (3, [bh]), 279: sizes}
    lists, body = b"", b""
    for tag, (kind, values) in sorted(fields.items()):
        data = struct.pack(f"{end}{len(values)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind]}", *values)
        body += struct.pack(f"{end}HH{word}", tag, kind, len(values))
        body += data.ljust(room, b"\0") if len(data) <= room else struct.pack(end + word, offsets[-1] + len(lists))
        lists += data if len(data) > room else b""
    at = offsets[-1] + len(lists)
    first = struct.pack(end + "HHHQ", 43, 8, 0, at) if big else struct.pack(end + "HI", 42, at)
    path.write_bytes((b"II" if end == "<" else b"MM") + first + b"".join(blocks) + lists + struct.pack(end + ("Q" if big else "H"), len(fields)) + body + b"\0" * room)
    return str(path)


@pytest.mark.parametrize("packed, predictor, kind, tile, end", [(1, 1, "f4", None, "<"), (5, 1, "u1", None, "<"), (5, 2, "i2", (16, 16), ">"), (8, 2, "u2", (16, 32), "<"), (8, 3, "f4", (16, 16), "<"), (5, 3, "f8", None, ">"), (32773, 1, "i4", None, "<")])
def test_blocks_of_every_kind(spark, tmp_path, packed, predictor, kind, tile, end):
    rng = np.random.default_rng(3)
    a = (rng.integers(0, 200, (21, 37)) + np.arange(37)).astype(kind)
    meta, rows = geotiff.read(spark, tiff(tmp_path / "a.tif", a, packed, predictor, tile, end))
    assert (meta.h, meta.w) == a.shape and np.array_equal(array(rows, a.shape), a.astype(float))


@pytest.mark.parametrize("packed, predictor, kind, tile, end, apart", [(1, 1, "u1", None, "<", False), (8, 2, "i2", (16, 16), ">", False), (5, 3, "f4", (16, 16), "<", False), (8, 3, "f8", None, "<", True), (5, 2, "u2", (16, 32), "<", True)])
@pytest.mark.parametrize("big", [False, True])
def test_first_band_of_classic_and_big_files(spark, tmp_path, packed, predictor, kind, tile, end, apart, big):
    a = np.random.default_rng(5).integers(0, 200, (21, 37, 3)).astype(kind)
    _, rows = geotiff.read(spark, tiff(tmp_path / "a.tif", a, packed, predictor, tile, end, apart, big))
    assert np.array_equal(array(rows, a.shape[:2]), a[:, :, 0].astype(float))


def test_lzw_tables_grow_and_clear():
    data = np.random.default_rng(1).integers(0, 7, 60_000).astype(np.uint8).tobytes()
    assert geotiff.unpack_lzw(lzw(data)) == data


def test_decimation_by_area(spark, tmp_path):
    a = np.random.default_rng(2).normal(size=(30, 20))
    a[4, 5] = np.nan
    got, meta = grid.decimate(cells(spark, a), Meta(30, 20, 0, 0, 10, -10), 12, 7)
    share = lambda n, m: np.array([[max(0, min((j + 1) * n / m, i + 1) - max(j * n / m, i)) for i in range(n)] for j in range(m)])
    p, q = share(30, 12), share(20, 7)
    want = (p @ np.nan_to_num(a) @ q.T) / (p @ np.isfinite(a) @ q.T)
    assert np.allclose(array(got, (12, 7)), want) and np.isclose(meta.dx * 7, 200)
    geotiff.write(cells(spark, a), Meta(30, 20, 5, 6, 10, -10, "EPSG:32612"), str(tmp_path / "d.tif"), 32612, rows=7)
    meta, rows = geotiff.load(spark, str(tmp_path / "d.tif"), "center", 15)
    assert (meta.h, meta.w, meta.crs) == (7, 5, "EPSG:32612") and rows.count() == 35


def test_rasters_of_another_projection(spark, tmp_path):
    """A raster in degrees, equal to its longitude, is aligned to a UTM grid."""
    n, degrees = 80, Meta(80, 80, -111.02, 36.16, 0.001, -0.001, "EPSG:4326", True)
    lon = np.tile(degrees.x0 + (np.arange(n) + 0.5) * 0.001, (n, 1))
    geotiff.write(cells(spark, lon), degrees, str(tmp_path / "lon.tif"), 4326)
    got = geotiff.load_aligned(spark, str(tmp_path / "lon.tif"), META)
    x, y = grid.pixel_to_world(META, F.col("r"), F.col("c"))
    want = crs.to_wgs84(x, y, 32612)[0]
    assert got.count() == 400 and got.select(F.max(F.abs(F.col("v") - want))).first()[0] < 1e-5
    far = Meta(20, 20, 700_000, 4_100_000, 100, -100, "EPSG:32612")
    assert geotiff.load_aligned(spark, str(tmp_path / "lon.tif"), far) is None


def test_percentiles_by_refinement(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=3_000), np.full(500, 0.25), [1e9, -1e9]])
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for direct in (1_000_000, 50):
        assert np.allclose(grid.percentiles(rows, "v", [0, 0.125, 0.5, 0.95, 1]), np.quantile(v, [0, 0.125, 0.5, 0.95, 1]))
    assert grid.percentiles(rows.limit(0), "v", [0.5]) == [None]


def test_nearest_marks_and_ties(spark):
    rng = np.random.default_rng(6)
    for dx, dy, n in ((100, -100, 9), (100, -50, 14), (30, -70, 1)):
        meta = Meta(15, 17, 0, 0, dx, dy)
        marks = [(int(a), int(b), int(i)) for i, (a, b) in zip(rng.permutation(n), rng.integers(0, 15, (n, 2)))]
        got = {(r["r"], r["c"]): (r["d"], r["ord"]) for r in spatial.nearest_marks(spark.createDataFrame(marks, "r int, c int, ord long"), meta).collect()}
        for r in range(15):
            for c in range(17):
                d, o = min((((r - a) * dy) ** 2 + ((c - b) * dx) ** 2, i) for a, b, i in marks)
                assert np.isclose(got[r, c][0], np.sqrt(d)) and got[r, c][1] == o


WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]'


def test_shapes_find_their_projection(spark, tmp_path):
    line = [[[(500_050.0, 3_999_931.0), (501_937.0, 3_998_557.0)]]]
    want = array(layers.shapefile_layer(spark, write_shapes(tmp_path / "m.shp", 3, line), META), (20, 20))
    p = spark.createDataFrame(line[0][0], "x double, y double")
    lon, lat = crs.to_wgs84(F.col("x"), F.col("y"), 32612)
    degrees = [[[tuple(r) for r in p.select(lon, lat).collect()]]]
    path = write_shapes(tmp_path / "g.shp", 3, degrees)
    assert np.allclose(array(layers.shapefile_layer(spark, path, META), (20, 20)), want)  # by their look
    (tmp_path / "g.prj").write_text(WGS84)
    assert np.allclose(array(layers.shapefile_layer(spark, path, META), (20, 20)), want)
    x, y = crs.to_utm(lon, lat, 32613)
    path = write_shapes(tmp_path / "z.shp", 3, [[[tuple(r) for r in p.select(x, y).collect()]]])
    (tmp_path / "z.prj").write_text('PROJCS["WGS_1984_UTM_Zone_13N",GEOGCS["GCS_WGS_1984"]]')
    assert np.allclose(array(layers.shapefile_layer(spark, path, META), (20, 20)), want)
    (tmp_path / "z.prj").write_text('PROJCS["Lambert"]')
    with pytest.raises(ValueError, match="not supported"):
        layers.shapefile_layer(spark, path, META)


def test_holes_and_empty_layers(spark, tmp_path):
    box = lambda x, y, n: [(x, y), (x + n, y), (x + n, y - n), (x, y - n), (x, y)]
    a = array(layers.shapefile_layer(spark, write_shapes(tmp_path / "p.shp", 5, [[box(500_110.0, 3_999_890.0, 1_480), box(500_410.0, 3_999_590.0, 880)]]), META), (20, 20))
    assert a[2, 2] == 1 and a[8, 8] < 1 and a[8, 2] == 1
    far = [[[(600_000.0, 3_999_950.0), (601_000.0, 3_998_050.0), (602_000.0, 3_998_050.0)]]]
    for kind in (3, 5):
        assert (array(layers.shapefile_layer(spark, write_shapes(tmp_path / f"e{kind}.shp", kind, far), META), (20, 20)) == 0).all()
    with pytest.raises(ValueError, match="enough points"):
        layers.shapefile_layer(spark, write_shapes(tmp_path / "s.shp", 3, [[[(1.0, 2.0)]]]), META)


def dbf(path, names, rows):
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([12, 0]) + b"\0" * 14 for n in names)
    body = b"".join(b" " + b"".join(str(v).encode().ljust(12) for v in r) for r in rows)
    path.write_bytes(struct.pack("<B3BiHH", 3, 0, 0, 0, len(rows), 33 + 32 * len(names), 1 + 12 * len(names)) + b"\0" * 20 + fields + b"\r" + body)


def test_deposits_of_tables_and_shapes(spark, tmp_path):
    valid = grid.cells(spark, META).filter("r <> 3")
    (tmp_path / "d.csv").write_text("site_name,longitude,latitude,commod1,commod2,dev_stat\na,500050,3999950,Gold,copper,Producer\nb,500150,3999650,copper,,Producer\nc,501000,3999000,iron,,Producer\nd,-110.9999,36.1305,Cu,,Occurrence\ne,900000,1,Cu,,x\n")
    load = lambda path, **how: {r["name"]: (r["r"], r["c"], r["rank"]) for r in layers.load_deposits(spark, str(path), META, "copper", valid, **how).collect()}
    got = load(tmp_path / "d.csv")
    assert set(got) == {"a", "d"} and got["a"] == (0, 0, 4) and got["d"][2] == 1
    assert set(load(tmp_path / "d.csv", least_rank=2)) == {"a"}
    (tmp_path / "n.csv").write_text("name,lon,lat\nz,500050,3999950\n")
    assert set(load(tmp_path / "n.csv")) == {"z"}
    # points of shapes as the writer of multipoints has them
    path = write_shapes(tmp_path / "s.shp", 8, [[[(500_050.0, 3_999_950.0)]], [[(500_250.0, 3_999_950.0)]], [[(500_450.0, 3_999_950.0)]]])
    dbf(tmp_path / "s.dbf", ["SITE_NAME", "COMMOD1"], [("p", "Copper"), ("q", ""), ("r", "Iron")])
    assert load(path) == {"p": (0, 0, 1), "q": (0, 2, 1)}
    with pytest.raises(ValueError, match="must be points"):
        load(write_shapes(tmp_path / "l.shp", 3, [[[(500_050.0, 3_999_950.0), (500_060.0, 3_999_950.0)]]]))


def test_value_fields():
    assert layers.value_column({"id": "7", "cu_ppm": "x", "Au_PPB": "3.5", "value": "1"}) == "Au_PPB"
    assert layers.value_column({"name": "a"}) is None


def test_config_names_missing_files(tmp_path):
    c = pipeline.Config(dem=str(tmp_path / "no.tif"), rasters={"m": str(tmp_path / "m.tif")}, commodity="tin", blend=0.9, depth_window=20)
    assert len(c.problems()) == 5 and pipeline.Config.from_json(c.to_json()) == c


def test_a_planted_signal_is_found(spark, tmp_path):
    """The whole pipeline from files: a signal is validated, targets lie on deposits, and every artifact can be read."""
    world = worlds.build(spark, str(tmp_path / "w"), 11, 150, buried=True)
    store = Store(spark, str(tmp_path / "db"))
    out = str(tmp_path / "out")
    config = worlds.config(world, trees=20, folds=3, depth_window=32)
    config.vectors["broken"] = world.files["dem"].replace("dem.tif", "notes.txt")
    result = pipeline.run_files(spark, config, out, store)
    assert result.cv["auc_mean"] > 0.75 and any("broken" in w for w in result.warnings)
    hits = targets.recovery(result.targets, spark.createDataFrame(world.deposits, "r int, c int")).first()
    assert hits["n"] > 0 and hits["hits"] >= 0.6 * hits["n"]
    t = result.targets.orderBy("rank").first()
    lon, lat = spark.createDataFrame([(t["x"], t["y"])], "x double, y double").select(*crs.to_wgs84(F.col("x"), F.col("y"), 32633)).first()
    assert np.isclose(t["longitude"], lon) and np.isclose(t["latitude"], lat) and 41 < lat < 42
    for name in ("probability", "uncertainty", "classes", "dem", "depth_spectral_m", "depth_euler_m"):
        meta, rows = geotiff.read(spark, f"{out}/{name}.tif")
        assert (meta.h, meta.w, meta.crs) == (150, 150, "EPSG:32633") and rows.count() > 0
    with open(f"{out}/targets.csv", newline="") as f:
        rows = list(csv.reader(f))
    assert rows[0][:4] == ["rank", "latitude", "longitude", "probability"] and rows[-2][0] == "GRADE CONTEXT" and rows[-1][0] == "NOTE"
    assert abs(float(rows[1][1]) - lat) < 1e-5
    report, page = (open(f"{out}/{n}").read() for n in ("report.md", "summary.md"))
    assert result.verdict in report and "Depths of all targets" in report and "P50" in report and "times in 100" in page
    assert pipeline.Config.from_json(open(f"{out}/run_config.json").read()) == config
    assert store.read("runs").first()["status"] == "done" and store.read("metrics").filter("key = 'auc_mean'").count() == 1
    bodies = spark.createDataFrame(world.bodies, "r int, c int, depth double")
    error = depth.depth_error(bodies, result.depth_euler).first()
    assert error["n"] > 10 and error["median_error"] < 1.0


def test_a_confound_is_exposed(spark, tmp_path):
    world = worlds.build(spark, str(tmp_path / "w"), 23, 120, buried=False)
    result = pipeline.run_files(spark, worlds.config(world, trees=10, depths=False), str(tmp_path / "out"))
    assert result.verdict != "VALIDATED" or result.holdout.get("contrast_matched") is not None
