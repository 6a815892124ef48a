"""Depths, targets, metrics, projections, sources, store and models against known truth."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import crs, scalar
from lodestrata.operators import deposits, depth, metrics, model, sampling, targets
from lodestrata.operators.grid import Meta
from lodestrata.plans import catalog
from tests.test_grid import array, cells


def pole(n, at, h, m=1e8, dx=100.0):
    r, c = np.mgrid[0:n, 0:n]
    return m * h / (((r - at[0]) ** 2 + (c - at[1]) ** 2) * dx * dx + h * h) ** 1.5


def test_euler_finds_a_pole(spark):
    meta = Meta(40, 40, 0, 0, 100, -100)
    a = pole(40, (20, 19), 500.0)
    got = depth.euler(cells(spark, a), meta).toPandas()
    near = got[(np.abs(got.x - 1950) < 400) & (np.abs(got.y + 2050) < 400)]
    assert len(near) and abs(near.depth.median() - 500) < 0.35 * 500


def test_vertical_derivative(spark):
    meta = Meta(64, 64, 0, 0, 100, -100)
    a, b = pole(64, (32, 32), 500.0), pole(64, (32, 32), 490.0)
    got = array(depth.vertical_derivative(cells(spark, a), meta), a.shape)
    want = (b - a) / 10
    inner = slice(12, 52)
    assert np.corrcoef(got[inner, inner].ravel(), want[inner, inner].ravel())[0, 1] > 0.97


def test_detrend_removes_a_plane(spark):
    r, c = np.mgrid[0:9, 0:11]
    got = array(depth.detrend(cells(spark, 3.0 + 2.0 * c - 0.5 * r)), (9, 11))
    assert np.abs(got).max() < 1e-9


def test_plateau_gives_separated_targets(spark):
    meta = Meta(20, 20)
    a = np.full((20, 20), 0.2)
    a[5:8, 5:8], a[15, 15], a[1, 18] = 0.9, 0.8, 0.6
    p = cells(spark, a)
    rows = targets.suppress(targets.maxima(p, meta, 5, 0.5), 5).collect()
    assert [(r["r"], r["c"]) for r in rows] == [(7, 7), (15, 15), (1, 18)]
    assert targets.suppress(targets.maxima(p, meta, 5, 0.95), 5).count() == 0


def test_any_number_of_candidates(spark, monkeypatch):
    plateau = spark.range(250_000).selectExpr("CAST(id DIV 500 AS INT) r", "CAST(id % 500 AS INT) c", "1D v")
    rows = targets.suppress(plateau, 8, 3).collect()
    assert [(r["rank"], r["r"], r["c"]) for r in rows] == [(1, 499, 499), (2, 499, 491), (3, 499, 483)]
    rng = np.random.default_rng(6)
    some = [(int(i // 20), int(i % 20), float(v)) for i, v in enumerate(rng.integers(0, 4, 400))]
    kept = []
    for r, c, v in sorted(some, key=lambda x: (-x[2], -x[0], -x[1])):
        if len(kept) < 9 and all((r - a) ** 2 + (c - b) ** 2 >= 16 for a, b, _ in kept):
            kept.append((r, c, v))
    monkeypatch.setattr(targets, "BATCH", 7)
    got = targets.suppress(spark.createDataFrame(some, "r int, c int, v double"), 4, 9).orderBy("rank").collect()
    assert [(r["r"], r["c"], r["v"]) for r in got] == kept


def test_percentiles_and_csv(spark, tmp_path):
    wide = spark.createDataFrame([(i, float(i), float(-i)) for i in range(100)], "i int, a double, b double")
    top = wide.filter("i = 99").select(F.lit(1).alias("rank"), "a", "b")
    pct = targets.percentile_of(wide, top, ["a", "b"])
    assert {(r["feature"], r["percentile"]) for r in pct.collect()} == {("a", 99), ("b", 0)}
    why = targets.why(pct, {"a": 0.2, "b": 0.7})
    t = why.selectExpr("rank", "40.5D latitude", "-112.25D longitude", "0.9D probability", "0.1D uncertainty", "2 target_class", "CAST(NULL AS DOUBLE) depth_spectral_m", "512.4D depth_euler_m", "'single-method' depth_status", "1.234D nearest_deposit_km", "'x' nearest_deposit_name", "why")
    targets.write_csv(t, str(tmp_path / "t.csv"), "note")
    row = spark.read.option("header", True).csv(str(tmp_path / "t.csv")).first().asDict()
    assert row["latitude"] == "40.500000" and row["depth_euler_m"] == "512" and row["depth_spectral_m"] is None and row["driver_1"] == "b"


def test_auc_and_ap(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 20, 300)
    pairs = [(s[i] > s[j]) + 0.5 * (s[i] == s[j]) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0)]
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    assert abs(metrics.roc_auc(df).first()[0] - np.mean(pairs)) < 1e-12
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = y[s >= t]
        ap, last = ap + (hit.sum() / y.sum() - last) * hit.mean(), hit.sum() / y.sum()
    assert abs(metrics.average_precision(df).first()[0] - ap) < 1e-12
    assert metrics.roc_auc(df.filter("label = 1")).first()[0] is None


def test_ranks_over_many_ranges(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 2_000), rng.normal(size=2_000).round(2))], "label int, score double")
    whole = metrics.roc_auc(df).first()[0], metrics.average_precision(df).first()[0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as there are partitions
    assert np.allclose(whole, (metrics.roc_auc(df).first()[0], metrics.average_precision(df).first()[0]))
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_utm_round_trip(spark):
    df = spark.createDataFrame([(-112.4, 40.8), (-110.0, 33.0), (-111.0, 0.5)], "lon double, lat double")
    x, y = crs.to_utm(F.col("lon"), F.col("lat"), 32612)
    rows = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = crs.to_wgs84(F.col("x"), F.col("y"), 32612)
    for r in rows.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-8 and abs(r["lat"] - r["lat2"]) < 1e-8
    middle = rows.collect()[2]
    assert abs(middle["x"] - 500_000) < 1e-6
    with pytest.raises(ValueError):
        crs.zone(3857)


def test_inverse_normal(spark):
    from statistics import NormalDist

    ps = [0.001, 0.02, 0.1, 0.5, 0.9, 0.99]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(scalar.ppf(F.col("p"))).collect()]
    assert np.allclose(got, [NormalDist().inv_cdf(p) for p in ps], atol=1e-7)


def test_deposits(spark):
    df = spark.createDataFrame([("Mercury", "Producer"), ("Gold", "prospect"), (None, None), ("rare earth", "??")], "commodity string, status string")
    rows = df.select(deposits.is_commodity(F.col("commodity"), "copper"), deposits.is_commodity(F.col("commodity"), "ree", True), deposits.status_rank(F.col("status"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, 4), (False, False, 2), (False, True, 1), (False, True, 1)]
    few = spark.createDataFrame([(i, i, i) for i in range(5)], "r int, c int, ord long")
    assert few.count() == deposits.holdout(few, 10, 10).filter("not held").count()


def test_negatives_shrink_their_buffer(spark):
    meta = Meta(12, 12, 0, 0, 100, -100)
    from lodestrata.operators import spatial

    marks = spark.createDataFrame([(6, 6)], "r int, c int")
    g = cells(spark, np.ones((12, 12)))
    d = spatial.distance(marks, meta).cache()
    a = sampling.negatives(g, marks, d, 5_000.0, 100.0, ratio=20).collect()
    assert len(a) == 20 and a == sampling.negatives(g.repartition(7), marks, d, 5_000.0, 100.0, ratio=20).collect()


def test_folds_are_whole_blocks(spark):
    g = cells(spark, np.ones((30, 30)))
    f = sampling.folds(g, 30, 30)
    assert f.groupBy("block").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert f.select("fold").distinct().count() == 5


def test_shapefile(spark, tmp_path):
    from lodestrata.sources import shapefile

    def shape(body):
        return struct.pack(">2i", 1, len(body) // 2) + body

    line = struct.pack("<i4d2i", 3, 0, 0, 2, 2, 1, 3) + struct.pack("<i6d", 0, 0, 0, 1, 1, 2, 2)
    point = struct.pack("<i2d", 1, 5.0, 6.0)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + shape(line) + shape(point))
    field = b"name".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(struct.pack("<B3BiHH", 3, 0, 0, 0, 2, 65, 5) + b"\0" * 20 + field + b"\r" + b" ab  " + b" cd  ")
    (tmp_path / "a.prj").write_text("WGS84")
    shapefile.register(spark)
    rows = spark.read.format("shapefile").load(str(tmp_path / "a.shp")).collect()
    assert [(r["gtype"], r["attributes"]["name"], len(r["parts"][0]), r["crs"]) for r in rows] == [("line", "ab", 3, "WGS84"), ("point", "cd", 1, "WGS84")]
    bad = struct.pack("<i", 31) + b"\0" * 40
    with pytest.raises(ValueError):
        list(shapefile.shapes(b"\0" * 100 + shape(bad)))


def test_geotiff_round_trip(spark, tmp_path):
    from lodestrata.sources import geotiff

    a = np.arange(30, dtype=float).reshape(5, 6)
    a[2, 3] = np.nan
    meta = Meta(5, 6, 500_000, 4_000_000, 100, -50)
    geotiff.write(cells(spark, a), meta, str(tmp_path / "g.tif"), 32612)
    got, rows = geotiff.read(spark, str(tmp_path / "g.tif"))
    assert (got.h, got.w, got.x0, got.y0, got.dx, got.dy, got.crs) == (5, 6, 500_000, 4_000_000, 100, -50, "EPSG:32612")
    assert np.allclose(array(rows, a.shape), a, equal_nan=True)


def test_lenient_csv(spark, tmp_path):
    from lodestrata.sources import tables

    (tmp_path / "d.csv").write_text(" Site_Name ,Latitude,LONGITUDE,commod1,dev_stat,cu_ppm\nA,40.1,-112,copper,Producer,5\nB,bad,-112,gold,,7\n")
    assert [tuple(r) for r in tables.csv_points(spark, str(tmp_path / "d.csv"), "cu_ppm").collect()] == [(-112.0, 40.1, 5.0)]
    assert tables.csv_deposits(spark, str(tmp_path / "d.csv")).first().asDict() == {"x": -112.0, "y": 40.1, "name": "A", "commodity": "copper", "status": "Producer"}
    (tmp_path / "e.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.csv_points(spark, str(tmp_path / "e.csv"))


def test_store(spark, tmp_path):
    s = catalog.Store(spark, str(tmp_path / "db"))
    s.append("projects", [("p", "Alpha", "copper", 1.0, "")])
    with pytest.raises(ValueError):
        s.append("projects", [("q", "Alpha", "ree", 2.0, "")])
    s.append("runs", [("r", "p", 10.0, None, "running", "{}", "1")])
    s.append("runs", [("r", "p", 10.0, 20.0, "done", "{}", "1")])
    s.append("metrics", [("r", "auc", 0.5, 1.0), ("r", "auc", 0.75, 2.0)])
    row = catalog.list_runs(s.read("runs"), s.read("projects"), s.read("metrics"), "auc").first()
    assert (row["project"], row["status"], row["metric"]) == ("Alpha", "done", "0.750")
    assert catalog.summary(s.read("runs"), s.read("metrics"), s.read("artifacts")).first()["value"] == {"auc": 0.75}


def test_model(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(int(i % 20), int(i // 20), int(x[0] > 0.3), *map(float, x)) for i, x in enumerate(rng.normal(size=(240, 2)))]
    samples = spark.createDataFrame(rows, "r int, c int, label int, a double, b double")
    m = model.train(samples, ["a", "b"], trees=10, folds=2)
    assert m.importances()[0][0] == "a"
    p = m.predict(samples)
    assert metrics.roc_auc(p.select("label", F.col("probability").alias("score"))).first()[0] > 0.9
    u = m.uncertainty(samples).agg(F.min("uncertainty"), F.max("uncertainty")).first()
    assert 0 <= u[0] <= u[1] <= 0.5
    m.save(str(tmp_path / "m"), spark)
    again = model.load(str(tmp_path / "m"), spark).predict(samples)
    both = p.select("r", "c", "probability").join(again.select("r", "c", F.col("probability").alias("q")), ["r", "c"])
    assert both.filter("abs(probability - q) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        model.aligned(samples.select("r", "c", "a"), ["a", "b", "d"])
    assert math.isclose(model.tier(20)[0], 5)


def test_stream(spark, tmp_path):
    from lodestrata.streaming import deposits as stream

    spark.createDataFrame([(1, 1, 1, 2), (1, 1, 2, 4), (2, 2, 3, 1)], "r int, c int, ord int, rank int").write.parquet(str(tmp_path / "in"))
    got = []
    source = spark.readStream.schema("r int, c int, ord int, rank int").parquet(str(tmp_path / "in"))
    stream.stream(source, lambda b, n: got.extend(r["ord"] for r in b.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(got) == [2, 3]
