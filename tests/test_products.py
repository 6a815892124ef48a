"""Screening, viewer tables and the store, by their rules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import model, screening, spatial
from lodestrata.operators.grid import Meta
from lodestrata.plans import catalog, viewer
from tests.test_grid import array, cells
from tests.test_layers import META, write_shapes


def test_evidence_tables_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.csv").write_text("Name,LONG_DD,lat_dd,commod1,commod2\nPorphyry hill,500050,3999950,Copper; gold,\nx,bad,1,,\nvein,500150,3999950,,iron\n")
    rows = screening.evidence_csv(spark, str(tmp_path / "in" / "r.csv"))
    assert [r["tokens"] for r in rows.collect()] == [["copper", "gold"], ["iron"]]
    got = screening.scored(rows, META, "copper").collect()
    assert len(got) == 1 and got[0]["score"] == 7.75 and (got[0]["r"], got[0]["c"]) == (0, 0)
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/mrds-x.shp", "a/b/main.shp", "a/other.shp"):
        (tmp_path / name).write_bytes(b"x")
    assert [p.rsplit("/", 1)[1] for p in screening.deposit_files(spark, str(tmp_path))] == ["main.shp", "mrds-x.shp"]
    with pytest.raises(ValueError):
        (tmp_path / "n.csv").write_text("a\n1\n")
        screening.evidence_csv(spark, str(tmp_path / "n.csv"))


def test_first_vertices(spark, tmp_path):
    from lodestrata.sources import shapefile

    shapefile.register(spark)
    path = write_shapes(tmp_path / "s.shp", 3, [[[(500_050.0, 3_999_950.0), (1.0, 1.0)]], [[(1.0, 1.0), (500_050.0, 3_999_950.0)]]])
    got = screening.first_vertices(spark.read.format("shapefile").load(path), META).collect()
    assert [(r["r"], r["c"]) for r in got] == [(0, 0)]


def test_negatives_fall_back(spark):
    dem = cells(spark, np.ones((20, 20)))
    marks = lambda some: spark.createDataFrame(some, "r int, c int")
    far = screening.negatives(dem, marks([(10, 10)]), META, "copper").collect()
    assert len(far) == 3 and all(abs(r["r"] - 10) + abs(r["c"] - 10) > 3 for r in far)
    assert len(screening.negatives(dem, marks([(10, 10)]), META, "ree").collect()) == 2  # by the fallback buffer
    every = [(r, c) for r in range(0, 20, 2) for c in range(0, 20, 2)]
    assert len(screening.negatives(dem, marks(every), Meta(20, 20, 0, 0, 10, -10), "copper").collect()) == 200
    with pytest.raises(ValueError):
        screening.negatives(dem, marks([(r, c) for r in range(20) for c in range(20)]), META, "copper")
    low = screening.negatives(cells(spark, np.where(np.arange(20)[:, None] > 17, 5.0, -1.0) * np.ones((20, 20))), marks([(0, 0)]), META, "copper").collect()
    assert all(r["r"] > 17 for r in low)


def test_block_split_needs_both_labels(spark):
    rows = [(r, c, (r + c) % 2) for r in range(20) for c in range(20)]
    split = screening.block_split(spark.createDataFrame(rows, "r int, c int, label int"), 20, 20)
    assert split.groupBy("block").agg(F.countDistinct("test").alias("n")).filter("n > 1").count() == 0
    few = screening.block_split(spark.createDataFrame([(0, 0, 1), (0, 1, 0)] * 4, "r int, c int, label int"), 20, 20)
    assert few.count() == 8 and few.filter("test").count() > 0


def test_transfer(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i % 20, i // 20, int(x[0] > 0), *map(float, x)) for i, x in enumerate(rng.normal(size=(200, 3)))]
    samples = spark.createDataFrame(rows, "r int, c int, label int, a double, b double, d double")
    model.train(samples, ["a", "b", "d"], 5, folds=2).save(str(tmp_path / "m"), spark)
    few = samples.limit(4)
    how, out, warnings = screening.train_or_transfer(few, samples.select("r", "c", "a"), ["a"], 50, str(tmp_path / "m"), spark)
    assert how == "transferred" and len(warnings) == 1 and out.filter("probability IS NULL").count() == 0
    with pytest.raises(ValueError):
        screening.train_or_transfer(few, samples, ["a"], 50, None, spark)
    assert screening.trees_for(10) == 100 and screening.trees_for(50) == 150 and screening.trees_for(500) == 200


def test_sampled_proximity(spark):
    shapes = spark.createDataFrame([("point", [[{"x": 500_550.0, "y": 3_999_450.0}]]), ("line", [[{"x": 1.0, "y": 1.0}]])], "gtype string, parts array<array<struct<x:double,y:double>>>")
    a = array(screening.sampled_proximity(shapes, META, 10.0), (20, 20))
    assert (a[3:8, 3:8] == 1).all() and np.isclose(a[5, 9], 0.8) and a[19, 19] == 0
    assert (array(screening.sampled_proximity(shapes.limit(0), META), (20, 20)) == 0).all()


def test_value_columns():
    assert screening.value_column("nure_th", {"id": "1", "lat": "2", "eTh": "4"}) == "eTh"
    assert screening.value_column("zinc", {"OBJECTID": "1", "Zinc_ppm": "4"}) == "Zinc_ppm"
    assert screening.value_column("q", {"name": "a", "rastervalu": "3", "m": "4"}) == "m"
    assert screening.element_field(["LAT", "ZN_PPM", "CU_PPM"]) == "CU_PPM" and screening.element_field(["x", "Q"]) == "Q" and screening.element_field([]) is None


def test_stretches(spark):
    a = np.array([[-4.0, np.nan, 2.0, 8.0]])
    rows = spark.createDataFrame([(0, i, None if np.isnan(v) else float(v)) for i, v in enumerate(a[0])], "r int, c int, v double")
    full = np.nan_to_num(a)
    assert np.allclose(array(screening.stretch_positive(rows), (1, 4)), np.clip(full / np.quantile([2, 8], 0.95), 0, 1))
    assert np.allclose(array(screening.stretch_symmetric(rows), (1, 4)), np.clip(full / np.quantile(np.abs(full), 0.95), -1, 1))
    assert (array(screening.stretch_positive(cells(spark, -np.ones((1, 3)))), (1, 3)) == 0).all()
    full = array(screening.zero_filled(cells(spark, a), Meta(1, 4)), (1, 4))
    assert full[0, 1] == 0


def test_text_report(spark):
    classes = spark.createDataFrame([(0, 0.5, 0.25, 0.3, 4)], "class int, precision double, recall double, f1 double, support long")
    text = screening.text_report({"Training AUC": 0.98765}, [("slope", 0.5)], classes)
    assert "Training AUC: 0.9877" in text and "slope: 0.5000" in text and "0.500, 0.250" in text
    assert "exploratory" in screening.text_report({}, [], None, "m.bin")


def test_payload_and_projects(spark):
    a = np.arange(30.0).reshape(5, 6)
    a[0, 0] = np.nan
    rows = {r["id"]: json.loads(r["json"]) for r in viewer.payload({"probability": cells(spark, a), "uncertainty": cells(spark, a)}, Meta(5, 6), 3).collect()}
    assert set(rows) == {"prob", "unc"} and rows["prob"]["rows"] == 3 and rows["prob"]["z"][0] == [None, 2.0, 4.0] and rows["prob"]["high"] == 1.0
    assert rows["unc"]["low"] == pytest.approx(np.nanquantile(a, 0.02))
    with pytest.raises(ValueError):
        viewer.payload({}, META)
    assert viewer.read_project(viewer.project_text("lodestrata", {"a": 1})) == ("lodestrata", {"a": 1})
    r, c = spark.range(1).select(*viewer.at_fraction(F.lit(1.0), F.lit(0.49), Meta(10, 4))).first()
    assert (r, c) == (4, 3)


def test_store_keeps_its_references(spark, tmp_path):
    s, t = (catalog.Store(spark, str(tmp_path / n)) for n in "ab")
    with pytest.raises(ValueError, match="do not exist"):
        s.append("runs", [("r", "none", 1.0, None, "running", "{}", "1")])
    p, q = s.project("Alpha", "copper"), s.project("Beta", "ree")
    assert s.project("Alpha", "copper") == p
    s.append("runs", [("r1", p, 1.0, 2.0, "done", "{}", "1"), ("r2", q, 3.0, 4.0, "done", "{}", "1")])
    s.append("metrics", [("r1", "auc", 0.5, 1.0), ("r2", "auc", 0.75, 1.0)])
    s.append("artifacts", [("r1", "maps", "x", 1.0)])
    with pytest.raises(ValueError, match="do not exist"):
        s.append("metrics", [("r9", "auc", 0.5, 1.0)])
    t.append("runs", [("r3", t.project("Gamma", "ree"), 2.0, 2.0, "done", "{}", "1")])
    assert [(r["id"], r["metric"]) for r in catalog.all_runs([s, t], "auc").collect()] == [("r2", "0.750"), ("r3", ""), ("r1", "0.500")]
    s.delete_project(p)
    assert [r["id"] for r in s.read("runs").collect()] == ["r2"] and s.read("artifacts").count() == 0 and s.read("metrics").count() == 1


def test_least_parabolas_are_exact():
    rng = np.random.default_rng(4)
    for n, p, lines in ((400, 90, 3), (37, 37, 2), (5, 1, 4), (1, 1, 1), (64, 7, 5)):
        at = np.sort(rng.choice(n, p, replace=False))
        high, order = rng.integers(0, 7, (lines, p)).astype(float) ** 2, rng.integers(0, 4, (lines, p))
        d, k = spatial.least_parabolas(at, high, order, n, 1.0)
        every = (np.arange(n)[None, :, None] - at[None, None, :]) ** 2 + high[:, None, :]
        assert np.array_equal(d, every.min(axis=2))
        for i in range(lines):
            assert all(k[i, x] == min((every[i, x, j], order[i, j], j) for j in range(p))[2] for x in range(n))
