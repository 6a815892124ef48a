"""A run's tables for a viewer, and the scene around them."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import crs
from lodestrata.operators import grid
from lodestrata.operators.grid import Meta
from lodestrata.plans import viewer

META = Meta(40, 50, 500_000.0, 4_000_000.0, 100.0, -100.0, "EPSG:32612")


def test_targets_of_a_run(spark, tmp_path):
    lon, lat = spark.range(1).select(*crs.to_wgs84(F.lit(501_250.0), F.lit(3_999_000.0), 32612)).first()
    lines = ["rank,latitude,longitude,probability,uncertainty,depth_status,nearest_deposit_name,driver_1,driver_1_percentile", f"1,{lat},{lon},0.81264,0.1,, Old mine ,slope,93", "2,3999000,501250,0.5,,single-method,,,", "3,3990000,501250,0.5,,,,,", "4,x,1,0.5,,,,,", "NOTE,text,,,,,,,"]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    got = {r["rank"]: r for r in viewer.run_targets(spark, str(tmp_path / "t.csv"), META).collect()}
    assert set(got) == {1, 2} and got[1]["probability"] == 0.813 and got[1]["nearest_deposit_name"] == "Old mine" and got[1]["driver_1_percentile"] == 93
    assert all(abs(got[k]["u"] - 0.25) < 1e-5 and abs(got[k]["v"] - 0.25) < 1e-5 for k in got) and got[1]["depth_status"] is None and got[2]["uncertainty"] is None


def test_deposits_are_shown_to_a_limit(spark, tmp_path):
    rows = [f"site {i},{500_000 + i * 0.1},{4_000_000 - i * 0.1}" for i in range(5_000)]
    (tmp_path / "d.csv").write_text("\n".join(["name,x,y", *rows]))
    got = viewer.run_deposits(spark, str(tmp_path / "d.csv"), META)
    assert got.count() == 4_000 and got.filter("name = 'site 3999'").count() == 1 and got.filter("name = 'site 4000'").count() == 0
    assert viewer.run_deposits(spark, str(tmp_path / "d.csv"), META, None).count() == 5_000
    (tmp_path / "n.csv").write_text("a,b\n1,2\n")
    assert viewer.run_deposits(spark, str(tmp_path / "n.csv"), META).count() == 0


def test_margins(spark):
    at = spark.createDataFrame([(0.0,), (-0.02,), (-0.021,), (1.02,), (1.03,), (0.5,)], "f double")
    u, v = viewer.fractional(META, 500_000 + F.col("f") * 5_000, 4_000_000 - F.col("f") * 4_000)
    assert [tuple(r) for r in at.select(F.round(u, 9), F.round(v, 9)).collect()] == [(0, 0), (0, 0), (None, None), (1, 1), (None, None), (0.5, 0.5)]


def test_scene(spark):
    dem = grid.cells(spark, META).withColumn("v", F.col("r") + F.col("c") * 2.0)
    targets = spark.createDataFrame([(2, 0.5, 0.1, 0.2), (1, 0.9, 0.3, 0.4)], "rank int, probability double, u double, v double")
    deposits = spark.createDataFrame([("b", 0.1, 0.1), ("a", 0.2, 0.2)], "name string, u double, v double")
    got = json.loads(viewer.scene(dem, {"probability": dem.withColumn("v", F.col("v") / 200)}, META, targets, deposits).first()["json"])
    assert (got["width_m"], got["height_m"], got["low"], got["high"]) == (5_000, 4_000, 0, 137) and [t["rank"] for t in got["targets"]] == [1, 2] and [d["name"] for d in got["deposits"]] == ["a", "b"]
    assert got["relief"]["rows"] * got["relief"]["cols"] == sum(len(x) if isinstance(x, list) else 1 for x in got["relief"]["z"]) and -112 < got["bounds"][0] < got["bounds"][2] < -110 and got["layers"][0]["id"] == "prob"
    bare = json.loads(viewer.scene(dem.filter("r < 0"), {}, META, targets.limit(0), deposits.limit(0)).first()["json"])
    assert (bare["low"], bare["high"], bare["layers"], bare["targets"]) == (0, 1, [], [])


def test_layers_of_another_shape(spark):
    dem = grid.cells(spark, META).withColumn("v", F.lit(1.0))
    with pytest.raises(ValueError, match="another shape"):
        grid.stack(dem, {"a": dem, "wide": dem.withColumn("c", F.col("c") + 1)}, META)
    assert grid.stack(dem, {"a": dem}, META).count() == 2_000
