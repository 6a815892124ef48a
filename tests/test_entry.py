"""The entry without the text operators, and deposit tables as csv readers take them."""

import shutil
import subprocess
import sys
from pathlib import Path

from lodestrata.sources import tables

ROOT = Path(__file__).resolve().parents[1]
PROGRAM = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
names = entry.queries()
assert "slope" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names) and set(entry.oracle_sql()) <= set(names)
print("rows", names["slope"](spark, %r).count())
"""


def test_the_rest_stands_without_the_text_operators(tmp_path, sf):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    assert (copy / "corpus_pipeline.py").exists() == (ROOT / "corpus_pipeline.py").exists() and not (copy / "lodestrata" / "llm").exists()
    done = subprocess.run([sys.executable, "-c", PROGRAM % sf], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "rows 2304" in done.stdout


def test_quoted_fields(spark, tmp_path):
    text = '\ufeffSite_Name,longitude,latitude,dev_status,commod1,commodity_note\n"The ""Big"" one, north",10,20,Producer,copper,x\n"two\nlines",11,21,"Past Producer",gold,cu\nplain,12,22,,Cu,\nbad,x,1,,,\n'
    (tmp_path / "d.csv").write_text(text)
    got = {r["name"]: r for r in tables.csv_deposits(spark, str(tmp_path / "d.csv")).collect()}
    assert set(got) == {'The "Big" one, north', "two\nlines", "plain"}
    assert got["two\nlines"]["status"] == "Past Producer" and got["two\nlines"]["commodity"] == "gold" and got["plain"]["x"] == 12.0


def test_names_of_columns(spark, tmp_path):
    for status in ("dev_stat", "dev_status", "status"):
        (tmp_path / f"{status}.csv").write_text(f"name,lon,lat,{status},code_list,commod2\na,1,2,plant,CU,x\n")
        r = tables.csv_deposits(spark, str(tmp_path / f"{status}.csv")).first()
        assert (r["name"], r["status"], r["commodity"]) == ("a", "plant", "x CU")
