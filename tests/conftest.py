import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(x):
    if x is None or str(x) in ("<NA>", "nan", "NaT"):
        return "~"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(x)
    return str(x)


@pytest.fixture(scope="session")
def same():
    """Rows of a Spark result and of a DuckDB query, in any order."""

    def check(df, con, sql):
        a, b = df.toPandas(), con.execute(sql).df()
        names = sorted(a.columns)
        assert names == sorted(b.columns)
        rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[names].itertuples(index=False))
        assert rows(a) == rows(b)

    return check
