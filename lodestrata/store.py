"""Tables written to the folder that all executors share, and read from there: lineage is cut, and a lost executor costs no
recomputation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a task gathers in memory before it writes.
ROW_GROUP = 32 << 20

_own: dict[str, str] = {}
#: Folders of stored tables, with their sessions.
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark is local, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lodestrata-")
    return f"file://{_own['dir']}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nobody else has."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df, written once and read again. The table stays until it is released, at the latest until the driver ends."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[path] = spark
    out.__dict__["_stored_at"] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables whose last reader has run."""
    for t in tables:
        path = t.__dict__.get("_stored_at")
        if path in _tables:
            _delete(_tables.pop(path), path)


@contextmanager
def scratch(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes the tables that are stored within, but for those in the list that it gives and for kept."""
    before, keep = set(_tables), list(kept)
    yield keep
    stay = {t.__dict__.get("_stored_at") for t in keep}
    for path in [p for p in _tables if p not in before and p not in stay]:
        _delete(_tables.pop(path), path)


class Left:
    """Tables that a step stored and that its lazy result still reads; `go` deletes them once that result has been written."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextmanager
    def over(self) -> Iterator[None]:
        before = set(_tables)
        yield
        self.paths += [p for p in _tables if p not in before]

    def go(self) -> None:
        for path in self.paths:
            if path in _tables:
                _delete(_tables.pop(path), path)
        self.paths = []


@atexit.register
def _clear() -> None:
    for path, spark in _tables.items():
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        return
