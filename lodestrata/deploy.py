"""Gives Python workers this package: they may not share the driver's path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each Spark context, send the package's modules to all present and later executors."""
    sc, top = spark.sparkContext, Path(__file__).resolve().parent
    if sc.applicationId in _shipped:
        return
    handle, path = tempfile.mkstemp(prefix="lodestrata-", suffix=".zip")
    with os.fdopen(handle, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
