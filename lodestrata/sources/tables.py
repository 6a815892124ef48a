"""Point tables with lenient headers, discovered files and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names in order of preference.
X_NAMES = ("longitude", "lon", "long", "x", "east", "easting", "dec_long")
Y_NAMES = ("latitude", "lat", "y", "north", "northing", "dec_lat")
DEPOSIT_X, DEPOSIT_Y = ("longitude", "lon", "dec_long", "x"), ("latitude", "lat", "dec_lat", "y")
COMMODITY_NAMES, SITE_NAMES = ("commod1", "commodity", "commod", "commodities"), ("site_name", "name", "dep_name", "site")
TABLE_SITE_NAMES, STATUS_NAMES = ("site_name", "name", "dep_name"), ("dev_stat", "dev_status", "status")
TABLE_COMMODITIES = ("commod1", "commod2", "commod3", "commodity", "commodities", "code_list")


def lenient_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, headers in lower case without blanks or byte order marks; of clashing headers the first stays.

    Quotes are doubled within quoted fields, which may hold commas and line breaks. A file splits at its lines, unless some
    line has an odd number of quotes: then a field may run on, and each file is read by one task."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    runs_on = not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()
    raw = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", runs_on).csv(path)
    seen: dict[str, str] = {}
    for c in raw.columns:
        seen.setdefault(c.replace("﻿", "").strip().lower(), c)
    return raw.select(*[F.col(f"`{c}`").alias(n) for n, c in seen.items() if n])


def first_of(columns: list[str], names: tuple[str, ...]) -> str | None:
    return next((n for n in names if n in columns), None)


def csv_points(spark: SparkSession, path: str, value_field: str | None = None) -> DataFrame:
    """(x, y, v): rows whose numbers can't be read go; v is 1 without a value field."""
    rows = lenient_csv(spark, path)
    x, y = first_of(rows.columns, X_NAMES), first_of(rows.columns, Y_NAMES)
    if x is None or y is None:
        raise ValueError(f"no coordinate columns among {rows.columns}")
    v = F.expr(f"try_cast(`{value_field.lower()}` AS DOUBLE)") if value_field else F.lit(1.0)
    out = rows.select(F.expr(f"try_cast(`{x}` AS DOUBLE)").alias("x"), F.expr(f"try_cast(`{y}` AS DOUBLE)").alias("y"), v.alias("v"))
    return out.filter("x IS NOT NULL AND y IS NOT NULL AND v IS NOT NULL")


def csv_deposits(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, name, commodity, status) of a deposit table."""
    rows = lenient_csv(spark, path)
    x, y = first_of(rows.columns, DEPOSIT_X), first_of(rows.columns, DEPOSIT_Y)
    if x is None or y is None:
        raise ValueError(f"no coordinate columns among {rows.columns}")
    commods = [c for c in TABLE_COMMODITIES if c in rows.columns]
    pick = lambda n: F.col(f"`{n}`") if n else F.lit("")
    out = rows.select(
        F.expr(f"try_cast(`{x}` AS DOUBLE)").alias("x"),
        F.expr(f"try_cast(`{y}` AS DOUBLE)").alias("y"),
        F.coalesce(pick(first_of(rows.columns, TABLE_SITE_NAMES)), F.lit("")).alias("name"),
        F.concat_ws(" ", *[F.col(f"`{c}`") for c in commods]).alias("commodity") if commods else F.lit(None).cast("string").alias("commodity"),
        F.coalesce(pick(first_of(rows.columns, STATUS_NAMES)), F.lit("")).alias("status"),
    )
    return out.filter("x IS NOT NULL AND y IS NOT NULL")


def targets_csv(spark: SparkSession, path: str) -> DataFrame:
    """A written targets table: rows whose first field isn't a number are notes and go."""
    rows = spark.read.option("header", True).csv(path)
    return rows.filter(F.col(rows.columns[0]).rlike("^[0-9]+$"))


def report_metric(text, name: str):
    """The number after `name:` in a text report, or NULL."""
    return F.nullif(F.regexp_extract(text, rf"{name}\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
