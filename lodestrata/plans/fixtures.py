"""The engine's inputs as views over the driver's tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.grid import Meta

N = 48
#: Keeps averages of prices off the halves at which two engines may round apart.
UNEVEN = 0.9876543210123457
#: A value's mask, in Spark's and DuckDB's SQL.
MASKED = "CASE WHEN v NOT BETWEEN 37.0 AND 37.3 THEN v END"
META = Meta(N, N, 500_000.0, 4_000_000.0, 100.0, -100.0, "EPSG:32612")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid(spark: SparkSession, sf: str, n: int = N, flag: str | None = None) -> DataFrame:
    """(r, c, v): average prices of lineitems by order and part, in hundred thousandths of cents so that sums are exact."""
    rows = table(spark, sf, "lineitem")
    if flag:
        rows = rows.filter(F.col("l_returnflag") == flag)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return rows.groupBy((F.col("l_orderkey") % n).cast("int").alias("r"), (F.col("l_partkey") % n).cast("int").alias("c")).agg((F.sum(cents).cast("double") / F.count("*") / 100_000 * UNEVEN).alias("v"))


def dem(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with the values from 37 to 37.3 masked, as if they were its nodata range: every cell has its row."""
    return grid(spark, sf).withColumn("v", F.expr(MASKED))


def deposits(spark: SparkSession, sf: str) -> DataFrame:
    """(r, c, ord, name, status, commodity, v) of every order. Powers of the key modulo 47 put them on some 140 scattered cells,
    many on each."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 47)
    return o.select(F.expr("CAST(k * k % 47 AS INT)").alias("r"), F.expr("CAST((k * k * k + o_custkey % 3) % 47 AS INT)").alias("c"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("status"), F.col("o_orderstatus").alias("commodity"), F.col("o_totalprice").alias("v"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """(label, score) of labelled documents: quality against length."""
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").cast("int").alias("label"), (F.col("n_chars") / 40_000.0).alias("score"))


def grid_sql(name: str = "g", n: int = N, flag: str | None = None) -> str:
    where = f" WHERE l_returnflag = '{flag}'" if flag else ""
    return f"{name} AS (SELECT CAST(l_orderkey % {n} AS INTEGER) AS r, CAST(l_partkey % {n} AS INTEGER) AS c, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) / 100000 * {UNEVEN}::DOUBLE AS v FROM lineitem{where} GROUP BY 1, 2)"


DEM_SQL = grid_sql() + f", dem AS (SELECT r, c, {MASKED} AS v FROM g)"
CELLS_SQL = f"cells AS (SELECT CAST(a.i AS INTEGER) AS r, CAST(b.i AS INTEGER) AS c FROM range({N}) a(i), range({N}) b(i))"
FULL_SQL = f"{DEM_SQL}, {CELLS_SQL}, f AS (SELECT r, c, v FROM cells LEFT JOIN dem USING (r, c))"
DEPOSITS_SQL = f"dep AS (SELECT CAST(k * k % 47 AS INTEGER) AS r, CAST((k * k * k + o_custkey % 3) % 47 AS INTEGER) AS c, o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS status, o_orderstatus AS commodity, o_totalprice AS v FROM (SELECT *, o_orderkey % 47 AS k FROM orders))"
# Orders of one cell are as near to any other: one row for each cell that has some.
DEPOSIT_CELLS_SQL = f"{DEPOSITS_SQL}, dc AS (SELECT r, c, min(ord) AS ord, sum(CAST(round(v * 100) AS BIGINT)) AS cents, count(*) AS n FROM dep GROUP BY 1, 2)"
SCORES_SQL = "sc AS (SELECT doc_id, CAST(quality AS INTEGER) AS label, n_chars / 40000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
