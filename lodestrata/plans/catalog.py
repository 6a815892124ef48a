"""The project store: append-only Parquet tables in which the latest row of a key counts."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata import store

SCHEMAS = {
    "projects": "id string, name string, commodity string, created_at double, notes string",
    "runs": "id string, project_id string, started_at double, finished_at double, status string, config_json string, engine_version string",
    "metrics": "run_id string, key string, value double, at double",
    "artifacts": "run_id string, kind string, path string, at double",
}


# The table that each table's rows belong to.
PARENTS = {"runs": "projects", "metrics": "runs", "artifacts": "runs"}


def all_runs(stores: list[Store], key: str) -> DataFrame:
    """The runs of several stores, each with its store's path, the newest first."""
    parts = [list_runs(s.read("runs"), s.read("projects"), s.read("metrics"), key).withColumn("store", F.lit(s.path)) for s in stores]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("started_at"), "store", "id")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def list_runs(runs: DataFrame, projects: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Runs with their project's name and one metric, three decimals or empty, the newest first."""
    m = metrics.filter(F.col("key") == key).select(F.col("run_id").alias("id"), "value")
    shown = F.when(F.col("value").isNotNull(), F.format_string("%.3f", "value")).otherwise("")
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    return runs.join(p, "project_id").join(m, "id", "left").select("id", "project", "status", "started_at", shown.alias("metric")).orderBy(F.desc("started_at"), "id")


def summary(runs: DataFrame, metrics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each run with the maps of its metrics and artifacts."""
    as_map = lambda d, k, v: d.groupBy(F.col("run_id").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias(v))
    return runs.join(as_map(metrics, "key", "value"), "id", "left").join(as_map(artifacts, "kind", "path"), "id", "left")


def started(at: str):
    """Seconds since the epoch as minutes of the session's time zone."""
    return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd HH:mm")


@dataclass
class Store:
    """The four tables under a folder."""

    spark: SparkSession
    path: str

    def append(self, table: str, rows: list[tuple]) -> None:
        """Append rows. A project's name may occur once; runs need their project, metrics and artifacts their run."""
        if table == "projects":
            taken = {r["name"] for r in self.read("projects").select("name").collect()}
            if again := [r[1] for r in rows if r[1] in taken]:
                raise ValueError(f"projects exist already: {again}")
        if parent := PARENTS.get(table):
            wanted = {r[1] if table == "runs" else r[0] for r in rows}
            there = {r["id"] for r in self.read(parent).filter(F.col("id").isin(list(wanted))).select("id").collect()}
            if missing := sorted(wanted - there):
                raise ValueError(f"{table} name {parent} that do not exist: {missing}")
        self.spark.createDataFrame(rows, SCHEMAS[table]).write.mode("append").parquet(f"{self.path}/{table}")

    def project(self, name: str, commodity: str) -> str:
        """The id of the project of a name, which is made if there is none."""
        found = self.read("projects").filter(F.col("name") == name).select("id").first()
        if found:
            return found[0]
        self.append("projects", [(uuid.uuid4().hex[:12], name, commodity, time.time(), "")])
        return self.project(name, commodity)

    def delete_project(self, project_id: str) -> None:
        """Remove a project with its runs, their metrics and their artifacts: each table is written anew without them."""
        runs = self.read("runs").filter(F.col("project_id") == project_id).select(F.col("id").alias("run_id"))
        gone = [r["run_id"] for r in runs.collect()]
        tests = {"projects": F.col("id") == project_id, "runs": F.col("project_id") == project_id, "metrics": F.col("run_id").isin(gone), "artifacts": F.col("run_id").isin(gone)}
        for table in ("artifacts", "metrics", "runs", "projects"):
            left = self.read(table).filter(~F.coalesce(tests[table], F.lit(False)))
            kept = store.stored(left, f"catalog-{table}")
            kept.write.mode("overwrite").parquet(f"{self.path}/{table}")
            store.release(kept)

    def read(self, table: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}")
            rows.isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], SCHEMAS[table])
        keys = {"projects": (["id"], ["created_at"]), "runs": (["id"], ["finished_at"]), "metrics": (["run_id", "key"], ["at"]), "artifacts": (["run_id", "kind"], ["at"])}[table]
        return latest(rows, *keys)
