"""Snapshots on disk: each run's rows in a folder of their own, then one row a project that points at it.

A folder is never written twice, and a reader follows the newest pointer only. A run that
breaks before its pointers are there has changed nothing for readers; all projects of a
run change over in one commit, as their pointers are one file.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTERS = "project_id string, run string, run_id string, rows long, place long"


def pointers(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The newest pointer of each project: project_id, run (its folder), run_id, rows; empty where nothing was published."""
    try:
        found = spark.read.schema(POINTERS).parquet(f"{path}/{table}/pointers")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTERS)
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("place"), F.desc("run")))).where("nth = 1").drop("nth", "place")


def current(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """The rows of the runs that the projects' pointers name, with ``run_id``; None where nothing was published.

    Rows are partitioned by run, and the join on the pointers prunes the runs that none names.
    """
    try:
        rows = spark.read.parquet(f"{path}/{table}/rows")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return rows.join(pointers(spark, path, table).select("project_id", "run", "run_id"), ["project_id", "run"]).drop("run")


def write_run(new: DataFrame, table: str, keys: list[str], run_id: str, path: str) -> str:
    """Writes a run's rows to a folder of their own, with the ids of the current rows of the same keys, and returns its name. Readers see nothing of it yet."""
    spark, run = new.sparkSession, f"{run_id}-{uuid.uuid4().hex}"
    own = F.sha2(F.concat_ws("\0", F.lit(table), *keys), 256)
    old = current(spark, path, table)
    rows = new.drop("id").withColumn("id", own)
    if old is not None:
        rows = new.drop("id").join(old.select(*keys, "id"), keys, "left").withColumn("id", F.coalesce("id", own))
    rows.write.parquet(f"{path}/{table}/rows/run={run}")
    return run


def point(spark: SparkSession, projects: DataFrame, table: str, run: str, run_id: str, path: str) -> None:
    """One commit that turns all ``projects`` over to a run; one without rows in it becomes empty. Counts are those of the rows as written."""
    counts = spark.read.parquet(f"{path}/{table}/rows/run={run}").groupBy("project_id").agg(F.count("*").alias("rows"))
    rows = projects.select("project_id").distinct().join(counts, "project_id", "left")
    rows = rows.select(F.col("project_id").cast("string").alias("project_id"), F.lit(run).alias("run"), F.lit(run_id).alias("run_id"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.lit(time.time_ns()).cast("long").alias("place"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/{table}/pointers")


def publish(new: DataFrame, projects: DataFrame, table: str, keys: list[str], run_id: str, path: str) -> DataFrame:
    """Replaces all rows of ``projects`` by ``new(project_id, *keys, ...)`` and returns the current rows.

    ``keys`` start with project_id. Rows keep the id of the current row with their keys;
    other projects keep their rows; a project without rows in ``new`` ends empty. The
    same run id may be published again: it gets another folder.
    """
    run = write_run(new, table, keys, run_id, path)
    point(new.sparkSession, projects, table, run, run_id, path)
    return current(new.sparkSession, path, table)


def replace_inventory(files: DataFrame, projects: DataFrame, run_id: str, path: str) -> DataFrame:
    """Replaces the listings of ``projects`` and no others; an empty listing leaves none."""
    return publish(files, projects, "inventory", ["project_id", "path"], run_id, path)


def record_run(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)
