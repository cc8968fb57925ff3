"""Several tables that change together: versioned folders and a pointer that is written last.

A version is a pointer folder that names the folder of every table. ``replace`` writes new folders for the tables that change and then
the pointer; tables that stay are pointed at where they are. A driver lost before the pointer's commit leaves the old version, after it
the new one; Spark's reader sees no uncommitted pointer. One writer at a time is assumed, as for any overwrite.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabularium.operators.skew import small_table
from tabularium.sources.files import stored

POINTER = "version long, name string, place string"
# The tables that hold rows of a task, and those of slots and stages.
TASK_TABLES = ("epoch_metric_log", "fold_run_result", "convergence_diagnostic_summary", "checkpoint_file", "task")


def current(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """Latest committed version, -1 if there is none, and the tables' folders."""
    pointers = stored(spark, f"{root}/pointer/*", POINTER)
    if pointers is None:
        return -1, {}
    last = pointers.agg(F.max("version").alias("version"))
    rows = pointers.join(F.broadcast(last), "version").collect()  # one row per table
    return (rows[0]["version"], {r["name"]: r["place"] for r in rows}) if rows else (-1, {})


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(current(spark, root)[1][name])


def replace(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> int:
    """Commit new contents of some tables as the next version."""
    version, places = current(spark, root)
    version += 1
    for name, df in tables.items():
        places[name] = f"{root}/tables/{name}-{version:06d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(places[name])
    pointer = spark.createDataFrame([(version, n, p) for n, p in sorted(places.items())], POINTER)
    pointer.coalesce(1).write.mode("errorifexists").parquet(f"{root}/pointer/{version:06d}")
    return version


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(small_table(keys.select(key).distinct())[0], key, "left_anti")


def purge_tasks(spark: SparkSession, root: str, tasks: DataFrame, also: Mapping[str, DataFrame] | None = None) -> int:
    """Remove the tasks' rows from their five tables, and the checkpoint slots they point at, as one version; unknown tasks remove nothing."""
    gone = open_table(spark, root, "task").join(small_table(tasks.select("task_id").distinct())[0], "task_id", "left_semi")
    keys, slots = gone.select("task_id"), gone.where("checkpoint_slot_id IS NOT NULL").select("checkpoint_slot_id")
    changed = {name: without(open_table(spark, root, name), keys, "task_id") for name in TASK_TABLES}
    changed["checkpoint_slot"] = without(open_table(spark, root, "checkpoint_slot"), slots, "checkpoint_slot_id")
    return replace(spark, root, {**changed, **(also or {})})


def reset_stage(spark: SparkSession, root: str, stage_no: int, model_type: str) -> int:
    """Purge all tasks of a stage and make the stage active, in one version."""
    mine = (F.col("stage_no") == stage_no) & (F.col("model_type") == model_type)
    stages = open_table(spark, root, "stage_information").withColumn("is_active", F.when(mine, True).otherwise(F.col("is_active")))
    return purge_tasks(spark, root, open_table(spark, root, "task").where(mine), {"stage_information": stages})
