"""Stage, task, worker and checkpoint views with their signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabularium.functions import scalars as S
from tabularium.operators.skew import small_table, with_next

KEY = ["stage_no", "model_type"]

# Task states and the counters derived from them.
COUNTERS = {
    "waiting_tasks": "WAITING", "running_tasks": "RUNNING", "done_waiting_tell_tasks": "DONE_WAITING_TELL",
    "told_tasks": "TOLD", "done_tasks": "DONE", "failed_tasks": "FAILED", "stale_tasks": "STALE", "cancelled_tasks": "CANCELLED",
}


def age_seconds(now: Column, then: Column) -> Column:
    return F.timestamp_diff("SECOND", then, now)


def status_counts(tasks: DataFrame) -> DataFrame:
    """Task counts per stage; aggregated before any join, so a stage with most tasks costs nothing extra."""
    return tasks.groupBy(*KEY).agg(
        F.count("task_id").alias("total_tasks"),
        *[F.count_if(F.col("status") == v).alias(k) for k, v in COUNTERS.items()],
        F.count_if(F.col("tell_status") == "PENDING").alias("pending_tell_tasks"),
        F.count_if(F.col("tell_status") == "TOLD").alias("told_tell_tasks"),
        F.max("updated_at").alias("last_task_update"),
    )


def stage_counts(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every stage with its counts; stages without tasks keep zeros."""
    counts = status_counts(tasks)
    joined = stages.join(counts, KEY, "left")
    return joined.withColumns({
        c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counts.columns if c.endswith("_tasks")
    })


def stage_progress(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """Progress view; cancelled tasks count against the remaining trials here."""
    used = sum((F.col(c) for c in ("running_tasks", "done_waiting_tell_tasks", "told_tasks", "failed_tasks", "cancelled_tasks")), F.col("waiting_tasks"))
    return stage_counts(stages, tasks).withColumn("remaining_trials", F.greatest(F.col("trials") - used, F.lit(0)))


def dispatcher_status(stages: DataFrame, tasks: DataFrame, max_parallel: int = 1) -> DataFrame:
    """What a dispatcher should do per stage; cancelled tasks do not count here."""
    c = stage_counts(stages, tasks)
    active = F.col("waiting_tasks") + F.col("running_tasks") + F.col("done_waiting_tell_tasks")
    remaining = F.greatest(F.col("trials") - (F.col("told_tasks") + F.col("failed_tasks") + active), F.lit(0))
    can = F.greatest(F.least(F.lit(max_parallel) - F.col("active_tasks"), F.col("remaining_trials")), F.lit(0))
    signal = (
        F.when(F.col("trials") == 0, "NO_HPO_STAGE")
        .when((F.col("told_tasks") >= F.col("trials")) & (F.col("active_tasks") == 0), "STAGE_COMPLETE")
        .when(F.col("done_waiting_tell_tasks") > 0, "HAS_RESULTS_TO_TELL")
        .when(F.col("can_generate") > 0, "GENERATE_TRIAL")
        .otherwise("WAIT_FOR_WORKERS")
    )
    out = c.withColumn("active_tasks", active).withColumn("remaining_trials", remaining.cast("bigint"))
    return out.withColumn("can_generate", can.cast("bigint")).withColumn("signal", signal)


def worker_signal(stages: DataFrame, tasks: DataFrame) -> DataFrame:
    """First matching signal per stage, with its reason."""
    n = {c: F.col(c) for c in COUNTERS}
    trials, total = F.col("trials"), F.col("total_tasks")
    rules = [
        (n["waiting_tasks"] > 0, "HAS_WAITING_TASK", "a waiting task can be claimed"),
        (n["stale_tasks"] > 0, "HAS_STALE_TASK", "a stale task can be taken over"),
        (n["running_tasks"] > 0, "WAIT_FOR_RUNNING_TASKS", "other tasks are still running"),
        (n["done_waiting_tell_tasks"] > 0, "WAIT_FOR_OPTUNA_TELL", "results wait to be reported"),
        ((trials > 0) & (n["told_tasks"] >= trials), "STAGE_COMPLETE", "every trial is reported"),
        ((trials > 0) & (n["told_tasks"] < trials), "WAIT_FOR_DISPATCHER", "the next trial is not generated yet"),
        ((trials == 0) & (total == 0), "WAIT_FOR_TASK_GENERATION", "the stage has no tasks yet"),
        ((trials == 0) & (n["failed_tasks"] == 0), "STAGE_COMPLETE", "every task is finished"),
        (n["failed_tasks"] > 0, "HAS_FAILED_TASK", "a failed task needs inspection"),
    ]
    signal = reason = None
    for when, name, text in rules:
        signal = F.when(when, name) if signal is None else signal.when(when, name)
        reason = F.when(when, text) if reason is None else reason.when(when, text)
    return stage_counts(stages, tasks).select(
        *KEY, signal.otherwise("IDLE").alias("signal"), reason.otherwise("no action").alias("reason"), "trials", "total_tasks", *COUNTERS
    )


def task_monitor(tasks: DataFrame, stages: DataFrame, workers: DataFrame, slots: DataFrame, now: Column) -> DataFrame:
    """Task with stage, optional worker and optional slot. Dimension sides are broadcast once counted."""
    stages, _ = small_table(stages.select(*KEY, "stage_name"))
    workers, _ = small_table(workers.select("worker_id", "worker_name"))
    joined = tasks.join(stages, KEY).join(workers, "worker_id", "left").join(slots, "slot_id", "left")
    return joined.withColumn("heartbeat_age", age_seconds(now, F.col("last_heartbeat")))


def stale_candidates(tasks: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    return tasks.where(
        (F.col("status") == "RUNNING") & (F.col("last_heartbeat") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    )


def worker_monitor(workers: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    counts = tasks.where("worker_id is not null").groupBy("worker_id").agg(
        F.count_if(F.col("status") == "RUNNING").alias("running_tasks"),
        F.count_if(F.col("status").isin("DONE", "TOLD")).alias("completed_tasks"),
        F.count_if(F.col("status") == "FAILED").alias("failed_tasks"),
        F.max("last_heartbeat").alias("last_seen_at"),
    )
    names = ("running_tasks", "completed_tasks", "failed_tasks")
    return workers.join(counts, "worker_id", "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in names}
    ).withColumn("last_seen_age", age_seconds(now, F.col("last_seen_at")))


def worker_health(latest: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    return latest.join(nodes, "worker_uid", "left").withColumn("last_seen_age", age_seconds(now, F.col("last_seen_at")))


def stale_workers(latest: DataFrame, now: Column) -> DataFrame:
    age = age_seconds(now, F.col("last_seen_at"))
    return latest.withColumn("stale_seconds", age).where("stale_seconds > 120").withColumn(
        "health", S.health(F.col("stale_seconds"))
    )


def silence_events(beats: DataFrame, now: Column, stale: int = 120, offline: int = 300) -> DataFrame:
    """STALE and OFFLINE events for every silent gap of every worker.

    As seen by a monitor that looks all the time: a working status goes STALE after ``stale`` seconds
    and is then off, so OFFLINE is left to idle workers, after ``offline`` seconds. Rows need
    worker_uid, ts, beat_id and status; gaps are found hour by hour, so one worker may hold most rows.
    """
    gaps = with_next(beats, ["worker_uid"], F.date_trunc("HOUR", "ts"), ["ts", "beat_id"], "ts", "_next")
    gaps = gaps.withColumn("silent", F.unix_micros(F.coalesce(F.col("_next"), now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    kind = (
        F.when(~F.col("status").isin("OFFLINE", "IDLE") & (F.col("silent") > stale * 1_000_000), "STALE")
        .when((F.col("status") == "IDLE") & (F.col("silent") > offline * 1_000_000), "OFFLINE")
    )
    detail = F.when(
        F.col("event_type") == "STALE",
        F.format_string("Worker %s was %s, stale for %d seconds", "worker_uid", "status", F.lit(stale)),
    ).otherwise(F.format_string("Worker %s offline since %s", "worker_uid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return gaps.withColumn("event_type", kind).where("event_type is not null").select(
        "worker_uid", "event_type", F.col("ts").alias("last_seen_at"), detail.alias("detail")
    )


def checkpoint_monitor(files: DataFrame) -> DataFrame:
    return files.withColumn("checkpoint_uri", S.remote_uri(F.col("remote"), F.col("relative_path")))


def checkpoint_health(files: DataFrame, workers: DataFrame) -> DataFrame:
    workers, _ = small_table(workers.select("worker_id", "worker_name"))
    return checkpoint_monitor(files).join(workers, "worker_id", "left").orderBy(F.desc("created_at"), F.desc("file_id"))


def ready_for_tell(tasks: DataFrame, limit: int = 50) -> DataFrame:
    return tasks.where(
        (F.col("status") == "DONE_WAITING_TELL") & (F.col("tell_status") == "PENDING") & F.col("objective_value").isNotNull()
    ).orderBy(F.asc_nulls_last("completed_at"), "task_id").limit(limit)


def next_candidates(tasks: DataFrame) -> DataFrame:
    """Per stage the lowest waiting task, or the longest-stale one where nothing waits."""
    waiting = F.min(F.when(F.col("status") == "WAITING", F.col("task_id")))
    stale = F.min(F.when(
        F.col("status") == "STALE",
        F.struct(F.col("stale_marked_at").isNull().alias("late"), F.col("stale_marked_at").alias("at"), F.col("task_id").alias("id")),
    ))
    per = tasks.groupBy(*KEY).agg(waiting.alias("w"), stale.alias("s"))
    return per.select(
        *KEY, F.coalesce("w", "s.id").alias("task_id"), F.when(F.col("w").isNotNull(), "claim").otherwise("take_over").alias("action")
    ).where("task_id is not null")


def enrich_tasks(tasks: DataFrame, stages: DataFrame) -> DataFrame:
    stages, _ = small_table(stages)
    return tasks.join(stages, KEY)


def resume_files(slots: DataFrame, files: DataFrame, prefer: Column) -> DataFrame:
    """File each slot resumes from: best or final if preferred, else latest; no pointer, no row."""
    wanted = F.upper(F.coalesce(prefer, F.lit("latest")))
    pointer = F.when(wanted == "BEST", F.col("best_file_id")).when(wanted == "FINAL", F.col("final_file_id")).otherwise(F.col("latest_file_id"))
    return slots.withColumn("file_id", pointer).where("file_id is not null").join(files, "file_id")


def optional_filter(df: DataFrame, order: list[str], **equals) -> DataFrame:
    for column, value in equals.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df.orderBy(*order)


def register_views(spark: SparkSession, stages: DataFrame, tasks: DataFrame, max_parallel: int = 1) -> None:
    """The stage functions as temporary views for SQL users."""
    stage_progress(stages, tasks).createOrReplaceTempView("stage_progress")
    dispatcher_status(stages, tasks, max_parallel).createOrReplaceTempView("dispatcher_stage_status")
    worker_signal(stages, tasks).createOrReplaceTempView("worker_stage_signal")
