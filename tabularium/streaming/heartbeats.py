"""Heartbeat streams: current state, silence events, stale tasks.

Silence is a closed session: ``session_window`` merges partial sessions before and after the
shuffle, so a worker that sends a third of all beats still is a handful of rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tabularium.functions import scalars as S
from tabularium.operators.tables import fold_heartbeats


def current_state(beats: DataFrame, overwrite: Sequence[str], sticky: Sequence[str]) -> DataFrame:
    """The batch fold as a streaming aggregation: run it in update mode."""
    return fold_heartbeats(beats, overwrite, sticky)


def save_state(out: str):
    """Sink for ``current_state``: each batch writes the workers it touched under its own batch id.

    The batch's folder is replaced as a whole, so a batch that is run again leaves one copy.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


def read_state(spark, out: str) -> DataFrame:
    """Newest saved row per worker."""
    rows = spark.read.parquet(out)
    columns = [c for c in rows.columns if c not in ("batch_id", "worker_uid")]
    newest = F.max(F.struct("batch_id", *columns))
    return rows.groupBy("worker_uid").agg(newest.alias("_r")).select("worker_uid", *[F.col("_r")[c].alias(c) for c in columns])


def _closed_sessions(beats: DataFrame, key: str, seconds: int, delay: str) -> DataFrame:
    """Last beat of every run of beats followed by more than ``seconds`` of silence."""
    gap = f"{seconds} seconds 1 microsecond"
    last = F.max(F.struct("ts", "beat_id", "status"))
    return (
        beats.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap)).agg(last.alias("_last"))
        .select(key, F.col("_last.ts").alias("last_seen_at"), F.col("_last.status").alias("status"))
    )


def silence_events(beats: DataFrame, stale: int = 120, offline: int = 300, delay: str = "0 seconds") -> DataFrame:
    """STALE for working and OFFLINE for idle workers; the batch twin is ``monitor.silence_events``.

    ``beats`` needs worker_uid, ts (TIMESTAMP), beat_id and status; ``delay`` is how late a beat may be.
    """
    quiet = _closed_sessions(beats, "worker_uid", stale, delay).where("status not in ('OFFLINE', 'IDLE')")
    gone = _closed_sessions(beats, "worker_uid", offline, delay).where("status = 'IDLE'")
    stale_text = F.format_string("Worker %s was %s, stale for %d seconds", "worker_uid", "status", F.lit(stale))
    gone_text = F.format_string("Worker %s offline since %s", "worker_uid", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss"))
    return quiet.select("worker_uid", F.lit("STALE").alias("event_type"), "last_seen_at", stale_text.alias("detail")).unionByName(
        gone.select("worker_uid", F.lit("OFFLINE").alias("event_type"), "last_seen_at", gone_text.alias("detail"))
    )


def stale_tasks(beats: DataFrame, minutes: int = 15, delay: str = "0 seconds") -> DataFrame:
    """Every silence of a running task longer than ``minutes``; ``once.mark_once`` keeps a task's first."""
    quiet = _closed_sessions(beats, "task_id", minutes * 60, delay).where("status = 'RUNNING'")
    return quiet.select("task_id", "last_seen_at", (F.col("last_seen_at") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("stale_marked_at"))


def health_now(state: DataFrame, now) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("last_seen_at"), now)
    return state.withColumn("health", S.health(age))
