"""Streams over the events, replayed in time order; each ends where its batch twin does."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.catalog.monitoring import END, SILENCE_SQL
from tabularium.catalog.runs import EPOCH_SQL, STOP_SQL, epochs
from tabularium.catalog.scans import scratch
from tabularium.catalog.tables import STATE_SQL, action_log
from tabularium.fixtures import cte, view
from tabularium.sources import logs
from tabularium.streaming import heartbeats, once, replay, stateful


def beats(t, closing: bool = False):
    """Heartbeats as a stream.

    ``closing`` adds two triggers of beats of nobody at the end of time: the first moves the watermark
    past every session, the second runs under it.
    """
    rows = view(t, "beat").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = scratch(t.spark, "beats")
    replay.write_slices(rows, folder, "ts")
    for _ in range(2 if closing else 0):
        fixed = {"ts": F.lit(END).cast("timestamp"), "worker_uid": F.lit("")}
        rows.limit(4).withColumns(fixed).repartition(4).write.mode("append").parquet(folder)
    return replay.open_stream(t.spark, folder, rows.schema)


@query("streamed_heartbeats", "ST1 K2", cte("beat") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY worker_uid ORDER BY ts DESC, beat_id DESC) AS rn FROM beat),
f AS (SELECT worker_uid, arg_max(worker_name, beat_id) FILTER (WHERE worker_name IS NOT NULL) AS worker_name, arg_max(checkpoint_epoch, beat_id) FILTER (WHERE checkpoint_epoch IS NOT NULL) AS checkpoint_epoch,
  count(*) AS n_beats FROM beat GROUP BY 1)
SELECT r.worker_uid, r.status, r.task_id, f.worker_name, f.checkpoint_epoch, f.n_beats FROM r JOIN f USING (worker_uid) WHERE rn = 1
""")
def streamed_heartbeats(t):
    state = heartbeats.current_state(beats(t), ["status", "task_id"], ["worker_name", "checkpoint_epoch"])
    out = scratch(t.spark, "state")
    replay.drain_batches(state, heartbeats.save_state(out), scratch(t.spark, "ck"))
    return heartbeats.read_state(t.spark, out).drop("last_seen_at")


@query("streamed_silence_events", "ST3", SILENCE_SQL)
def streamed_silence_events(t):
    # the closing beats are filtered from the result: a filter in the stream would be pushed below the watermark
    events = heartbeats.silence_events(beats(t, closing=True))
    found = replay.drain(events, scratch(t.spark, "events"), scratch(t.spark, "ck")).where("worker_uid <> ''")
    return found.select("worker_uid", "event_type", F.unix_micros("last_seen_at").alias("last_seen_us"), "detail")


@query("streamed_stale_tasks", "ST2", cte("beat") + f"""
, g AS (SELECT *, date_diff('microsecond', ts, coalesce(lead(ts) OVER (PARTITION BY worker_uid ORDER BY ts, beat_id), TIMESTAMP '{END}')) AS silent FROM beat)
SELECT worker_uid AS task_id, epoch_us(min(ts)) + 900000000 AS stale_us FROM g WHERE silent > 900000000 AND status = 'RUNNING' GROUP BY 1
""")
def streamed_stale_tasks(t):
    """First time each task fell silent for more than 15 minutes while running; here a worker is a task."""
    rows = heartbeats.stale_tasks(beats(t, closing=True).withColumnRenamed("task_id", "unused").withColumnRenamed("worker_uid", "task_id"))
    silent = scratch(t.spark, "silent")
    replay.drain(rows, silent, scratch(t.spark, "ck"))
    with once.state_on_disk(t.spark):
        found = replay.drain(once.mark_once(replay.open_written(t.spark, silent, rows.schema)), scratch(t.spark, "stale"), scratch(t.spark, "ck"))
    return found.where("task_id <> ''").select("task_id", F.unix_micros("stale_marked_at").alias("stale_us"))


@query("streamed_task_states", "ST4 K4", STATE_SQL)
def streamed_task_states(t):
    rows = action_log(t).withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out = scratch(t.spark, "actions"), scratch(t.spark, "state")
    replay.write_slices(rows, folder, "ts")
    tables = scratch(t.spark, "tables")
    stateful.fold_triggers(replay.open_stream(t.spark, folder, rows.schema), stateful.task_tables, "task_id", tables, scratch(t.spark, "ck"))
    states = stateful.task_states(stateful.folded_stream(t.spark, tables, stateful.TABLES))

    def save(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    replay.drain_batches(states, save, scratch(t.spark, "ck"))
    saved = t.spark.read.parquet(out)
    columns = [c for c in saved.columns if c not in ("task_id", "batch_id")]
    return saved.groupBy("task_id").agg(F.max(F.struct("batch_id", *columns)).alias("r")).select("task_id", *[F.col("r")[c].alias(c) for c in columns])


@query("streamed_once_per_trial", "ST5", "SELECT DISTINCT user_id * 100 + CAST(date_part('day', ts) AS BIGINT) AS trial FROM events")
def streamed_once_per_trial(t):
    """Several reports of a trial (a user's day) reach the sink as one."""
    rows = t.events.selectExpr("user_id * 100 + CAST(date_part('day', ts) AS BIGINT) AS trial", "CAST(ts AS TIMESTAMP) AS ts")
    folder = scratch(t.spark, "reports")
    replay.write_slices(rows, folder, "ts")
    with once.state_on_disk(t.spark):
        first = once.once_per_trial(replay.open_stream(t.spark, folder, rows.schema))
        return replay.drain(first, scratch(t.spark, "once"), scratch(t.spark, "ck")).select("trial")


@query("streamed_epoch_log", "ST6 S14", "SELECT user_id AS task_id, count(*) AS n_rows, round(sum(value), 4) AS total_loss FROM events GROUP BY 1")
def streamed_epoch_log(t):
    rows = t.events.select(F.col("user_id").alias("task_id"), F.col("value").alias("val_loss"), F.col("event_id").cast("int").alias("epoch"), F.col("ts").cast("timestamp").alias("ts"))
    folder, out = scratch(t.spark, "feed"), scratch(t.spark, "log")
    replay.write_slices(rows, folder, "ts")
    stream = replay.open_stream(t.spark, folder, rows.schema).drop("ts")
    logs.append_stream(stream, "epoch_metric", out, scratch(t.spark, "ck")).awaitTermination()
    log = t.spark.read.parquet(f"{out}/epoch_metric")
    return log.groupBy("task_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("val_loss"), 4).alias("total_loss"))


@query("streamed_early_stops", "ST7 W11 W12", STOP_SQL.format(v="value", p=10) + """
, e AS (SELECT run, min(epoch) FILTER (WHERE stops) AS e FROM s GROUP BY run)
SELECT run, e + 10 AS stop_epoch, e AS best_epoch, value AS best_value FROM e JOIN log USING (run) WHERE log.epoch = e.e
""")
def streamed_early_stops(t):
    rows = epochs(t).select("run", "epoch", "value", F.timestamp_seconds(F.col("epoch")).alias("ts"))
    folder = scratch(t.spark, "epochs")
    replay.write_slices(rows, folder, "ts")
    records = scratch(t.spark, "records")
    stateful.fold_triggers(replay.open_stream(t.spark, folder, rows.schema), stateful.run_records(), "run", records, scratch(t.spark, "ck"))
    events = stateful.early_stop_events(stateful.folded_stream(t.spark, records, stateful.RECORDS), 10)
    found = replay.drain(events, scratch(t.spark, "stops"), scratch(t.spark, "ck"))
    return found.where("kind = 'stopped'").select("run", F.col("epoch").alias("stop_epoch"), "best_epoch", "best_value")
