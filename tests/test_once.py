"""Once-only marks: late repeats, restarts, earlier marks, and how much state they take."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tabularium.streaming import heartbeats, once, replay

START = datetime(2024, 1, 1)


def reports(spark, folder, rows):
    df = spark.createDataFrame([(t, START + timedelta(hours=h), text) for t, h, text in rows], "trial BIGINT, ts TIMESTAMP, extra STRING")
    df.coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def report_once(spark, tmp, schema, known=None):
    with once.state_on_disk(spark):
        first = once.once_per_trial(replay.open_stream(spark, f"{tmp}/in", schema, files=1), known)
        return replay.drain(first, f"{tmp}/out", f"{tmp}/ck")


def test_reports_reach_the_sink_once(spark, tmp_path):
    rows = [(1, 0, "a"), (1, 1, "b"), (5_000, 2, "c"), (-3, 2, "d"), (None, 2, "e")]
    schema = reports(spark, f"{tmp_path}/in", rows)
    reports(spark, f"{tmp_path}/in", [(1, 3, "f"), (2, 3, "g")])
    known = spark.createDataFrame([(9,), (None,)], "trial BIGINT")
    got = report_once(spark, tmp_path, schema, known)
    assert sorted(r["trial"] for r in got.collect()) == [-3, 1, 2, 5_000]
    # after a restart: a repeat from the first hour, a first report after two days, one that was known before
    reports(spark, f"{tmp_path}/in", [(1, 0, "late"), (2, 48, "again"), (7, 48, "new"), (9, 48, "known"), (8, 0, "late but first")])
    got = report_once(spark, tmp_path, schema, known)
    assert sorted(r["trial"] for r in got.collect()) == [-3, 1, 2, 7, 8, 5_000]
    assert got.columns == ["trial", "ts", "extra"]
    assert spark.conf.get(once.PROVIDER, None) != once.ON_DISK


def test_state_is_one_value_a_block_of_trials(spark, tmp_path):
    spark.range(3 * once.BITS).select(F.col("id").alias("trial"), F.lit(START).alias("ts")).repartition(4).write.parquet(f"{tmp_path}/in")
    got = report_once(spark, tmp_path, spark.read.parquet(f"{tmp_path}/in").schema)
    assert got.count() == 3 * once.BITS
    state = spark.read.format("statestore").option("path", f"{tmp_path}/ck").option("stateVarName", "bits").load()
    assert state.count() == 3
    assert {len(r["value"]["seen"]) for r in state.collect()} == {once.BITS // 8}


@pytest.mark.parametrize("given", [False, True])
def test_a_task_is_marked_once(spark, tmp_path, given):
    def beats(minutes):
        rows = [(t, START + timedelta(minutes=m), i, s) for i, (t, m, s) in enumerate(minutes)]
        df = spark.createDataFrame(rows, "task_id BIGINT, ts TIMESTAMP, beat_id BIGINT, status STRING")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return df.schema

    def run(schema):
        known = spark.createDataFrame([(4, START)], "task_id BIGINT, stale_marked_at TIMESTAMP") if given else None
        stale = heartbeats.stale_tasks(replay.open_stream(spark, f"{tmp_path}/in", schema, files=1))
        replay.drain(stale, f"{tmp_path}/silent", f"{tmp_path}/ck-silent")
        with once.state_on_disk(spark):
            silent = replay.open_stream(spark, f"{tmp_path}/silent", stale.schema)
            found = replay.drain(once.mark_once(silent, known), f"{tmp_path}/out", f"{tmp_path}/ck")
        return sorted((r["task_id"], (r["last_seen_at"] - START).seconds // 60) for r in found.collect())

    # 1 falls silent twice, 2 is idle when it does, 3 never does before the end, 4 is silent as 1 is
    schema = beats([(1, 0, "RUNNING"), (1, 40, "RUNNING"), (2, 0, "IDLE"), (2, 40, "IDLE"), (3, 0, "RUNNING"), (3, 10, "RUNNING"), (4, 5, "RUNNING")])
    beats([(3, 100, "RUNNING"), (1, 100, "RUNNING")])
    beats([(3, 101, "RUNNING")])
    four = [] if given else [(4, 5)]
    assert run(schema) == [(1, 0), (3, 10), *four]
    beats([(5, 110, "RUNNING")])
    beats([(3, 200, "RUNNING")])
    assert run(schema) == [(1, 0), (3, 10), *four, (5, 110)]


def test_a_written_folder_is_read_in_no_more_triggers_than_it_was_written_in(spark, tmp_path):
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for trigger in range(3):
        spark.range(100 * trigger, 100 * trigger + 100).withColumn("task_id", F.col("id") % 40).selectExpr(
            "task_id", "timestamp_seconds(id) AS last_seen_at", "timestamp_seconds(id + 900) AS stale_marked_at"
        ).repartition(2 * partitions if trigger == 0 else partitions).write.mode("append").parquet(f"{tmp_path}/silent")
    schema = spark.read.parquet(f"{tmp_path}/silent").schema
    with once.state_on_disk(spark):
        got = replay.drain(once.mark_once(replay.open_written(spark, f"{tmp_path}/silent", schema)), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(r["task_id"] for r in got.collect()) == list(range(40))
    assert len([f for f in (tmp_path / "ck" / "commits").iterdir() if f.name.isdigit()]) <= 4  # of 16 files
