"""Folds over blocks against plain walks, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tabularium.operators import runs, states
from tabularium.operators.states import TRANSITIONS
from tabularium.streaming import replay, stateful


def walked(log):
    out = {}
    for task, _, _, action, worker in sorted(log, key=lambda r: (str(r[0]), r[1], r[2])):
        status, owner, taken, applied, rejected = out.get(task, ("WAITING", None, 0, 0, 0))
        needed, following, owned = TRANSITIONS.get(action, ((), status, False))
        if status in needed and not (owned and (worker is None or owner != worker)):
            owner = worker if action in ("claim", "take_over") else owner
            out[task] = (following, owner, taken + (action == "take_over"), applied + 1, rejected)
        else:
            out[task] = (status, owner, taken, applied, rejected + 1)
    return out


def actions(rng, n, heavy):
    """The hot task ends late, so that hand-overs and owners matter."""
    lively = ["claim", "heartbeat", "stale", "take_over"]
    out = []
    for i in range(n):
        task = 7 if rng.random() < heavy else rng.randrange(20, 60)
        action = rng.choice(lively) if task == 7 and i < 0.9 * n or rng.random() < 0.5 else rng.choice([*TRANSITIONS, "unknown", None])
        out.append((task, i // 3, i, action, rng.choice([1, 2, 3, None, 1 << 40])))
    return out


@pytest.mark.parametrize(("block_bits", "fan_bits"), [(13, 10), (5, 10), (3, 1)])
def test_task_states_in_blocks(spark, block_bits, fan_bits):
    log = actions(random.Random(block_bits), 3000, 0.35)
    df = spark.createDataFrame(log, "task_id long, ts long, event_id long, action string, worker long").repartition(6)
    got = {r.task_id: tuple(r)[1:] for r in states.fold_tasks(df, block_bits, fan_bits).collect()}
    assert got == walked(log)
    assert walked(log)[7][3] > 100 and walked(log)[7][2] > 5  # the hot task changes hands


def test_tables_of_an_empty_log(spark):
    assert states.fold_tasks(spark.createDataFrame([], "task_id long, ts long, event_id long, action string, worker long")).collect() == []


def test_streamed_task_states_equal_the_batch(spark, tmp_path):
    log = actions(random.Random(2), 600, 0.35)
    df = spark.createDataFrame(log, "task_id long, ts long, event_id long, action string, worker long").withColumn("ts", F.timestamp_seconds("ts"))
    places = [str(tmp_path / n) for n in ("in", "tables", "ck1", "out", "ck2")]
    replay.write_slices(df, places[0], "ts", slices=3, files=2)
    stateful.fold_triggers(replay.open_stream(spark, places[0], df.schema, files=2), stateful.task_tables, "task_id", places[1], places[2])
    seen = {}

    def keep(batch, batch_id):
        seen.update({r.task_id: tuple(r)[1:] for r in batch.collect()})

    replay.drain_batches(stateful.task_states(stateful.folded_stream(spark, places[1], stateful.TABLES, files=1)), keep, places[4])
    assert seen == walked(log)


def test_states_of_tasks_follow_triggers_not_files(spark, tmp_path):
    """Tasks of two blocks and without a number; a late trigger finds the states of the first ones."""
    rng = random.Random(3)
    tasks = [None, -5, *range(40), *range(5_000, 5_040), 1 << 50]
    log = [(rng.choice(tasks), i // 3, i, rng.choice([*TRANSITIONS, "claim", "unknown"]), rng.choice([1, 2, None])) for i in range(900)]
    df = spark.createDataFrame(log, "task_id long, ts long, event_id long, action string, worker long").withColumn("ts", F.timestamp_seconds("ts"))
    places = [str(tmp_path / n) for n in ("in", "tables", "ck1", "ck2")]
    replay.write_slices(df, places[0], "ts", slices=3, files=1)
    stateful.fold_triggers(replay.open_stream(spark, places[0], df.schema, files=1), lambda b: stateful.task_tables(b).repartition(8), "task_id", places[1], places[2])
    seen, touched = {}, []

    def keep(batch, batch_id):
        rows = batch.collect()
        touched.append(len(rows))
        seen.update({r.task_id: tuple(r)[1:] for r in rows})

    replay.drain_batches(stateful.task_states(stateful.folded_stream(spark, places[1], stateful.TABLES)), keep, places[3])
    assert seen == walked(log)
    assert len(touched) <= 3  # as many as were folded
    state = spark.read.format("statestore").option("path", places[3]).load()
    assert state.count() == 5  # one value a block


def stopped(values, patience, delta, sign):
    best, best_epoch, wait = None, None, 0
    for epoch, v in enumerate(values, 1):
        if v is not None and v == v and abs(v) < float("inf") and (best is None or sign * v < sign * best - delta):
            best, best_epoch, wait = v, epoch, 0
        else:
            wait += 1
            if wait >= patience:
                return epoch, best_epoch, best
    return None, best_epoch, best


def metric_log(rng):
    """Long falling runs, small steps, ties, missing values, and a run with a third of the rows."""
    out = {1: [100 - 0.25 * i + rng.choice([0.0, 0.25, 1.5]) for i in range(400)]}
    for run in range(2, 14):
        v = rng.choice([3.0, 50.0])
        out[run] = [rng.choice([None, float("nan"), float("inf"), v]) if rng.random() < 0.2 else (v := v - rng.choice([0.0, 0.5, 1.0, 2.0, -1.0])) for _ in range(rng.randrange(1, 120))]
    return out


@pytest.mark.parametrize(("block_bits", "fan_bits", "mode"), [(13, 10, "min"), (4, 10, "max"), (2, 1, "min")])
def test_early_stops_with_a_least_gain(spark, block_bits, fan_bits, mode):
    log, sign = metric_log(random.Random(block_bits)), 1 if mode == "min" else -1
    rows = [(run, e, None if v is None else sign * v) for run, values in log.items() for e, v in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "run long, epoch long, value double").repartition(5)
    for delta in (0.0, 0.5, 1.0):
        moved = runs.improvements(df, "run", "epoch", "value", delta, mode, 16, block_bits, fan_bits)
        want = []
        for run, values in log.items():
            best = None
            for e, v in enumerate(values, 1):
                if v is not None and v == v and v < float("inf") and (best is None or v < best - delta):
                    best = v
                    want.append((run, e, sign * v))
        assert sorted(tuple(r) for r in moved.collect()) == sorted(want)


@pytest.mark.parametrize("delta", [0.0, 1.0])
def test_streamed_early_stops_equal_the_batch(spark, tmp_path, delta):
    log = metric_log(random.Random(11))
    rows = [(run, e, v) for run, values in log.items() for e, v in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "run long, epoch long, value double").withColumn("ts", F.timestamp_seconds("epoch"))
    places = [str(tmp_path / n) for n in ("in", "records", "ck1", "out", "ck2")]
    replay.write_slices(df, places[0], "ts", slices=4, files=2)
    stateful.fold_triggers(replay.open_stream(spark, places[0], df.schema, files=2), stateful.run_records(), "run", places[1], places[2])
    events = stateful.early_stop_events(stateful.folded_stream(spark, places[1], stateful.RECORDS, files=1), 6, delta)
    got = {r.run: (r.epoch, r.best_epoch, r.best_value) for r in replay.drain(events, places[3], places[4]).where("kind = 'stopped'").collect()}
    want = {run: stopped(values, 6, delta, 1) for run, values in log.items()}
    assert got == {run: w for run, w in want.items() if w[0] is not None}


def test_slices_keep_rows_without_a_time(spark, tmp_path):
    df = spark.range(40).select("id", F.when(F.col("id") % 5 > 0, F.timestamp_seconds("id")).alias("ts"))
    replay.write_slices(df, str(tmp_path / "in"), "ts")
    assert spark.read.parquet(str(tmp_path / "in")).count() == 40
