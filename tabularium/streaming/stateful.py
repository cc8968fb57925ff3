"""Keyed state over streams: task state machine and early stopping.

A trigger is folded before it meets the state. ``fold_triggers`` sums each micro-batch up as a batch job, in which one key's rows may
spread over many tasks, and writes a few rows per key; the state functions read those. So neither memory nor time of
the stateful task grows with a key's rows in a trigger. A trigger's rows are written under its number, so a repeated trigger replaces them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabularium.operators.runs import falling_records
from tabularium.operators.states import ROW, STATE, STATUSES, Table, transition_tables
from tabularium.streaming.replay import drain_batches, open_stream, open_written


def fold_triggers(stream: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, folder: str, checkpoint: str) -> None:
    """Write ``work`` of each micro-batch with its number ``batch_id`` to a folder of its own, to the end of the input. A key's few rows share a
    file, so that a reader sees all of them at once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).withColumn("batch_id", F.lit(batch_id).cast("long")).repartition(key).write.mode("overwrite").parquet(f"{folder}/trigger={batch_id}")

    drain_batches(stream, write, checkpoint, "append")


def folded_stream(spark: SparkSession, folder: str, schema: str, files: int | None = None) -> DataFrame:
    """Stream over folded triggers, one of them at a time or, by ``files``, in smaller shares."""
    schema += ", batch_id long"
    return open_written(spark, f"{folder}/*", schema) if files is None else open_stream(spark, f"{folder}/*", schema, files)


TABLES = f"task_id BIGINT, n BIGINT, rows {ROW}"


def task_tables(batch: DataFrame) -> DataFrame:
    """What a trigger's actions do to any state before them, one row per task."""
    return transition_tables(batch).select("task_id", "n", "rows")


BLOCK_BITS = 10  # tasks of consecutive numbers whose states share one value
KEPT = np.dtype([("at", "<i8"), ("status", "i1"), ("owned", "?"), ("owner", "<i8"), ("hijacks", "<i8"), ("applied", "<i8"), ("rejected", "<i8")])


def task_states(tables: DataFrame) -> DataFrame:
    """State of each touched task after each trigger, with applied and rejected action counts, from a stream of ``task_tables``.

    A call of the state function costs more than a task does, so the states of a block of consecutive task numbers share one value.
    """

    def whole(x) -> int | None:
        return None if x is None or x != x else int(x)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {int(r[0]): tuple(r)[1:] for r in np.frombuffer(bytes(state.get[0]), KEPT).tolist()} if state.exists else {}
        rows = []
        for part in batches:
            ids = [0] * len(part) if key[0] is None or pd.isna(key[0]) else part["task_id"].tolist()
            rows += [(int(b), int(t), int(n), r) for b, t, n, r in zip(part["batch_id"], ids, part["n"], part["rows"], strict=True)]
        touched = set()
        for _, task, n, table in sorted(rows, key=lambda r: r[0]):
            place, owned, owner, hijacks, applied, rejected = kept.get(task, (0, False, 0, 0, 0, 0))
            function = Table([[whole(x) for x in row] for row in table], n)
            place, holder, taken, done = function.after(place, ("is", owner) if owned else None)
            kept[task] = (place, holder is not None, holder[1] if holder else 0, hijacks + taken, applied + done, rejected + n - done)
            touched.add(task)
        state.update((np.array([(t, *kept[t]) for t in sorted(kept)], KEPT).tobytes(),))
        found = [(None if key[0] is None or pd.isna(key[0]) else t, STATUSES[k[0]], k[2] if k[1] else None, *k[3:]) for t in sorted(touched) for k in [kept[t]]]
        out = pd.DataFrame(found, columns=["task_id", "status", "owner", "hijack_count", "n_applied", "n_rejected"], dtype=object)
        yield out.astype({"task_id": "Int64", "owner": "Int64", "hijack_count": "int64", "n_applied": "int64", "n_rejected": "int64"})

    return tables.withColumn("block", F.shiftright("task_id", BLOCK_BITS)).groupBy("block").applyInPandasWithState(
        step, f"task_id BIGINT, {STATE}", "kept BINARY", "update", GroupStateTimeout.NoTimeout
    )


EVENT = "run BIGINT, epoch BIGINT, kind STRING, best_epoch BIGINT, best_value DOUBLE"
RECORDS = "run BIGINT, epoch BIGINT, value DOUBLE, last BOOLEAN"


def run_records(mode: str = "min") -> Callable[[DataFrame], DataFrame]:
    """Of a trigger only the epochs at which a run's best within it moves, and its last epoch: no other can matter."""

    def work(batch: DataFrame) -> DataFrame:
        rows = batch.select(F.col("run").cast("long"), F.col("epoch").cast("long"), F.col("value").cast("double"))
        moved = falling_records(rows, "run", "epoch", "value", mode).select("run", "epoch", "value", F.lit(False).alias("last"))
        ends = rows.groupBy("run").agg(F.max("epoch").alias("epoch")).select("run", "epoch", F.lit(None).cast("double").alias("value"), F.lit(True).alias("last"))
        return moved.unionByName(ends)

    return work


def early_stop_events(records: DataFrame, patience: int, min_delta: float = 0.0, mode: str = "min") -> DataFrame:
    """``improved`` and ``stopped`` events per run from a stream of ``run_records``; a stopped run ignores what follows.

    Epochs count from 1 without gaps, so the epochs without a gain are those since the best one.
    """
    sign = 1.0 if mode == "min" else -1.0

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, best_epoch, stopped = state.get if state.exists else (None, 0, False)
        rows = sorted(((int(e), bool(end), v) for part in batches for e, v, end in zip(part["epoch"], part["value"], part["last"], strict=True)), key=lambda r: r[:2])
        best = None if best is None or math.isnan(best) else best
        out = []
        for epoch, end, value in rows:
            if stopped:
                break
            if epoch - best_epoch > patience or (end and epoch - best_epoch >= patience):  # ran out before this epoch, or at the last one seen
                stopped = True
                out.append((key[0], best_epoch + patience, "stopped", best_epoch or None, None if best is None else sign * best))
            elif not end and sign * value < (math.inf if best is None else best - min_delta):
                best, best_epoch = sign * value, epoch
                out.append((key[0], epoch, "improved", best_epoch, float(value)))
        state.update((best, best_epoch, stopped))
        if out:
            yield pd.DataFrame(out, columns=["run", "epoch", "kind", "best_epoch", "best_value"]).astype({"best_epoch": "Int64", "best_value": "float64"})

    return records.groupBy("run").applyInPandasWithState(step, EVENT, "best DOUBLE, best_epoch BIGINT, stopped BOOLEAN", "append", GroupStateTimeout.NoTimeout)
