"""Classification metrics, best epochs, early stopping and run diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabularium.operators.arrow import classes_of
from tabularium.operators.blocks import BLOCK_BITS, FAN_BITS, entered, ordered, stretches
from tabularium.operators.skew import match, with_earlier_min, with_next
from tabularium.session import cut_lineage


def confusion(df: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    return df.groupBy(*by, F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 per class over the union of true and predicted classes; 0/0 is 0."""
    cells = confusion(df, by, label, predicted)
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.explode(F.array(
        F.struct(F.col("label").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called")),
    ))
    per = cells.select(*by, sides.alias("s")).groupBy(*by, F.col("s.class").alias("class")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.called").alias("called")
    )
    return per.withColumns({
        "precision": F.coalesce(F.try_divide("tp", "called"), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)),
        "f1": F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("called")), F.lit(0.0)),
    })


def classification_metrics(df: DataFrame, by: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Accuracy, macro precision/recall/F1, weighted F1, and mean recall over the classes in the truth."""
    per = class_metrics(df, by, label, predicted)
    return per.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.sum("support").alias("n_rows"),
    )


def weighted_loss(df: DataFrame, by: Sequence[str], loss: str, size: str, correct: str) -> DataFrame:
    """Batch means weighted by batch size; an empty run divides by 1."""
    n = F.greatest(F.sum(size), F.lit(1))
    return df.groupBy(*by).agg((F.sum(F.col(loss) * F.col(size)) / n).alias("loss"), (F.sum(correct) / n).alias("accuracy"))


def mean_objective(results: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    return results.groupBy(*by).agg(
        F.avg(metric).alias("mean_objective"), F.stddev_samp(metric).alias("std_objective"), F.count(metric).alias("n_folds")
    )


def best_trial(trials: DataFrame, by: Sequence[str], trial: str, value: str, direction: str) -> DataFrame:
    """Best value per study in the study's direction; the lowest trial number wins ties."""
    up = F.col(direction) == "maximize"
    signed = F.when(up, -F.col(value)).otherwise(F.col(value))
    rows = trials.where(F.col(value).isNotNull())
    best = F.min(F.struct(signed.alias("v"), F.col(trial).alias("t"), F.col(value).alias("value")))
    return rows.groupBy(*by, direction).agg(best.alias("b")).select(
        *by, direction, F.col("b.t").alias("best_trial"), F.col("b.value").alias("best_value")
    )


def best_epoch(log: DataFrame, run: str, epoch: str, value: str, mode: str = "min", carry: Sequence[str] = ()) -> DataFrame:
    """Best epoch per run with the metrics it carried; only strict improvement moves it, so the earliest wins."""
    signed = F.col(value) if mode == "min" else -F.col(value)
    best = F.min(F.struct(signed.alias("v"), F.col(epoch).alias("e"), F.col(value).alias("value"), *carry))
    return log.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(run).agg(best.alias("b")).select(
        run, F.col("b.e").alias("best_epoch"), F.col("b.value").alias("best_value"), *[F.col(f"b.{c}").alias(c) for c in carry]
    )


def improvements(log: DataFrame, run: str, epoch: str, value: str, min_delta: float = 0.0, mode: str = "min", block: int = 10_000,
                 block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """Epochs at which the running best moves: the value beats the best by more than ``min_delta``.

    Such an epoch is always a strict record, and records come from block-wise running minima. With no
    ``min_delta`` they are the answer. Otherwise a block of records is a step function of the best before it, and functions
    compose: first each block learns the best that reaches it, then it marks the records that move it.
    """
    records = falling_records(log, run, epoch, value, mode, block)
    if min_delta > 0:
        signed = records.select(run, "epoch", (F.col("value") if mode == "min" else -F.col("value")).alias("_v"))
        moved = _moved(signed, run, min_delta, block_bits, fan_bits)
        records = moved.select(run, "epoch", (F.col("_v") if mode == "min" else -F.col("_v")).alias("value"))
    return records


def falling_records(log: DataFrame, run: str, epoch: str, value: str, mode: str = "min", block: int = 10_000) -> DataFrame:
    """(run, epoch, value) of the epochs whose finite value is better than all before it."""
    signed = F.col(value).cast("double") if mode == "min" else -F.col(value).cast("double")
    clean = log.select(run, F.col(epoch).alias("epoch"), signed.alias("_v")).where("_v is not null and not isnan(_v) and _v < double('Infinity')")
    records = with_earlier_min(clean, [run], F.floor(F.col("epoch") / block), ["epoch"], "_v", "_low").where("_low is null or _v < _low")
    return records.select(run, "epoch", (F.col("_v") if mode == "min" else -F.col("_v")).alias("value"))


def followers(v: np.ndarray, delta: float) -> np.ndarray:
    """For falling values the place of the next that is lower by more than ``delta``; its own length where none is."""
    return first_below(v, v, delta)


def reached(v: np.ndarray, delta: float) -> np.ndarray:
    """The last value of the chain of followers from each place, by doubled pointers."""
    to = followers(v, delta)
    last = np.where(to < len(v), to, np.arange(len(v)))
    while (further := last[last] != last).any():
        last = np.where(further, last[last], last)
    return v[last]


def short(steps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring steps with one end only the lowest; as many stay as there are ends within the least gain of the lowest record."""
    keep = np.append(ends[1:] != ends[:-1], True)[: len(ends)]
    return steps[keep], ends[keep]


def _moved(records: DataFrame, run: str, delta: float, block_bits: int, fan_bits: int) -> DataFrame:
    rows = ordered(records, run, ["epoch"]).withColumn("b", F.shiftright("at", block_bits))
    kind = records.schema[run].dataType.simpleString()

    def sum_up(part: pa.Table) -> pa.Table:
        part = part.sort_by("at").combine_chunks()
        v = part.column("_v").to_numpy()
        start, size = stretches(classes_of(part, run)[0])
        each = [short(v[a:a + n], reached(v[a:a + n], delta)) for a, n in zip(start, size, strict=True)]
        return pa.table([part.column(run).take(pa.array(start)), part.column("b").take(pa.array(start)), *[pa.array([x[k].tolist() for x in each], pa.list_(pa.float64())) for k in (0, 1)]],
                        [run, "b", "steps", "ends"])

    def after(best: np.ndarray, steps: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best behind a block for bests before it: that of the chain from the first record low enough."""
        place = first_below(steps, best, delta)
        return np.where(place < len(steps), ends[np.minimum(place, len(steps) - 1)], best)

    def functions(part: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.array(s), np.array(e)) for s, e in zip(part.column("steps").to_pylist(), part.column("ends").to_pylist(), strict=True)]

    def merge(part: pa.Table) -> pa.Table:
        """Neighbouring step functions as one: a best that no record of the first block beats goes on to the next."""
        part = part.sort_by("b")
        steps, ends = [], np.zeros(0)
        for s, e in functions(part):
            ends = np.append(after(ends, s, e), e)
            steps, ends = short(np.append(steps, s), ends)
        return pa.table([part.column(run)[:1], part.column("b")[:1], pa.array([steps.tolist()], pa.list_(pa.float64())), pa.array([ends.tolist()], pa.list_(pa.float64()))], [run, "b", "steps", "ends"])

    def enter(part: pa.Table, best: float) -> np.ndarray:
        out = []
        for s, e in functions(part):
            out.append(best)
            best = float(after(np.array([best]), s, e)[0])
        return np.array(out)

    def mark(part: pa.Table, entries: pa.Table) -> pa.Table:
        part = part.sort_by("at").combine_chunks()
        v, known = part.column("_v").to_numpy(), dict(zip(entries.column(run).to_pylist(), entries.column("entry").to_pylist(), strict=True))
        start, size = stretches(classes_of(part, run)[0])
        kept = []
        for a, n, name in zip(start, size, part.column(run).take(pa.array(start)).to_pylist(), strict=True):
            mine, to = v[a:a + n], followers(v[a:a + n], delta)
            at = int(first_below(mine, np.array([known[name]]), delta)[0])
            while at < n:
                kept.append(a + at)
                at = int(to[at])
        return part.take(pa.array(kept, pa.int64())).select([run, "epoch", "_v"])

    parts = cut_lineage(rows.groupBy("b").applyInArrow(sum_up, f"`{run}` {kind}, b long, steps array<double>, ends array<double>"))
    entries = entered(parts, run, merge, enter, float("inf"), fan_bits)
    return rows.groupBy("b").cogroup(entries.groupBy("b")).applyInArrow(mark, records.select(run, "epoch", "_v").schema)


def first_below(v: np.ndarray, best: np.ndarray, delta: float) -> np.ndarray:
    """Place of the first of falling values that is lower than each best by more than ``delta``."""
    place = np.searchsorted(-v, -(best - delta), side="left")
    while (behind := (place < len(v)) & ~(v[np.minimum(place, len(v) - 1)] < best - delta)).any():
        place = place + behind
    return place


def early_stop(
    log: DataFrame, run: str, epoch: str, value: str, patience: int, min_delta: float = 0.0, mode: str = "min", block: int = 10_000
) -> DataFrame:
    """Per run: stop_epoch (null if it never stops) with the best epoch and value at that time.

    Epochs count from 1 without gaps. An improvement at e stops the run at e + patience if the next
    improvement comes later than that. The best is infinite before the first epoch, so a run without a finite
    value for ``patience`` epochs stops there, with no best epoch.
    """
    moved = improvements(log, run, epoch, value, min_delta, mode, block)
    before = log.select(run).distinct().select(run, F.lit(0).cast(moved.schema["epoch"].dataType).alias("epoch"), F.lit(None).cast("double").alias("value"))
    moved = moved.unionByName(before)
    steps = with_next(moved, [run], F.floor(F.col("epoch") / block), ["epoch"], "epoch", "_next")
    ends = log.groupBy(run).agg(F.max(epoch).alias("last_epoch"))
    joined = match(steps, ends, [run])
    quiet_until = F.coalesce(F.col("_next") - 1, F.col("last_epoch"))
    stops = quiet_until - F.col("epoch") >= patience
    first = F.min(F.when(stops, F.struct(F.col("epoch"), F.col("value"))))
    last = F.max(F.struct(F.col("epoch"), F.col("value")))
    return joined.groupBy(run, "last_epoch").agg(first.alias("s"), last.alias("l")).select(
        run, "last_epoch", (F.col("s.epoch") + patience).alias("stop_epoch"),
        F.nullif(F.coalesce("s.epoch", "l.epoch"), F.lit(0)).alias("best_epoch"),
        F.when(F.col("s").isNotNull(), F.col("s.value")).otherwise(F.col("l.value")).alias("best_value"),
    )


def diagnostics(
    log: DataFrame, run: str, epoch: str, train_loss: str, val_loss: str, train_acc: str, val_acc: str, grad: str,
    window: int = 5, min_delta: float = 0.0, vanish: float = 1e-6, explode: float = 1e3, over: float = 0.2, under: float = 0.5,
) -> DataFrame:
    """Convergence flags per run; the thresholds are ours, given as parameters.

    plateau: no improvement of the validation loss for ``window`` epochs, from the improvement before
    it; vanishing/exploding: gradient norm outside the bounds at any epoch; overfit: last validation
    loss above training loss by more than ``over``; underfit: last training accuracy below ``under``.
    """
    stops = early_stop(log, run, epoch, val_loss, window, min_delta).select(
        run, F.col("stop_epoch").isNotNull().alias("plateau"), (F.col("stop_epoch") - window).alias("plateau_start_epoch")
    )
    last = F.max(F.struct(F.col(epoch), F.col(train_loss).alias("tl"), F.col(val_loss).alias("vl"), F.col(train_acc).alias("ta"), F.col(val_acc).alias("va")))
    bad = F.col(val_loss).isNull() | F.isnan(F.col(val_loss).cast("double"))
    per = log.groupBy(run).agg(
        last.alias("_z"), F.max(bad).alias("nan_loss"), F.max(F.coalesce(F.col(grad) < vanish, F.lit(False))).alias("vanishing_gradient"),
        F.max(F.coalesce(F.col(grad) > explode, F.lit(False))).alias("exploding_gradient"),
        F.min(val_loss).alias("best_val_loss"), F.max(val_acc).alias("best_val_acc"),
    )
    gap = F.col("_z.vl") - F.col("_z.tl")
    return match(per, stops, [run], "left").select(
        run, F.coalesce("plateau", F.lit(False)).alias("plateau"), "plateau_start_epoch", "nan_loss", "vanishing_gradient",
        "exploding_gradient", (gap > over).alias("overfitting"), (F.col("_z.ta") < under).alias("underfitting"),
        gap.alias("loss_gap"), (F.col("_z.ta") - F.col("_z.va")).alias("acc_gap"), "best_val_loss", "best_val_acc",
    )
