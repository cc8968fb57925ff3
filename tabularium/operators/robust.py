"""Minimum-determinant covariances per class from deterministic starts.

Columns are centred by the median and scaled by the quartile range. Three scatters start the search: of hyperbolic tangents, of spatial signs, and
of the half of the rows nearest to the centre. From the half nearest under each, concentration steps keep the ``support``
share of rows with the smallest distances until the determinant stands still; the smallest determinant wins, earlier starts
first. Rows that the result trusts, at the 97.5 % point of a chi-square, give the final mean and covariance.

A class whose vectors fit in ``class_bytes`` is fitted in one task. Larger classes run through the whole table together: distances
by matrix products, the cut by radix selection on them, then moments of the rows within it, for all classes and starts at once.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabularium.functions.tails import chi2_quantile
from tabularium.operators import radix
from tabularium.operators.arrow import rows_of
from tabularium.operators.matrix import MODEL, near_centre, whitening
from tabularium.operators.skew import match, small_table

CLASS_BYTES = 64 << 20
SLICE_ROWS = 8_192  # rows of a class worked on at once in its task
STARTS = 3
STILL = 1e-9
QUARTILES = 1.3489795003921634  # range between the quartiles of a standard normal
MODEL_BYTES = 32 << 20  # matrices of the classes that are fitted together


def white(cov: np.ndarray) -> np.ndarray:
    try:
        return whitening(cov)
    except np.linalg.LinAlgError:
        return np.eye(len(cov))


def volume(rows: np.ndarray) -> float:
    """Log determinant; whitening rows have norm 1 / sqrt(eigenvalue)."""
    return float(-np.log((rows ** 2).sum(1)).sum())


def sliced(n: int) -> Iterator[slice]:
    """Runs of rows, so that what is made of them stays small beside a class."""
    return (slice(i, i + SLICE_ROWS) for i in range(0, n, SLICE_ROWS))


def distances(data: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    out = np.empty(len(data))
    for at in sliced(len(data)):
        out[at] = (((data[at] - model[0]) @ model[1].T) ** 2).sum(1)
    return out


def fitted(data: np.ndarray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Model of the rows that the mask keeps, of all without one."""
    kept = np.ones(len(data), bool) if kept is None else kept
    n = np.count_nonzero(kept)
    mean = sum(data[at][kept[at]].sum(0) for at in sliced(len(data))) / n
    cov = np.zeros((data.shape[1],) * 2)
    for at in sliced(len(data)):
        off = data[at][kept[at]] - mean
        cov += off.T @ off
    return mean, white(cov / n)


def scale_of(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    spread = (high - low) / QUARTILES
    return np.where(spread > 0, spread, 1.0)


def transforms(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hyperbolic tangents and spatial signs of scaled rows."""
    norm = np.sqrt((z ** 2).sum(1, keepdims=True))
    return np.tanh(z), z / np.where(norm > 0, norm, 1.0)


def first_models(middle: np.ndarray, scale: np.ndarray, scatters: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Models of the starts: each scatter as a correlation, in the units of the data; the last is of independent columns."""
    out = []
    for s in [*scatters, np.eye(len(middle))]:
        d = np.sqrt(np.clip(np.diag(s), 1e-300, None))
        out.append((middle, white(s / np.outer(d, d) * np.outer(scale, scale))))
    return out


def fit_here(data: np.ndarray, support: float, max_steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Final centre and whitening rows of one class."""
    p = data.shape[1]
    low, middle, high = np.stack([np.quantile(data[:, i], [0.25, 0.5, 0.75]) for i in range(p)], axis=1)
    scale = scale_of(low, high)
    scatters = [np.zeros((p, p)), np.zeros((p, p))]
    for at in sliced(len(data)):
        for total, t in zip(scatters, transforms((data[at] - middle) / scale), strict=True):
            total += t.T @ t
    best = None
    for start in first_models(middle, scale, [total / len(data) for total in scatters]):
        d = distances(data, start)
        model = fitted(data, d <= np.quantile(d, 0.5))
        for step in range(max_steps):
            d = distances(data, model)
            before, model = volume(model[1]), fitted(data, d <= np.quantile(d, support))
            if step and abs(volume(model[1]) - before) < STILL:
                break
        else:
            warnings.warn(f"robust covariance still moving after {max_steps} steps", stacklevel=2)
        if best is None or volume(model[1]) < volume(best[1]) - STILL:
            best = model
    d = distances(data, best)
    middle_d = np.quantile(d, 0.5) / chi2_quantile(0.5, p)
    return fitted(data, d / middle_d < chi2_quantile(0.975, p) if middle_d > 0 else None)


def _summed(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """Arrays (slot, m) added up over tasks, as a matrix."""
    total = rows.select("slot", F.posexplode("m").alias("pos", "v")).groupBy("slot", "pos").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((n, size))
    out[total.column("slot").to_numpy(), total.column("pos").to_numpy()] = total.column("v").to_numpy()
    return out


class Passes:
    """Whole-table passes over vectors ``_x`` of classes that a number ``_g`` names."""

    def __init__(self, source: DataFrame, n: int, p: int):
        self.source, self.n, self.p = source, n, p
        self.centre = near_centre(source, "_x", p)

    def sums(self, slots: int, of_rows) -> np.ndarray:
        """Sums over rows of arrays: ``of_rows(g, data)`` gives (slot, array) for the rows of one class in one chunk."""
        p = self.p

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc: dict[int, np.ndarray] = {}
            for table in radix.chunks(batches):
                data, code = rows_of(table, "_x", p), table.column("_g").to_numpy()
                for g in np.unique(code):
                    for slot, row in of_rows(int(g), data[code == g]):
                        acc[slot] = acc[slot] + row if slot in acc else row
            if acc:
                yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array(list(acc.values()), pa.list_(pa.float64()))], ["slot", "m"])

        return _summed(self.source.mapInArrow(work, "slot int, m array<double>"), slots, 1 + p + p * p)

    def models(self, sums: np.ndarray) -> list:
        out = []
        for row in sums:
            n, mean = row[0], row[1:1 + self.p] / max(row[0], 1)
            cov = row[1 + self.p:].reshape(self.p, self.p) / max(n, 1) - np.outer(mean, mean)
            out.append((mean + self.centre, white((cov + cov.T) / 2)) if n else None)
        return out

    def distance_cuts(self, models: list[list], share: float) -> np.ndarray:
        """Quantile of the distances of each class under each of its models: an array (class, model)."""
        p, width = self.p, len(models[0])
        shared = self.source.sparkSession.sparkContext.broadcast(models)
        names = [f"d{i}" for i in range(width)]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, code = rows_of(batch, "_x", p), batch.column("_g").to_numpy()
                out = np.full((width, len(code)), np.nan)
                for g in np.unique(code):
                    for i, model in enumerate(shared.value[g]):
                        out[i, code == g] = distances(data[code == g], model)
                yield pa.RecordBatch.from_arrays([batch.column("_g"), *[pa.array(d) for d in out]], ["_g", *names])

        found = self.source.mapInArrow(work, "_g int, " + ", ".join(f"{d} double" for d in names))
        values, counts = radix.order_statistics(found, names, self.n, radix.quantile_ranks([share]), 2)
        return radix.interpolated(values, counts, [share])[..., 0]

    def within(self, models: list[list], cuts: np.ndarray, strict: bool = False) -> list[list]:
        """Models of the rows within each cut."""
        width, centre = len(models[0]), self.centre
        shared = self.source.sparkSession.sparkContext.broadcast((models, cuts))

        def of_rows(g: int, data: np.ndarray):
            models, cuts = shared.value
            for i, model in enumerate(models[g]):
                d = distances(data, model)
                kept = data[d < cuts[g, i] if strict else d <= cuts[g, i]] - centre
                yield g * width + i, np.concatenate([[len(kept)], kept.sum(0), (kept.T @ kept).ravel()])

        flat = self.models(self.sums(self.n * width, of_rows))
        return [flat[g * width:(g + 1) * width] for g in range(self.n)]

    def starts(self) -> list[list]:
        names = [f"x{i}" for i in range(self.p)]
        wide = self.source.select("_g", *[F.col("_x")[i].alias(c) for i, c in enumerate(names)])
        values, counts = radix.order_statistics(wide, names, self.n, radix.quantile_ranks([0.25, 0.5, 0.75]), 6)
        low, middle, high = np.moveaxis(radix.interpolated(values, counts, [0.25, 0.5, 0.75]), -1, 0)
        scale, p = scale_of(low, high), self.p

        def of_rows(g: int, data: np.ndarray):
            for i, t in enumerate(transforms((data - middle[g]) / scale[g])):
                yield 2 * g + i, np.concatenate([[len(t)], t.sum(0), (t.T @ t).ravel()])

        sums = self.sums(2 * self.n, of_rows)
        scatter = sums[:, 1 + p:].reshape(-1, p, p) / sums[:, :1, None]
        return [first_models(middle[g], scale[g], [scatter[2 * g], scatter[2 * g + 1]]) for g in range(self.n)]

    def fit(self, support: float, max_steps: int) -> list:
        models = self.starts()
        models = self.within(models, self.distance_cuts(models, 0.5))
        for step in range(max_steps):
            before = np.array([[volume(m[1]) for m in each] for each in models])
            models = self.within(models, self.distance_cuts(models, support))
            after = np.array([[volume(m[1]) for m in each] for each in models])
            if step and np.abs(after - before).max() < STILL:
                break
        else:
            warnings.warn(f"robust covariance still moving after {max_steps} steps", stacklevel=2)
        best = []
        for each in models:
            k = 0
            for i in range(1, len(each)):
                k = i if volume(each[i][1]) < volume(each[k][1]) - STILL else k
            best.append([each[k]])
        middle = self.distance_cuts(best, 0.5) / chi2_quantile(0.5, self.p)
        cuts = np.where(middle > 0, chi2_quantile(0.975, self.p) * middle, np.inf)
        return [each[0] for each in self.within(best, cuts, strict=True)]


def robust_models(df: DataFrame, cls: str, x: str, p: int, support: float = 0.75, max_steps: int = 30, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """One model row per class with at least max(10, p + 3) whole vectors; none for smaller ones."""
    spark, kind = df.sparkSession, df.schema[cls].dataType.simpleString()
    whole = df.select(cls, F.col(x).cast("array<double>").alias("_x")).where(
        (F.size("_x") == p) & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    sizes = whole.groupBy(cls).agg(F.count("*").alias("_n")).where(F.col("_n") >= max(10, p + 3))
    most = class_bytes // (8 * p)
    sizes, _ = small_table(sizes)

    def one(part: pa.Table) -> pa.Table:
        center, rows = fit_here(rows_of(part, "_x", p), support, max_steps)
        return pa.table({cls: part.column(cls)[:1], "center": pa.array([center.tolist()], pa.list_(pa.float64())), "rows": pa.array([rows.tolist()], pa.list_(pa.list_(pa.float64()))),
                         "divisor": pa.array([1.0])})

    models = match(whole, sizes.where(F.col("_n") <= most).drop("_n"), [cls]).groupBy(cls).applyInArrow(one, f"`{cls}` {kind}, {MODEL}")
    together, held = max(1, MODEL_BYTES // (8 * STARTS * p * p)), []

    def add() -> DataFrame:
        codes = spark.createDataFrame([(c, i) for i, c in enumerate(held)], f"`{cls}` {kind}, _g int")
        found = Passes(match(whole, F.broadcast(codes), [cls]).select("_g", "_x"), len(held), p).fit(support, max_steps)
        rows = [(c, m[0].tolist(), m[1].tolist(), 1.0) for c, m in zip(held, found, strict=True)]
        return models.unionByName(spark.createDataFrame(rows, f"`{cls}` {kind}, {MODEL}"))

    for row in sizes.where(F.col("_n") > most).select(cls).toLocalIterator():
        held.append(row[0])
        if len(held) == together:
            models, held = add(), []
    return add() if held else models
