"""Class moments and bin counts of many features in many overlapping samples, in one pass.

``_mask`` says with one bit per sample which of them a row belongs to. Bin edges are exact order statistics of each sample, found
by radix selection; then a single Arrow pass adds up, for every sample, class and feature, count, sum and sum of squares, and
the rows in each bin. Only those sums are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabularium.operators import radix
from tabularium.operators.arrow import classes_of

MOST_SAMPLES = 62  # bits of a mask that are used


def bin_edges(df: DataFrame, feats: Sequence[str], samples: int, bins: int) -> np.ndarray:
    """Lower edges of the bins but the first: an array (sample, feature, bin). A value lies in as many bins above the first as it reaches edges.

    The bin of a value is floor(rows below it * bins / rows), so equal values share a bin.
    """
    inner = np.arange(1, bins)

    def ranks(n: int) -> np.ndarray:
        at = -(-inner * n // bins)  # fewest rows that must lie below
        return np.stack([np.maximum(at - 1, 0), np.minimum(at, n - 1)], 1).ravel()

    source = df.select(F.col("_mask").alias("_g"), *feats)
    values, counts = radix.order_statistics(source, feats, samples, ranks, 2 * len(inner), mask=True)
    before, edge = values[..., 0::2], values[..., 1::2]
    at = -(-inner * counts[..., None] // bins)
    edge = np.where(before == edge, np.nextafter(edge, np.inf), edge)  # a tie over the edge belongs below it
    return np.where(at >= counts[..., None], np.inf, edge)


def class_sums(df: DataFrame, cls: str, feats: Sequence[str], edges: np.ndarray) -> DataFrame:
    """(sample, class, f, bin, n, s, q): per bin the count, and with bin -1 count, sum and sum of squares about a common centre; the centres
    per feature come in ``c``."""
    samples, n_feats, inner = edges.shape
    feats = list(feats)
    few = df.select(*[F.col(f).cast("double").alias(f) for f in feats]).limit(64).toArrow()
    centre = np.array([x[np.isfinite(x)].mean() if np.isfinite(x).any() else 0.0 for x in (radix.numbers(few, f) for f in feats)])
    shared = df.sparkSession.sparkContext.broadcast((edges, centre))
    names = ["sample", "cls", "f", "bin", "n", "s", "q"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, centre = shared.value
        for table in radix.chunks(batches):
            belongs = radix.members(table.column("_mask").to_numpy(), samples)
            code, classes = classes_of(table, "cls")
            k = len(classes)
            one = [np.flatnonzero(code == j) for j in range(k)]
            out: list[tuple] = []
            for f, name in enumerate(feats):
                x = radix.numbers(table, name)
                good = np.isfinite(x)
                d = np.where(good, x - centre[f], 0.0)
                parts = np.stack([good.astype(float), d, d * d], 1)
                totals = np.stack([belongs[of].T @ parts[of] for of in one])  # class, sample, (n, s, q)
                c, b = np.nonzero(totals[..., 0])
                out.append((b, c, np.full(len(c), f), np.full(len(c), -1), *totals[c, b].T))
                for b in range(samples):
                    at = np.flatnonzero(good & (belongs[:, b] > 0))
                    cells = np.bincount(code[at] * (inner + 1) + np.searchsorted(edges[b, f], x[at], side="right"), minlength=k * (inner + 1))
                    cell = np.flatnonzero(cells)
                    zero = np.zeros(len(cell))
                    out.append((np.full(len(cell), b), cell // (inner + 1), np.full(len(cell), f), cell % (inner + 1), cells[cell], zero, zero))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            like = table.schema.field("cls").type
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0].astype(np.int32)), pa.array(classes, like).take(pa.array(columns[1])), *[pa.array(c.astype(np.int32)) for c in columns[2:4]],
                 pa.array(columns[4].astype(np.int64)), *map(pa.array, columns[5:])], names)

    kind = df.schema[cls].dataType.simpleString()
    source = df.select("_mask", F.col(cls).alias("cls"), *[F.col(f).cast("double").alias(f) for f in feats])
    rows = source.mapInArrow(work, f"sample int, cls {kind}, f int, bin int, n long, s double, q double")
    sums = rows.groupBy("sample", "cls", "f", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    return sums.withColumn("c", F.element_at(F.array(*[F.lit(float(c)) for c in centre]), F.col("f") + 1))
