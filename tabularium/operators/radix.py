"""Exact order statistics by radix selection on the sortable form of doubles.

The bits of a double, read as an unsigned integer (all turned over if it is negative, else only the sign), sort like the numbers. A pass counts,
for every group and feature, how many values have each 16-bit digit after the prefixes that are still wanted; the counts
combine in the scan's tasks, so what is shuffled is bounded by groups, features and digits and not by rows. A pass tells for each
wanted rank its digit. Once the wanted buckets hold few values in all, the last pass counts those values themselves. Usually two
passes suffice: a bucket of one digit is a sixteenth of an octave, of two a millionth.

Groups are numbered from 0 in a column of the input (``codes``), or a row belongs to several, as bits of a mask (``mask``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

U = np.uint64
DIGIT = 16
CHUNK_ROWS = 1 << 16  # rows of a task that are counted together
FEW_VALUES = 4_000_000  # values that the last pass may count one by one
MOST_TARGETS = 2_000_000  # ranks that are looked for at once; they pass the driver

COUNTS = "g int, f int, p long, k long, n long"
_COUNTS = ["g", "f", "p", "k", "n"]


def sortable(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one."""
    bits = (np.asarray(x, np.float64) + 0.0).view(U)
    return np.where(bits >> U(63) > 0, ~bits, bits | U(1 << 63))


def doubles(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u, U)
    return np.where(u >> U(63) > 0, u & U((1 << 63) - 1), ~u).view(np.float64)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Batches joined to tables of at least ``rows`` rows, but the last."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles; missing values are NaN."""
    return table.column(name).to_numpy().astype(np.float64, copy=False)


def members(masks: np.ndarray, n_groups: int) -> np.ndarray:
    """rows x groups, 1 where the row's mask has the group's bit."""
    return ((masks[:, None] >> np.arange(n_groups)) & 1).astype(np.int64)


def _per_key(keys: np.ndarray, codes: np.ndarray | None, belongs: np.ndarray | None, n_groups: int):
    """(group, key, count) of all that occur."""
    order = np.argsort(keys, kind="stable") if codes is None else np.lexsort((keys, codes))
    keys = keys[order]
    if codes is not None:
        codes = codes[order]
        start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1])))
        return codes[start], keys[start], np.diff(np.append(start, len(keys)))
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sums = np.add.reduceat(belongs[order], start, axis=0)
    at, g = np.nonzero(sums)
    return g, keys[start[at]], sums[at, g]


def _count(source: DataFrame, feats: Sequence[str], n_groups: int, mask: bool, prefixes: dict | None, digits: int, whole: bool) -> DataFrame:
    """Counts per group, feature, prefix of ``digits`` digits and next digit (or, ``whole``, all remaining bits)."""
    shared = source.sparkSession.sparkContext.broadcast(prefixes) if prefixes is not None else None
    below = 64 - DIGIT * digits
    rest = 0 if whole else below - DIGIT

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            member = table.column("_g").to_numpy().astype(np.int64)
            for f, name in enumerate(feats):
                x = numbers(table, name)
                good = np.isfinite(x)
                codes = None if mask else member
                if not mask:
                    good &= (codes >= 0) & (codes < n_groups)
                u = sortable(x)
                if shared is not None:
                    wanted = shared.value.get(f)
                    if wanted is None:
                        continue
                    prefix = u >> U(below)
                    every = np.unique(wanted[1]) if mask else wanted[1]
                    good &= np.isin(prefix, every)
                at = np.flatnonzero(good)
                if not len(at):
                    continue
                belongs = members(member[at], n_groups) if mask else None
                g, keys, n = _per_key(u[at] >> U(rest), None if mask else codes[at], belongs, n_groups)
                p = keys >> U(below - rest) if digits else np.zeros(len(keys), U)
                if shared is not None:  # only what this group asks for
                    pairs = wanted[0].astype(np.int64)
                    asked = reduce(np.logical_or, [(g == group) & np.isin(p, wanted[1][pairs == group]) for group in np.unique(pairs)], np.zeros(len(g), bool))
                    g, keys, n, p = g[asked], keys[asked], n[asked], p[asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.astype(np.int32)), pa.array(np.full(len(g), f, np.int32)), pa.array(p.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], _COUNTS)

    return source.mapInArrow(work, COUNTS).groupBy("g", "f", "p", "k").agg(F.sum("n").alias("n"))


TARGETS = "g int, f int, t int, rank long, p long, total long"
FOUND = "g int, f int, t int, rank long, p long, size long, total long"


def _locate(counts: DataFrame, targets: DataFrame | None, ranks: Callable[[int], np.ndarray]) -> DataFrame:
    """For each wanted rank the key it lies in, its rank among that key's values and how many there are."""

    def first(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        k, n = part.column("k").to_numpy().view(U), part.column("n").to_numpy()
        order = np.argsort(k)
        k, n = k[order], n[order]
        ends = np.cumsum(n)
        wanted = np.asarray(ranks(int(ends[-1])), np.int64)
        at = np.searchsorted(ends, wanted, side="right")
        m = len(wanted)
        return pa.Table.from_arrays([
            pa.array(np.full(m, key[0].as_py(), np.int32)), pa.array(np.full(m, key[1].as_py(), np.int32)), pa.array(np.arange(m, dtype=np.int32)), pa.array(wanted - (ends - n)[at]),
            pa.array(k[at].view(np.int64)), pa.array(n[at]), pa.array(np.full(m, ends[-1]))], ["g", "f", "t", "rank", "p", "size", "total"])

    def later(part: pa.Table, asked: pa.Table) -> pa.Table:
        k, n, p = part.column("k").to_numpy().view(U), part.column("n").to_numpy(), part.column("p").to_numpy().view(U)
        order = np.argsort(k)  # the prefix leads the key
        k, n, p = k[order], n[order], p[order]
        ends = np.append(0, np.cumsum(n))
        want, prefix = asked.column("rank").to_numpy(), asked.column("p").to_numpy().view(U)
        at = np.searchsorted(ends, ends[np.searchsorted(p, prefix)] + want, side="right") - 1
        left = ends[np.searchsorted(p, prefix)] + want - ends[at]
        return pa.Table.from_arrays([asked.column("g"), asked.column("f"), asked.column("t"), pa.array(left), pa.array(k[at].view(np.int64)), pa.array(n[at]), asked.column("total")],
                                    ["g", "f", "t", "rank", "p", "size", "total"])

    if targets is None:
        return counts.groupBy("g", "f").applyInArrow(first, FOUND)
    return counts.groupBy("g", "f").cogroup(targets.groupBy("g", "f")).applyInArrow(later, FOUND)


def order_statistics(source: DataFrame, feats: Sequence[str], n_groups: int, ranks: Callable[[int], np.ndarray], n_ranks: int, mask: bool = False,
                     few: int = FEW_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """Values at the 0-based ranks that ``ranks(count)`` asks for, as an array (group, feature, rank), and the counts (group, feature) of finite
    values. Where there are none, the values are NaN.

    ``source`` has the feature columns and ``_g``, a group number (others take no part) or, with ``mask``, bits of groups.
    """
    feats = list(feats)
    if n_groups * len(feats) * n_ranks > MOST_TARGETS:
        raise ValueError("too many groups for one selection")
    source = source.select("_g", *[F.col(f).cast("double").alias(f) for f in feats])
    spark, asked, prefixes, digits = source.sparkSession, None, None, 0
    out, totals = np.full((n_groups, len(feats), n_ranks), np.nan), np.zeros((n_groups, len(feats)), np.int64)
    whole = False
    while True:
        found = _locate(_count(source, feats, n_groups, mask, prefixes, digits, whole), asked, ranks).toArrow()
        g, f, t, rank, p, size = (found.column(c).to_numpy() for c in ("g", "f", "t", "rank", "p", "size"))
        digits += 1
        totals[g, f] = found.column("total").to_numpy()
        if whole or digits == 4 or not len(g):
            out[g, f, t] = doubles(p.view(U))
            return out, totals
        once = np.unique(np.stack([g.astype(np.int64), f.astype(np.int64), p, size]), axis=1)
        whole = int(once[3].sum()) <= few
        prefixes = {int(k): (once[0][once[1] == k], once[2][once[1] == k].view(U)) for k in np.unique(once[1])}
        asked = spark.createDataFrame(found.select(["g", "f", "t", "rank", "p", "total"]), TARGETS)


def quantile_ranks(probs: Sequence[float]) -> Callable[[int], np.ndarray]:
    """Ranks on both sides of each quantile."""
    def ranks(n: int) -> np.ndarray:
        at = (n - 1) * np.asarray(probs, np.float64)
        return np.stack([np.floor(at), np.ceil(at)], 1).ravel().astype(np.int64)

    return ranks


def interpolated(values: np.ndarray, counts: np.ndarray, probs: Sequence[float]) -> np.ndarray:
    """Quantiles (group, feature, prob) from values at ``quantile_ranks``, as the built-in percentile interpolates."""
    at = (counts[..., None] - 1) * np.asarray(probs, np.float64)
    low, high = values[..., 0::2], values[..., 1::2]
    return np.where(low == high, low, (np.ceil(at) - at) * low + (at - np.floor(at)) * high)
