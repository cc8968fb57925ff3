"""Folds over ordered rows in which one key may hold any share of all rows.

Rows are sorted by range, so a hot key lies in many partitions, and cut into blocks of bounded size wherever they fall. A stretch of a
key's rows inside a block is summed up as a function of the state before it. Functions compose: neighbouring ones are merged, level by
level where a key has very many, until one is left for a key, or until the state before each block is known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabularium.session import cut_lineage

BLOCK_BITS, FAN_BITS = 13, 10  # rows of a block, functions merged at once


def ordered(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows with ``at``, a number that ascends by key and then by ``order``; evaluated once. The input's row numbers break ties."""
    by = [F.col(key), *[F.col(c) for c in order], F.col("_tie")]
    rows = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    return cut_lineage(rows.withColumn("at", F.monotonically_increasing_id()))


def stretches(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal numbers."""
    start = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(names)))


def most(parts: DataFrame, key: str) -> int:
    return parts.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def merged(parts: DataFrame, key: str, merge: Callable[[pa.Table], pa.Table], fan_bits: int = FAN_BITS) -> DataFrame:
    """One function per key from functions in order of ``b``. ``merge`` makes one row, with its key and ``b``, of neighbouring rows."""
    columns = parts.schema
    while most(parts, key) > 1 << fan_bits:
        parts = cut_lineage(parts.withColumn("b", F.shiftright("b", fan_bits)).groupBy(key, "b").applyInArrow(merge, columns))
    return parts.groupBy(key).applyInArrow(merge, columns)


def entered(parts: DataFrame, key: str, merge: Callable[[pa.Table], pa.Table], enter: Callable[[pa.Table, float], np.ndarray], first: float, fan_bits: int = FAN_BITS) -> DataFrame:
    """(key, b, entry): the state before each part. ``enter`` gives it for parts in order, from the state before the first of them."""
    levels, columns = [parts], parts.schema
    while most(levels[-1], key) > 1 << fan_bits:
        up = levels[-1].withColumn("b", F.shiftright("b", fan_bits)).groupBy(key, "b").applyInArrow(merge, columns)
        levels.append(cut_lineage(up))
    kind = parts.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, b long, entry double"

    def states(table: pa.Table, entry: float) -> pa.Table:
        table = table.sort_by("b")
        return pa.Table.from_arrays([table.column(key), table.column("b"), pa.array(enter(table, entry), pa.float64())], [key, "b", "entry"])

    def top(table: pa.Table) -> pa.Table:
        return states(table, first)

    def below(table: pa.Table, given: pa.Table) -> pa.Table:
        return states(table, given.column("entry")[0].as_py())

    found = levels[-1].groupBy(key).applyInArrow(top, schema)
    for lower in reversed(levels[:-1]):
        grouped = lower.withColumn("up", F.shiftright("b", fan_bits)).groupBy(key, "up")
        found = grouped.cogroup(cut_lineage(found).withColumnRenamed("b", "up").groupBy(key, "up")).applyInArrow(below, schema)
    return found
