"""Helpers the operators share: Arrow text as byte arrays, bounded slices, word hashes, block exchange, staging."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 4 << 20  # text worked on at once inside a task
BLOCK_BYTES = 4 << 20  # text that shares a block of the exchange

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a fresh one only under a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to a new table in the shared folder and read it back."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"stage-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that gives freed memory back, or nothing where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


_OWNERS: dict[Callable[[], None], int | None] = {}  # what empties a cache: the stage whose tasks fill it


def _stage() -> int | None:
    context = TaskContext.get()
    return context.stageId() if context else None


def kept_for_stage(empty: Callable[[], None]) -> None:
    """Tasks of this stage fill a cache that ``empty`` empties. A reused Python worker keeps it for them, and for no other stage."""
    release()
    _OWNERS[empty] = _stage()


def release() -> None:
    """Give back caches of other stages, and what earlier slices and batches freed: a reused Python worker would keep it, beside the next task's."""
    stage = _stage()
    past = [empty for empty, owner in _OWNERS.items() if owner != stage]
    for empty in past:
        del _OWNERS[empty]
        empty()
    if past:
        gc.collect()
    _trim()(0)
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values (null: empty) end to end, and len+1 offsets. Opens work on a slice, so freed memory is given back first."""
    release()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8, int(ends[-1])) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0]:], ends - ends[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text each; a longer row stands alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), elementwise."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 17  # values whose prefix sums are held at once


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to the step."""
    up, down = np.full(_STEP + 1, _BASE, U), np.full(_STEP + 1, pow(_BASE, -1, 1 << 64), U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of values[start:end] for many runs, by prefix sums of a polynomial modulo 2 ** 64.

    The sums go step by step; a run across steps is hashed piece by piece, each moved by a power of the base.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    up, down = _powers()
    h = np.zeros(len(starts), U)
    ordered = bool((starts[1:] >= starts[:-1]).all() and (ends[1:] >= ends[:-1]).all())
    total = np.zeros(_STEP + 1, U)
    for low in range(0, len(values), _STEP):
        part = values[low:low + _STEP]
        high = low + len(part)
        if ordered:
            a, b = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(starts, high))
            at = slice(a, b)
        else:
            at = np.flatnonzero((ends > low) & (starts < high))
        s, e = starts[at], ends[at]
        if not len(s):
            continue
        np.cumsum(part * up[:len(part)], out=total[1:len(part) + 1])
        left, right = np.maximum(s, low) - low, np.minimum(e, high) - low
        piece = (total[right] - total[left]) * down[left]
        for i in np.flatnonzero(s < low):  # few: runs that began in an earlier step
            piece[i] *= U(pow(_BASE, low - int(s[i]), 1 << 64))
        h[at] += np.where(right > left, piece, U(0))
    return mix(h + (ends - starts).astype(U) * U(0xC2B2AE3D27D4EB4F) + U(salt))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are no ASCII space, never across texts): starts, ends, first word of each text."""
    solid = ~_SPACE[data]
    inner = np.zeros(len(data) + 1, bool)  # a text starts here
    inner[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | inner[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | inner[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return runs_hash(_BYTE[data], starts, ends)


def grams(hashes: np.ndarray, first: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text: start words, hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.arange(n - size + 1)
    limit = np.repeat(first[1:], np.diff(first))[: len(at)]  # end of the text that a word lies in
    at = at[at + size <= limit]
    return at, runs_hash(hashes, at, at + size, salt)


def block_count(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` of text, and enough of them for all shuffle partitions."""
    size = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(2 * parts(df.sparkSession), -(-size // block_bytes))


def block_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n))
