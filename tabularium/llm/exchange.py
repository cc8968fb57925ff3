"""Which of many hashed keys occur in more than one block of documents.

Blocks send each of their distinct keys once, so a key that a third of all documents share costs one entry a block. Keys
travel as packed arrays, one row per block and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabularium.llm.common import mix, parts, release

U = np.uint64
ONE = U(1)
BUCKET_BYTES = 8 << 20  # text whose keys share a bucket
ROWS = "bucket long, block long, keys binary, ids binary"
ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])


def buckets(df: DataFrame, text: str) -> int:
    size = df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(parts(df.sparkSession), -(-size // BUCKET_BYTES))


def packed(block: int, keys: np.ndarray, ids: np.ndarray | None, n: int) -> pa.Table:
    """The keys (their lowest bit is a flag and does not choose the bucket), each with an id if given, by bucket."""
    place = (mix((keys | ONE) + U(0x632BE59BD9B4E019)) >> U(16)) % U(n)
    order = np.argsort(place, kind="stable")
    keys, place = keys[order], place[order]
    ids = None if ids is None else ids[order]
    cuts = np.flatnonzero(np.diff(place)) + 1
    starts, ends = np.append(0, cuts), np.append(cuts, len(keys))
    if not len(keys):
        return ARROW.empty_table()
    return pa.Table.from_arrays([
        pa.array(place[starts].astype(np.int64)), pa.array(np.full(len(starts), block)), pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        pa.array([None if ids is None else ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
    ], schema=ARROW)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Keys, the row that each came from, and their ids. Opens work on a bucket, so freed memory is given back first."""
    release()
    raw = table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(raw), U)
    owner = np.repeat(np.arange(len(raw)), [len(r) // 8 for r in raw])
    ids = table.column("ids").to_pylist()
    return keys, owner, np.frombuffer(b"".join(ids), np.int64) if ids and ids[0] is not None else None


def _returned(table: pa.Table, owner: np.ndarray, keys: np.ndarray, ids: np.ndarray | None) -> pa.Table:
    blocks = np.array(table.column("block").to_pylist(), np.int64)
    order = np.argsort(owner, kind="stable")
    owner, keys = owner[order], keys[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    starts, ends = (np.append(0, cuts), np.append(cuts, len(keys))) if len(keys) else (cuts, cuts)
    ids = None if ids is None else ids[order]
    return pa.Table.from_arrays([
        pa.array(np.full(len(starts), -1)), pa.array(blocks[owner[starts]]), pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
        pa.array([None if ids is None else ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
    ], schema=ARROW)


def common_keys(entries: DataFrame) -> DataFrame:
    """For each block its keys that another block has too, if any of their entries is flagged; flags are cleared."""

    def work(table: pa.Table) -> pa.Table:
        keys, owner, _ = unpacked(table)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        bare = keys & ~ONE
        new = np.append(True, bare[1:] != bare[:-1]) if len(bare) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        count = np.bincount(group)
        flagged = np.bincount(group, (keys & ONE).astype(float)) > 0
        keep = ((count > 1) & flagged)[group] if len(group) else np.zeros(0, bool)
        return _returned(table, owner[keep], bare[keep], None)

    return entries.groupBy("bucket").applyInArrow(work, ROWS)


def smaller_owners(entries: DataFrame) -> DataFrame:
    """For each block its keys that some other block holds with a smaller id, and the smallest such id."""

    def work(table: pa.Table) -> pa.Table:
        keys, owner, ids = unpacked(table)
        if ids is None:
            return _returned(table, owner[:0], keys[:0], keys[:0].astype(np.int64))
        order = np.lexsort((ids, keys))
        keys, owner, ids = keys[order], owner[order], ids[order]
        new = np.append(True, keys[1:] != keys[:-1])
        least = ids[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        keep = ids > least
        return _returned(table, owner[keep], keys[keep], least[keep])

    return entries.groupBy("bucket").applyInArrow(work, ROWS)


def listed(table: pa.Table) -> Iterator[np.ndarray]:
    """All keys that came back to a block, sorted, and their ids in the same order."""
    keys, _, ids = unpacked(table)
    order = np.argsort(keys)
    yield keys[order]
    yield ids[order] if ids is not None else np.zeros(0, np.int64)


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys
