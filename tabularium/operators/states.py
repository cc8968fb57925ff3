"""Task states from action logs, by composing transition tables.

An action changes (status, owner) only by the guards below, and the owner before a stretch of actions matters only in so far as it equals a
worker in it. So a stretch is a table: for each status before it, and for each of its workers as owner or for any other owner, the status
and owner after it with the counts of applied actions and take-overs. Tables compose by looking one's results up in the next.
Stretches are walked side by side, one action a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabularium.operators.arrow import classes_of
from tabularium.operators.blocks import BLOCK_BITS, FAN_BITS, merged, ordered, stretches
from tabularium.session import cut_lineage

# Action -> (states it needs, next state, owner must match).
TRANSITIONS = {
    "claim": (("WAITING",), "RUNNING", False),
    "heartbeat": (("RUNNING",), "RUNNING", True),
    "stale": (("RUNNING",), "STALE", False),
    "take_over": (("STALE",), "RUNNING", False),
    "done": (("RUNNING",), "DONE", True),
    "done_waiting_tell": (("RUNNING",), "DONE_WAITING_TELL", True),
    "told": (("DONE_WAITING_TELL",), "TOLD", False),
    "told_by_worker": (("RUNNING",), "TOLD", True),
    "fail": (("RUNNING", "STALE", "HIJACKED"), "FAILED", True),
}
STATUSES = ("WAITING", "RUNNING", "STALE", "HIJACKED", "DONE_WAITING_TELL", "DONE", "TOLD", "FAILED")
ACTIONS = tuple(TRANSITIONS)
ALLOWED = np.array([[s in TRANSITIONS[a][0] for s in STATUSES] for a in ACTIONS] + [[False] * len(STATUSES)])  # the last row: no known action
LEADS_TO = np.array([STATUSES.index(TRANSITIONS[a][1]) for a in ACTIONS] + [0])
OWNED = np.array([TRANSITIONS[a][2] for a in ACTIONS] + [False])
TAKES = np.array([a in ("claim", "take_over") for a in ACTIONS] + [False])
OPEN = [i for i in range(len(STATUSES)) if ALLOWED[:, i].any()]  # the others are final
NOBODY, OTHER = -1, -2  # owners that equal no worker: none, and whoever it was before

STATE = "status string, owner long, hijack_count long, n_applied long, n_rejected long"


def walk(action: np.ndarray, worker: np.ndarray, start: np.ndarray, size: np.ndarray, status: np.ndarray, owner: np.ndarray):
    """Walk many stretches side by side from their states: status, owner, take-overs and applied actions after them."""
    status, owner = status.copy(), owner.copy()
    taken, applied = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    order = np.argsort(-size, kind="stable")
    active = len(order)
    for step in range(int(size.max(initial=0))):
        while active and size[order[active - 1]] <= step:
            active -= 1
        of = order[:active]
        a, w = action[start[of] + step], worker[start[of] + step]
        ok = ALLOWED[a, status[of]] & (~OWNED[a] | ((owner[of] == w) & (w >= 0)))
        of, a, w = of[ok], a[ok], w[ok]
        status[of] = LEADS_TO[a]
        takes = TAKES[a]
        owner[of[takes]] = w[takes]
        taken[of] += a == ACTIONS.index("take_over")
        applied[of] += 1
    return status, owner, taken, applied


def tables_of(action: np.ndarray, worker: np.ndarray, start: np.ndarray, size: np.ndarray, names: list) -> list[list]:
    """The tables of stretches that lie one after the other, walked side by side from every status and owner that matters. A row of a table:
    status, whether the owner is named, owner, then status, whether the owner stays, owner, take-overs, applied."""
    at = np.repeat(np.arange(len(start)), size)
    named = OWNED[action] & (worker >= 0)
    pairs = np.unique(np.stack([at[named], worker[named]], 1), axis=0)
    of, known = np.append(pairs[:, 0], np.arange(len(start))), np.append(pairs[:, 1], np.full(len(start), OTHER))
    order = np.argsort(of, kind="stable")
    of, owner = np.repeat(of[order], len(OPEN)), np.repeat(known[order], len(OPEN))
    before = np.tile(OPEN, len(order))
    found = zip(before.tolist(), owner.tolist(), *(x.tolist() for x in walk(action, worker, start[of], size[of], before, owner)), strict=True)
    out: list[list] = [[] for _ in range(len(start))]
    for i, one in zip(of.tolist(), found, strict=True):
        out[i].append(row(*one, names))
    return out


def row(status, owner, status_after, owner_after, taken, applied, names: list) -> list:
    name = lambda o: names[o] if o >= 0 else None
    return [int(status), int(owner >= 0), name(owner), int(status_after), int(owner_after == OTHER), name(owner_after), int(taken), int(applied)]


class Table:
    """A function of (status, owner) as a dictionary; owners are worker ids, ``None`` for nobody."""

    def __init__(self, rows: list[list[int]], n: int):
        self.n, self.rows = n, {}
        for s, named, o, s2, stays, o2, taken, applied in rows:
            self.rows[s, ("is", o) if named else "other"] = (s2, "same" if stays else None if o2 is None else ("is", o2), taken, applied)

    def after(self, status: int, owner) -> tuple:
        """(status, owner, take-overs, applied); an owner is ("is", id), None for nobody or "other" for an unknown one."""
        found = self.rows.get((status, owner)) or self.rows.get((status, "other"))
        if found is None:
            return status, owner, 0, 0
        s2, o2, taken, applied = found
        return s2, owner if o2 == "same" else o2, taken, applied

    def then(self, other: "Table") -> "Table":
        out = Table([], self.n + other.n)
        owners = {o for _, o in self.rows} | {o for _, o in other.rows} | {"other"}
        for s in OPEN:
            for o in owners:
                s1, o1, t1, a1 = self.after(s, o)
                s2, o2, t2, a2 = other.after(s1, o1)
                out.rows[s, o] = (s2, "same" if o2 == o else o2, t1 + t2, a1 + a2)
        for s in OPEN:  # an owner that fares like any other needs no row
            rest = out.rows[s, "other"]
            for o in owners - {"other"}:
                if out.rows[s, o] == rest:
                    del out.rows[s, o]
        return out

    def flat(self) -> list[list]:
        out = []
        for (s, o), (s2, o2, taken, applied) in self.rows.items():
            out.append([s, int(o != "other"), o[1] if o != "other" else None, s2, int(o2 == "same"), o2[1] if isinstance(o2, tuple) else None, taken, applied])
        return out


ROW = "array<array<long>>"
_ROW = pa.list_(pa.list_(pa.int64()))


def fold_tasks(log: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS, key: str = "task_id") -> DataFrame:
    """Final state per task from an action log (task_id, ts, event_id, action, worker), starting as WAITING without owner.

    A worker that is null owns nothing and equals no owner; unknown actions are rejected.
    """
    tables = transition_tables(log, block_bits, fan_bits, key, fresh=True)
    kind = log.schema[key].dataType.simpleString()

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Table(r, n).after(0, None) + (n,) for r, n in zip(batch.column("rows").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array([STATUSES[r[0]] for r in rows], pa.string()), pa.array([r[1][1] if r[1] else None for r in rows], pa.int64()),
                *[pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3)], pa.array([r[4] - r[3] for r in rows], pa.int64())],
                [key, "status", "owner", "hijack_count", "n_applied", "n_rejected"])

    return tables.mapInArrow(start, f"`{key}` {kind}, {STATE}")


def transition_tables(log: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS, key: str = "task_id", fresh: bool = False) -> DataFrame:
    """(key, b, n, rows): what a task's actions in the log do to any state before them, or, if the log is ``fresh``, at least to that of a new task."""
    kind = log.schema[key].dataType.simpleString()
    action = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action")), F.lit(0)), F.lit(len(ACTIONS) + 1)) - 1
    rows = ordered(log.select(key, "ts", "event_id", action.cast("int").alias("action"), F.col("worker").cast("long").alias("worker")), key, ["ts", "event_id"])
    schema = f"`{key}` {kind}, b long, n long, rows {ROW}, whole boolean"

    def sum_up(part: pa.Table) -> pa.Table:
        part = part.sort_by("at").combine_chunks()
        act, ids = part.column("action").to_numpy().astype(np.int64), part.column("worker").combine_chunks().dictionary_encode()
        worker = np.nan_to_num(ids.indices.to_numpy(zero_copy_only=False).astype(float), nan=NOBODY).astype(np.int64)
        names = [*ids.dictionary.to_pylist()]
        start, size = stretches(classes_of(part, key)[0])
        whole = (np.arange(len(start)) > 0) & (np.arange(len(start)) < len(start) - 1)  # a task that lies in this block begins and ends in it
        if fresh:
            begin = walk(act, worker, start, size, np.zeros(len(start), np.int64), np.full(len(start), NOBODY))
            flat = [[row(0, NOBODY, *one, names)] for one in zip(*(x.tolist() for x in begin), strict=True)]
            for i in np.flatnonzero(~whole):
                of = slice(start[i], start[i] + size[i])
                flat[i] = tables_of(act[of], worker[of], np.zeros(1, np.int64), size[i : i + 1], names)[0]
        else:
            flat = tables_of(act, worker, start, size, names)
        columns = [part.column(key).take(pa.array(start)), part.column("b").take(pa.array(start)), pa.array(size.astype(np.int64)), pa.array(flat, _ROW), pa.array(whole)]
        return pa.table(columns, [key, "b", "n", "rows", "whole"])

    def merge(part: pa.Table) -> pa.Table:
        part = part.sort_by("b")
        out = None
        for r, n in zip(part.column("rows").to_pylist(), part.column("n").to_pylist(), strict=True):
            out = Table(r, n) if out is None else out.then(Table(r, n))
        return pa.table([part.column(key)[:1], part.column("b")[:1], pa.array([out.n], pa.int64()), pa.array([out.flat()], _ROW)], [key, "b", "n", "rows"])

    parts = cut_lineage(rows.withColumn("b", F.shiftright("at", block_bits)).groupBy("b").applyInArrow(sum_up, schema))
    cut = merged(parts.where("not whole").drop("whole"), key, merge, fan_bits)  # at most two a block
    return parts.where("whole").drop("whole").unionByName(cut)
