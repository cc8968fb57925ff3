"""Marks that are set once, kept in named state variables of the query itself.

No sink is reread: what was marked lies in the state store, is restored from the query's checkpoint after a restart, and may start from a
table of earlier marks. The store is the one on disk that the state API needs; its setting is put back once the query has started.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BITS = 4_096  # trials whose marks share one value of the state


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the state store on disk."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ON_DISK)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class FirstSilence(StatefulProcessor):
    """A task's first silence; ``marked`` holds when it was marked, in microseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marked = handle.getValueState("marked", "at BIGINT")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):
            self.marked.update((int(initialState["stale_us"].min()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.marked.exists():
            for _ in rows:
                pass
            return
        first = None
        for part in rows:
            least = part.nsmallest(1, "stale_us")
            if len(least) and (first is None or least["stale_us"].iloc[0] < first["stale_us"].iloc[0]):
                first = least
        if first is not None:
            self.marked.update((int(first["stale_us"].iloc[0]),))
            yield first[["task_id", "last_seen_us", "stale_us"]]

    def close(self) -> None:
        pass


def mark_once(silences: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """(task_id, last_seen_at, stale_marked_at): each task's first silence, once for ever, from a stream of what ``heartbeats.stale_tasks`` wrote.

    Tasks in ``marked`` (task_id, stale_marked_at) are taken as marked before the stream starts. Start the query under ``state_on_disk``. Session
    windows cannot share a query with it, since their state is not closed before this one opens; closed sessions are few, so a folder lies between.
    """
    kind = silences.schema["task_id"].dataType.simpleString()
    micros = silences.select("task_id", F.unix_micros("last_seen_at").alias("last_seen_us"), F.unix_micros("stale_marked_at").alias("stale_us"))
    known = None if marked is None else marked.select(F.col("task_id").cast(kind), F.unix_micros("stale_marked_at").alias("stale_us")).groupBy("task_id")
    found = micros.groupBy("task_id").transformWithStateInPandas(
        FirstSilence(), f"task_id {kind}, last_seen_us BIGINT, stale_us BIGINT", "Append", "None", initialState=known
    )
    return found.select("task_id", F.timestamp_micros("last_seen_us").alias("last_seen_at"), F.timestamp_micros("stale_us").alias("stale_marked_at"))


class FirstReports(StatefulProcessor):
    """Which trials of a block of consecutive numbers were reported: one bit each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bits = handle.getValueState("bits", "seen BINARY")

    def _load(self) -> np.ndarray:
        seen = np.frombuffer(bytes(self.bits.get()[0]), np.uint8) if self.bits.exists() else np.zeros(BITS // 8, np.uint8)
        return np.unpackbits(seen).astype(bool)

    def _fresh(self, trials: pd.Series, seen: np.ndarray) -> np.ndarray:
        """Marks the trials and tells which rows are the first of theirs."""
        at = trials.to_numpy(np.int64) % BITS
        first = np.zeros(len(at), bool)
        first[np.unique(at, return_index=True)[1]] = True
        first &= ~seen[at]
        seen[at] = True
        return first

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        seen = self._load()
        self._fresh(initialState["trial"], seen)
        self.bits.update((np.packbits(seen).tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self._load()
        before = int(seen.sum())
        for part in rows:
            yield part[self._fresh(part["trial"], seen)].drop(columns="block")
        if int(seen.sum()) > before:
            self.bits.update((np.packbits(seen).tobytes(),))

    def close(self) -> None:
        pass


def once_per_trial(reports: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Exactly-once result reports: of a trial's rows one reaches the sink, however late a repeat comes.

    ``trial`` is a whole number; rows without one are no report and are left out. A trial costs one bit of state, since numbers are handed out in
    sequence. Trials in ``known`` (trial) count as reported. Of repeats in one trigger any may stay. Start the query under ``state_on_disk``.
    """
    block = F.floor(F.col("trial") / BITS).cast("bigint").alias("block")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reports.schema)
    given = None if known is None else known.filter("trial IS NOT NULL").select(block, F.col("trial").cast("bigint")).groupBy("block")
    return reports.filter("trial IS NOT NULL").select("*", block).groupBy("block").transformWithStateInPandas(
        FirstReports(), fields, "Append", "None", initialState=given
    )
