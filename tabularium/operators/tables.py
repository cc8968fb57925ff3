"""Keyed upserts, state folds and purges over append-only tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def upsert(
    old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = (), stamp: str | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """New rows win column by column, except the ``keep`` columns of a row that already existed.

    Of several new rows for a key the last in ``order`` (then by the other columns) counts, as if they came one by
    one; ``keep`` columns of a new key come from the first.
    """
    keys = list(keys)
    position = F.struct(*order, *[c for c in new.columns if c not in order and c not in keys])
    one = new.groupBy(*keys).agg(F.max(position).alias("_last"), F.min(position).alias("_first"))
    new = one.select(*keys, *[F.col("_first" if c in keep else "_last")[c].alias(c) for c in new.columns if c not in keys])
    rest = [c for c in old.columns if c not in keys]
    incoming = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest if c in new.columns], F.lit(True).alias("_new"))
    existing = old.withColumn("_old", F.lit(True))
    joined = existing.join(incoming, keys, "full_outer")
    is_new, was_old = F.coalesce("_new", F.lit(False)), F.coalesce("_old", F.lit(False))
    columns = []
    for c in rest:
        if c == stamp:
            columns.append(F.when(is_new, F.current_timestamp()).otherwise(F.col(c)).alias(c))
        elif c not in new.columns:
            columns.append(F.col(c))
        elif c in keep:
            columns.append(F.when(was_old, F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
        else:
            columns.append(F.when(is_new, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return joined.select(*keys, *columns)


def latest(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Newest row per key as a combined maximum: nothing is sorted or gathered."""
    top = F.max(F.struct(*order, *[c for c in columns if c not in order]))
    return df.groupBy(key).agg(top.alias("_t")).select(key, *[F.col("_t")[c].alias(c) for c in columns])


def fold_heartbeats(beats: DataFrame, overwrite: Sequence[str], sticky: Sequence[str], order: Sequence[str] = ("ts", "beat_id")) -> DataFrame:
    """Current row per worker: overwritten fields from the newest beat, sticky ones from the newest non-null."""
    position = F.struct(*order)
    return beats.groupBy("worker_uid").agg(
        *[F.max(F.struct(*order, F.col(c).alias("_v")))["_v"].alias(c) for c in overwrite],
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v"))))["_v"].alias(c) for c in sticky],
        F.max(position)[order[0]].alias("last_seen_at"), F.count("*").alias("n_beats"),
    )


def fold_slots(files: DataFrame) -> DataFrame:
    """Checkpoint slot pointers from registered files.

    INTERVAL, EPOCH and RECOVERY move *latest*; BEST moves *best* with its metric; FINAL moves *final*,
    finalises the slot, and sets *latest* only if no other file had set it before.
    """
    at = ["created_at", "file_id"]
    moving = F.col("kind").isin("INTERVAL", "EPOCH", "RECOVERY")

    def newest(when: Column, column: str = "file_id") -> Column:
        return F.max(F.when(when, F.struct(*at, F.col(column).alias("_v"))))["_v"]

    progress = moving | (F.col("kind") == "FINAL")
    return files.groupBy("slot_id").agg(
        newest(moving).alias("_latest"), F.min(F.when(F.col("kind") == "FINAL", F.struct(*at)))["file_id"].alias("_first_final"),
        newest(F.col("kind") == "BEST").alias("best_file_id"), newest(F.col("kind") == "BEST", "metric").alias("best_metric"),
        newest(F.col("kind") == "FINAL").alias("final_file_id"),
        newest(progress & F.col("epoch").isNotNull(), "epoch").alias("current_epoch"),
        newest(progress, "kind").alias("_last_kind"),
    ).select(
        "slot_id", F.coalesce("_latest", "_first_final").alias("latest_file_id"), "best_file_id", "best_metric", "final_file_id", "current_epoch",
        F.when(F.col("_last_kind").isNull(), "EMPTY").when(F.col("_last_kind") == "FINAL", "FINALIZED").otherwise("READY").alias("resume_status"),
    )


def task_defaults(requests: DataFrame, stages: DataFrame) -> DataFrame:
    """New tasks with the stage's direction and tell status filled in; a missing stage is an error row."""
    joined = requests.join(stages.select("stage_no", "model_type", "trials", F.col("direction").alias("_d"), F.lit(True).alias("_s")), ["stage_no", "model_type"], "left")
    return joined.select(
        "task_id", "stage_no", "model_type",
        F.coalesce("direction", "_d").alias("direction"),
        F.coalesce("tell_status", F.when(F.col("trials") > 0, "PENDING").otherwise("NOT_REQUIRED")).alias("tell_status"),
        F.lit("WAITING").alias("status"), F.coalesce("_s", F.lit(False)).alias("stage_found"),
    )


def require_stage(tasks: DataFrame) -> DataFrame:
    message = F.format_string("no stage %s for model %s", F.col("stage_no").cast("string"), "model_type")
    return tasks.withColumn("status", F.when(F.col("stage_found"), F.col("status")).otherwise(F.raise_error(message).cast("string")))


def purge(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def cleanup_counts(targets: DataFrame, listing: DataFrame, key: str, dry_run: bool = True) -> DataFrame:
    """How many targets a cleanup finds, and misses; nothing is removed."""
    present = listing.select(key).distinct().withColumn("_there", F.lit(True))
    return targets.join(present, key, "left").agg(
        F.count_if(F.col("_there")).alias("deleted"), F.count_if(F.col("_there").isNull()).alias("not_found"),
        F.lit(0).cast("bigint").alias("errors"), F.lit(dry_run).alias("dry_run"),
    )
