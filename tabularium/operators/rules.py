"""Value rules of the run-tracking tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tabularium.operators.relate import enum_rule

# Allowed values per table and column, and whether null is allowed.
ALLOWED: dict[str, dict[str, tuple[tuple[str, ...], bool]]] = {
    "stage": {
        "model_type": (("classical_fully_spatial", "hybrid_qcqcnn"), False),
        "objective": (("SANITY", "WARM_START", "CONVERGENCE", "MAX_ACCURACY", "FINALIZATION"), False),
        "split_strategy": (("SIMPLE_80_20", "CV_5_FOLD", "REPEATED_5_FOLD"), False),
        "direction": (("minimize", "maximize"), True),
        "tuning_focus": (("NONE", "CONVERGENCE", "ACCURACY", "FINAL_EVALUATION"), True),
        "early_stop_mode": (("min", "max"), True),
        "early_stop_monitor": (("val_loss", "val_accuracy", "val_macro_f1", "val_balanced_accuracy"), True),
    },
    "worker": {"worker_type": (("LOCAL_PC", "LAPTOP", "LAB_PC", "CLOUD_CPU", "CLOUD_GPU"), False)},
    "slot": {"resume_status": (("EMPTY", "READY", "FINALIZED", "BROKEN"), False)},
    "task": {
        "model_type": (("classical_fully_spatial", "hybrid_qcqcnn"), False),
        "status": (("WAITING", "RUNNING", "DONE_WAITING_TELL", "TOLD", "DONE", "FAILED", "STALE", "HIJACKED", "CANCELLED"), False),
        "direction": (("minimize", "maximize"), True),
        "tell_status": (("NOT_REQUIRED", "PENDING", "TOLD", "FAILED"), False),
    },
    "checkpoint": {
        "kind": (("INTERVAL", "EPOCH", "BEST", "FINAL", "RECOVERY"), False),
        "upload_status": (("LOCAL_ONLY", "PENDING_UPLOAD", "UPLOADED", "VERIFIED", "FAILED"), False),
        "storage_backend": (("gdrive_rclone",), False),
    },
    "heartbeat": {"status": (("IDLE", "RUNNING", "UPLOADING", "FAILED", "OFFLINE"), False)},
    "event": {"event_type": (("STALE", "OFFLINE", "RECOVERED"), False)},
}


def enumerations(table: str, columns: Sequence[str] | None = None) -> dict[str, Column]:
    return {c: enum_rule(c, values, nullable) for c, (values, nullable) in ALLOWED[table].items() if columns is None or c in columns}


def stage_ranges() -> dict[str, Column]:
    train, validation = F.col("train_ratio"), F.col("validation_ratio")
    return {
        "ratio": (train > 0) & (validation >= 0) & (train <= 1) & (validation <= 1),
        "epoch": F.col("max_epoch") > 0, "trials": F.col("trials") >= 0,
    }


def task_ranges() -> dict[str, Column]:
    return {"hijack_count": F.col("hijack_count") >= 0}


def checkpoint_ranges() -> dict[str, Column]:
    """A missing size is allowed: a rule that is null holds."""
    return {"size_bytes": F.col("size_bytes") >= 0}
