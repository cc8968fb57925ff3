"""Append-only run logs with a fixed schema per log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

_UNIT = "task_id BIGINT, stage_no INT, model_type STRING, trial_number INT, repeat_id INT, fold_id INT, "

# The columns of each log.
LOGS: dict[str, str] = {
    "fold_result": _UNIT + (
        "run_id STRING, optuna_study_name STRING, seed INT, train_size INT, val_size INT, test_size INT, "
        "accuracy DOUBLE, balanced_accuracy DOUBLE, macro_precision DOUBLE, macro_recall DOUBLE, macro_f1 DOUBLE, "
        "weighted_precision DOUBLE, weighted_recall DOUBLE, weighted_f1 DOUBLE, val_loss DOUBLE, train_loss DOUBLE, "
        "best_epoch INT, runtime_seconds DOUBLE, checkpoint_file_id BIGINT"
    ),
    "epoch_metric": _UNIT + (
        "epoch INT, train_loss DOUBLE, val_loss DOUBLE, train_acc DOUBLE, val_acc DOUBLE, "
        "val_balanced_accuracy DOUBLE, val_macro_precision DOUBLE, val_macro_recall DOUBLE, val_macro_f1 DOUBLE, "
        "val_weighted_precision DOUBLE, val_weighted_recall DOUBLE, val_weighted_f1 DOUBLE, "
        "lr_backbone DOUBLE, lr_head DOUBLE, lr_quantum DOUBLE, "
        "grad_norm_global DOUBLE, grad_norm_backbone DOUBLE, grad_norm_head DOUBLE, grad_norm_quantum DOUBLE"
    ),
    "convergence": _UNIT + (
        "loss_plateau_detected BOOLEAN, plateau_start_epoch INT, vanishing_gradient_detected BOOLEAN, "
        "exploding_gradient_detected BOOLEAN, nan_loss_detected BOOLEAN, overfitting_detected BOOLEAN, "
        "underfitting_detected BOOLEAN, train_val_loss_gap DOUBLE, train_val_acc_gap DOUBLE, "
        "train_val_macro_f1_gap DOUBLE, best_val_loss DOUBLE, best_val_accuracy DOUBLE, best_val_macro_f1 DOUBLE, "
        "best_epoch INT, diagnostic_note STRING, barren_plateau_indicator BOOLEAN, "
        "quantum_gradient_plateau_indicator BOOLEAN"
    ),
    "statistical_test": (
        "stage_no INT, metric_name STRING, model_a STRING, model_b STRING, test_name STRING, statistic_value DOUBLE, "
        "p_value DOUBLE, alpha DOUBLE, significant BOOLEAN, n_a INT, n_b INT, data_source STRING"
    ),
    "effect_size": (
        "stage_no INT, metric_name STRING, model_a STRING, model_b STRING, effect_size_name STRING, "
        "effect_size_value DOUBLE, interpretation STRING, confidence_interval_low DOUBLE, "
        "confidence_interval_high DOUBLE, data_source STRING"
    ),
    "artifact": _UNIT + (
        "artifact_type STRING, storage_backend STRING, local_path STRING, remote_uri STRING, sha256 STRING"
    ),
}


def conform(rows: DataFrame, log: str) -> DataFrame:
    """Typed log rows: absent columns are null, unknown ones are an error; id and creation time are added."""
    schema = T.StructType.fromDDL(LOGS[log])
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns for {log}: {sorted(unknown)}")
    typed = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    return rows.select(F.expr("uuid()").alias("log_id"), *typed, F.current_timestamp().alias("created_at"))


def append(rows: DataFrame, log: str, folder: str) -> None:
    conform(rows, log).write.mode("append").parquet(f"{folder}/{log}")


def append_stream(rows: DataFrame, log: str, folder: str, checkpoint: str):
    """The same append as a stream, exactly once per input file under a checkpoint."""
    return (
        conform(rows, log).writeStream.format("parquet").option("path", f"{folder}/{log}")
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
