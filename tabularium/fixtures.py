"""Role mapping from the given tables to the shapes the operators work on.

Each view is one list of SQL expressions that Spark and the SQL checker both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

STATUS = (
    "CASE o_orderkey % 8 WHEN 0 THEN 'WAITING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'DONE_WAITING_TELL' WHEN 3 THEN 'TOLD' "
    "WHEN 4 THEN 'DONE' WHEN 5 THEN 'FAILED' WHEN 6 THEN 'STALE' ELSE 'CANCELLED' END"
)
MODEL = "CASE WHEN {0} % 2 = 0 THEN 'classical' ELSE 'hybrid' END"

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    # five stages with a model type each
    "task": ("orders", (
        "o_orderkey AS task_id",
        "CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage_no",
        MODEL.format("o_custkey") + " AS model_type",
        f"{STATUS} AS status",
        "CASE WHEN o_orderkey % 8 = 3 THEN 'TOLD' WHEN o_orderkey % 8 IN (0, 1, 2) AND o_orderkey % 3 > 0 THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS tell_status",
        "CASE WHEN o_orderkey % 8 > 0 THEN o_custkey % 130 END AS worker_id",
        "o_orderkey % 1000 AS slot_id",
        "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS objective_value",
        "CASE WHEN o_orderkey % 8 > 0 THEN o_orderdate END AS last_heartbeat",
        "CASE WHEN o_orderkey % 8 IN (2, 3, 4) AND o_orderkey % 7 > 0 THEN o_orderdate END AS completed_at",
        "CASE WHEN o_orderkey % 8 = 6 AND o_orderkey % 3 > 0 THEN o_orderdate END AS stale_marked_at",
        "o_orderdate AS updated_at",
    )),
    # one small stage per customer, so that every signal occurs
    "customer_task": ("orders", (
        "o_orderkey AS task_id", "CAST(o_custkey AS INT) AS stage_no", MODEL.format("o_custkey") + " AS model_type",
        "CASE WHEN o_custkey % 7 = 0 AND o_orderkey % 8 < 3 THEN 'TOLD' WHEN o_custkey % 5 = 0 AND o_orderkey % 8 IN (0, 1, 6) THEN 'DONE_WAITING_TELL' "
        f"WHEN o_custkey % 3 = 0 AND o_orderkey % 8 IN (0, 6) THEN 'RUNNING' WHEN o_custkey % 11 = 0 THEN 'FAILED' ELSE {STATUS} END AS status",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS tell_status",
        "o_orderdate AS updated_at",
    )),
    "customer_stage": ("customer", (
        "CAST(c_custkey AS INT) AS stage_no", MODEL.format("c_custkey") + " AS model_type", "c_name AS stage_name",
        "CAST(c_nationkey % 12 AS INT) AS trials", "CASE WHEN c_nationkey % 2 = 0 THEN 'maximize' ELSE 'minimize' END AS direction",
    )),
    "worker": ("supplier", ("s_suppkey AS worker_id", "s_name AS worker_name", "s_nationkey AS gpu_count")),
    "beat": ("events", (
        "concat('w', CAST(user_id AS VARCHAR(20))) AS worker_uid", "event_id AS beat_id", "ts",
        "CASE event_type WHEN 'view' THEN 'IDLE' WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'UPLOADING' WHEN 'error' THEN 'FAILED' ELSE 'OFFLINE' END AS status",
        "CASE WHEN event_id % 3 = 0 THEN concat('name', CAST(event_id % 50 AS VARCHAR(20))) END AS worker_name",
        "CASE WHEN event_id % 4 > 0 THEN props END AS metadata",
        "CASE WHEN event_type = 'click' THEN event_id END AS task_id",
        "CASE WHEN event_type = 'purchase' THEN event_id % 100 END AS checkpoint_epoch",
    )),
    "file": ("lineitem", (
        "l_orderkey % 1000 AS slot_id",
        "l_orderkey * 1000000000 + l_partkey * 100000 + l_suppkey * 100 + l_linenumber AS file_id",
        "CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'INTERVAL' ELSE 'EPOCH' END "
        "WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'BEST' ELSE 'RECOVERY' END ELSE 'FINAL' END AS kind",
        "CASE WHEN l_linenumber > 1 THEN l_linenumber END AS epoch", "l_extendedprice AS metric", "l_quantity AS size_bytes",
        "l_suppkey AS worker_id", "'remote' AS remote", "concat('/files/', CAST(l_orderkey AS VARCHAR(20)), '.bin') AS relative_path",
        "l_shipdate AS created_at",
    )),
}


def view(tables, name: str) -> DataFrame:
    source, expressions = VIEWS[name]
    return getattr(tables, source).selectExpr(*[e.replace("AS VARCHAR(20)", "AS STRING") for e in expressions])


def cte(*names: str) -> str:
    """``WITH`` clause with the same views for the SQL checker."""
    parts = [f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names]
    return "WITH " + ",\n".join(parts)
