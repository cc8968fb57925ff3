"""Upserts, folds and purges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.catalog.scans import scratch
from tabularium.fixtures import cte, view
from tabularium.operators import states, tables
from tabularium.sources import snapshots


@query("worker_upsert", "K1", """
SELECT coalesce(n.k, o.k) AS worker_uid, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS worker_name,
       CASE WHEN n.k IS NOT NULL THEN n.seen ELSE o.seen END AS last_seen_at, coalesce(o.id, n.id) AS worker_id
FROM (SELECT user_id AS k, 'old' AS name, max(ts) AS seen, min(event_id) AS id FROM events WHERE user_id % 3 > 0 AND event_type = 'view' GROUP BY 1) o
FULL JOIN (SELECT user_id AS k, CASE WHEN user_id % 4 > 0 THEN 'new' END AS name, max(ts) AS seen, max(event_id) AS id FROM events WHERE user_id % 2 = 0 GROUP BY 1) n USING (k)
""")
def worker_upsert(t):
    """Registration: new values overwrite, nulls included, and the first id stays."""
    def side(rows, name, number):
        return rows.groupBy(F.col("user_id").alias("worker_uid")).agg(
            F.first(name).alias("worker_name"), F.max("ts").alias("last_seen_at"), number("event_id").alias("worker_id")
        )

    old = side(t.events.where("user_id % 3 > 0 and event_type = 'view'"), F.lit("old"), F.min)
    new = side(t.events.where("user_id % 2 = 0"), F.when(F.col("user_id") % 4 > 0, "new"), F.max)
    return tables.upsert(old, new, ["worker_uid"], keep=["worker_id"])


@query("heartbeat_fold", "K2 W9 ST1", cte("beat") + """
, r AS (SELECT *, row_number() OVER (PARTITION BY worker_uid ORDER BY ts DESC, beat_id DESC) AS rn FROM beat),
f AS (SELECT worker_uid, arg_max(worker_name, beat_id) FILTER (WHERE worker_name IS NOT NULL) AS worker_name, arg_max(metadata, beat_id) FILTER (WHERE metadata IS NOT NULL) AS metadata,
  arg_max(checkpoint_epoch, beat_id) FILTER (WHERE checkpoint_epoch IS NOT NULL) AS checkpoint_epoch, count(*) AS n_beats FROM beat GROUP BY 1)
SELECT r.worker_uid, r.status, r.task_id, f.worker_name, f.metadata, f.checkpoint_epoch, f.n_beats, epoch_us(r.ts) AS last_seen_us FROM r JOIN f USING (worker_uid) WHERE rn = 1
""")
def heartbeat_fold(t):
    rows = tables.fold_heartbeats(view(t, "beat"), ["status", "task_id"], ["worker_name", "metadata", "checkpoint_epoch"])
    return rows.withColumn("last_seen_us", F.unix_micros(F.col("last_seen_at").cast("timestamp"))).drop("last_seen_at")


@query("stage_upsert", "K3", """
SELECT coalesce(n.stage_no, o.stage_no) AS stage_no, coalesce(n.model_type, o.model_type) AS model_type,
       CASE WHEN n.stage_no IS NOT NULL THEN n.trials ELSE o.trials END AS trials, CASE WHEN n.stage_no IS NOT NULL THEN n.name ELSE o.name END AS stage_name
FROM (SELECT c_custkey AS stage_no, c_mktsegment AS model_type, c_nationkey AS trials, c_name AS name FROM customer WHERE c_custkey % 3 > 0) o
FULL JOIN (SELECT c_custkey AS stage_no, c_mktsegment AS model_type, c_nationkey + 100 AS trials, NULL AS name FROM customer WHERE c_custkey % 2 = 0) n
ON o.stage_no = n.stage_no AND o.model_type = n.model_type
""")
def stage_upsert(t):
    rows = t.customer.select(
        F.col("c_custkey").alias("stage_no"), F.col("c_mktsegment").alias("model_type"), F.col("c_nationkey").alias("trials"), F.col("c_name").alias("stage_name")
    )
    new = rows.where("stage_no % 2 = 0").withColumns({"trials": F.col("trials") + 100, "stage_name": F.lit(None).cast("string")})
    return tables.upsert(rows.where("stage_no % 3 > 0"), new, ["stage_no", "model_type"])


ACTIONS = {"signup": "claim", "click": "heartbeat", "view": "stale", "purchase": "done_waiting_tell", "error": "fail"}
# a second action per type for every other event, so that all transitions occur
OTHERS = {"signup": "take_over", "click": "claim", "view": "claim", "purchase": "told", "error": "told_by_worker"}
ACTION_SQL = "CASE WHEN event_id % 2 = 0 THEN CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END ELSE CASE event_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in OTHERS.items()) + " END END"
LOG = ["user_id * 100 + CAST(date_part('day', ts) AS BIGINT) AS task_id", "ts", "event_id", f"{ACTION_SQL} AS action", "event_id % 2 AS worker"]


def action_log(t):
    return t.events.selectExpr(*LOG)


STATE_SQL = f"""
WITH RECURSIVE raw AS (SELECT {', '.join(LOG)} FROM events), log AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS i FROM raw),
ok AS (SELECT * FROM (VALUES ('claim','WAITING','RUNNING',0,0), ('heartbeat','RUNNING','RUNNING',1,0), ('stale','RUNNING','STALE',0,0), ('take_over','STALE','RUNNING',0,1),
  ('done_waiting_tell','RUNNING','DONE_WAITING_TELL',1,0), ('told','DONE_WAITING_TELL','TOLD',0,0), ('told_by_worker','RUNNING','TOLD',1,0),
  ('fail','RUNNING','FAILED',1,0), ('fail','STALE','FAILED',1,0)) AS v(action, needed, following, owned, hijack)),
walk(task_id, i, status, owner, hijacks, applied) AS (
  SELECT DISTINCT task_id, CAST(0 AS BIGINT), 'WAITING', CAST(NULL AS BIGINT), 0, 0 FROM log
  UNION ALL
  SELECT w.task_id, l.i, coalesce(o.following, w.status), CASE WHEN o.action IN ('claim', 'take_over') THEN l.worker ELSE w.owner END,
    w.hijacks + coalesce(o.hijack, 0), w.applied + CASE WHEN o.action IS NULL THEN 0 ELSE 1 END
  FROM walk w JOIN log l ON l.task_id = w.task_id AND l.i = w.i + 1
  LEFT JOIN ok o ON o.action = l.action AND o.needed = w.status AND (o.owned = 0 OR w.owner = l.worker))
SELECT task_id, arg_max(status, i) AS status, max(CASE WHEN last THEN owner END) AS owner, CAST(max(hijacks) AS BIGINT) AS hijack_count,
  CAST(max(applied) AS BIGINT) AS n_applied, CAST(max(i) - max(applied) AS BIGINT) AS n_rejected
FROM (SELECT *, i = max(i) OVER (PARTITION BY task_id) AS last FROM walk) GROUP BY task_id
"""


@query("task_states", "K4 X6", STATE_SQL)
def task_states(t):
    return states.fold_tasks(action_log(t))


@query("checkpoint_slots", "K5", cte("file") + """
, m AS (SELECT slot_id, arg_max(file_id, (created_at, file_id)) FILTER (WHERE kind IN ('INTERVAL', 'EPOCH', 'RECOVERY')) AS latest,
  arg_min(file_id, (created_at, file_id)) FILTER (WHERE kind = 'FINAL') AS first_final, arg_max(file_id, (created_at, file_id)) FILTER (WHERE kind = 'BEST') AS best_file_id,
  arg_max(file_id, (created_at, file_id)) FILTER (WHERE kind = 'FINAL') AS final_file_id, arg_max(kind, (created_at, file_id)) FILTER (WHERE kind <> 'BEST') AS last_kind FROM file GROUP BY 1)
SELECT slot_id, coalesce(latest, first_final) AS latest_file_id, best_file_id, final_file_id,
  CASE WHEN last_kind IS NULL THEN 'EMPTY' WHEN last_kind = 'FINAL' THEN 'FINALIZED' ELSE 'READY' END AS resume_status FROM m
""")
def checkpoint_slots(t):
    return tables.fold_slots(view(t, "file")).select("slot_id", "latest_file_id", "best_file_id", "final_file_id", "resume_status")


@query("new_task_defaults", "K6", cte("customer_task", "customer_stage") + """
, r AS (SELECT task_id, stage_no + task_id % 2 AS stage_no, model_type, CASE WHEN task_id % 5 = 0 THEN 'minimize' END AS direction,
        CASE WHEN task_id % 7 = 0 THEN 'FAILED' END AS tell_status FROM customer_task)
SELECT r.task_id, r.stage_no, r.model_type, coalesce(r.direction, s.direction) AS direction,
  coalesce(r.tell_status, CASE WHEN s.trials > 0 THEN 'PENDING' ELSE 'NOT_REQUIRED' END) AS tell_status, 'WAITING' AS status, s.stage_no IS NOT NULL AS stage_found
FROM r LEFT JOIN customer_stage s ON r.stage_no = s.stage_no AND r.model_type = s.model_type
""")
def new_task_defaults(t):
    rows = view(t, "customer_task").select(
        "task_id", (F.col("stage_no") + F.col("task_id") % 2).alias("stage_no"), "model_type",
        F.when(F.col("task_id") % 5 == 0, "minimize").alias("direction"), F.when(F.col("task_id") % 7 == 0, "FAILED").alias("tell_status"),
    )
    return tables.task_defaults(rows, view(t, "customer_stage"))


@query("purged_rows", "K7", """
SELECT l_orderkey, count(*) AS n_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1
""")
def purged_rows(t):
    """Rows left after every task of one stage has been purged."""
    keys = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.purge(t.lineitem.select("l_orderkey"), keys, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n_rows"))


TASKS_SQL = """
WITH task AS (SELECT o_orderkey AS task_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage_no, CASE WHEN o_custkey % 2 = 0 THEN 'classical' ELSE 'hybrid' END AS model_type,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 2 END AS checkpoint_slot_id FROM orders),
gone AS (SELECT task_id, checkpoint_slot_id FROM task WHERE stage_no = 3 AND model_type = 'hybrid'),
log AS (SELECT l_orderkey AS task_id, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT task_id FROM gone))
"""


@query("stage_reset", "K7", TASKS_SQL + """
SELECT 'epoch_metric_log' AS name, count(*) AS n_rows FROM log UNION ALL SELECT 'fold_run_result', count(*) FROM log WHERE l_linenumber <= 2
UNION ALL SELECT 'convergence_diagnostic_summary', count(*) FROM log WHERE l_linenumber = 1 UNION ALL SELECT 'checkpoint_file', count(*) FROM log WHERE l_linenumber >= 3
UNION ALL SELECT 'task', count(*) FROM task WHERE task_id NOT IN (SELECT task_id FROM gone)
UNION ALL SELECT 'checkpoint_slot', count(*) FROM task WHERE checkpoint_slot_id NOT IN (SELECT checkpoint_slot_id FROM gone WHERE checkpoint_slot_id IS NOT NULL)
UNION ALL SELECT 'active stages', count(*) FROM (SELECT DISTINCT stage_no, model_type FROM task) WHERE stage_no = 1 OR (stage_no = 3 AND model_type = 'hybrid')
""")
def stage_reset(t):
    """Rows of every table after one stage's tasks are purged, and the stages that are active then."""
    root, log = scratch(t.spark, "runs"), t.lineitem.select(F.col("l_orderkey").alias("task_id"), "l_linenumber")
    task = t.orders.selectExpr("o_orderkey AS task_id", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS stage_no", "CASE WHEN o_custkey % 2 = 0 THEN 'classical' ELSE 'hybrid' END AS model_type",
                               "CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 2 END AS checkpoint_slot_id")
    snapshots.replace(t.spark, root, {
        "epoch_metric_log": log, "fold_run_result": log.where("l_linenumber <= 2"), "convergence_diagnostic_summary": log.where("l_linenumber = 1"), "checkpoint_file": log.where("l_linenumber >= 3"),
        "task": task, "checkpoint_slot": task.where("checkpoint_slot_id IS NOT NULL").select("checkpoint_slot_id"),
        "stage_information": task.select("stage_no", "model_type", (F.col("stage_no") == 1).alias("is_active")).distinct(),
    })
    snapshots.reset_stage(t.spark, root, 3, "hybrid")
    names = (*snapshots.TASK_TABLES, "checkpoint_slot")
    parts = [snapshots.open_table(t.spark, root, n).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows")) for n in names]
    parts.append(snapshots.open_table(t.spark, root, "stage_information").where("is_active").agg(F.lit("active stages").alias("name"), F.count("*").alias("n_rows")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("cleanup_counts", "K8", """
SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM documents)) AS deleted, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS not_found,
  CAST(0 AS BIGINT) AS errors, true AS dry_run FROM (SELECT doc_id * 2 AS doc_id FROM labels)
""")
def cleanup_counts(t):
    return tables.cleanup_counts(t.labels.select((F.col("doc_id") * 2).alias("doc_id")), t.documents, "doc_id")


@query("stamped_upsert", "K9", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_custkey % 2 = 0) AS n_stamped FROM customer
""")
def stamped_upsert(t):
    """Updated rows get the current time, the others keep theirs."""
    old = t.customer.select("c_custkey", "c_acctbal", F.timestamp_micros(F.lit(0)).alias("updated_at"))
    new = t.customer.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    merged = tables.upsert(old, new.withColumn("updated_at", F.lit(None).cast("timestamp")), ["c_custkey"], stamp="updated_at")
    return merged.agg(F.count("*").alias("n_rows"), F.count_if(F.unix_micros("updated_at") > 0).alias("n_stamped"))
