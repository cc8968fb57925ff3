"""Rule reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.fixtures import cte, view
from tabularium.operators import relate, rules


@query("enumeration_violations", "Q1", cte("task") + """
, r AS (SELECT task_id, CASE WHEN task_id % 17 = 0 THEN 'LOST' WHEN task_id % 19 = 0 THEN NULL ELSE status END AS status, tell_status,
        CASE WHEN task_id % 23 = 0 THEN 'sideways' WHEN task_id % 2 = 0 THEN 'minimize' END AS direction FROM task)
SELECT task_id, 'status' AS rule FROM r WHERE status NOT IN ('WAITING','RUNNING','DONE_WAITING_TELL','TOLD','DONE','FAILED','STALE','HIJACKED','CANCELLED') OR status IS NULL
UNION ALL SELECT task_id, 'tell_status' FROM r WHERE tell_status NOT IN ('NOT_REQUIRED', 'PENDING', 'TOLD', 'FAILED') OR tell_status IS NULL
UNION ALL SELECT task_id, 'direction' FROM r WHERE direction NOT IN ('minimize', 'maximize')
""")
def enumeration_violations(t):
    k = F.col("task_id")
    rows = view(t, "task").select(
        "task_id", "tell_status", F.when(k % 17 == 0, "LOST").when(k % 19 == 0, F.lit(None)).otherwise(F.col("status")).alias("status"),
        F.when(k % 23 == 0, "sideways").when(k % 2 == 0, "minimize").alias("direction"),
    )
    return relate.violations(rows, "task_id", rules.enumerations("task", ("status", "tell_status", "direction")))


@query("range_violations", "Q2", """
SELECT l_orderkey, 'discount_ratio' AS rule FROM lineitem WHERE l_discount / 0.09 > 1 OR l_discount < 0
UNION ALL SELECT l_orderkey, 'size' FROM lineitem WHERE l_quantity - 3 < 0 UNION ALL SELECT l_orderkey, 'epoch' FROM lineitem WHERE l_linenumber - 1 <= 0
""")
def range_violations(t):
    checks = {
        "discount_ratio": (F.col("l_discount") / 0.09 <= 1) & (F.col("l_discount") >= 0),
        "size": F.col("l_quantity") - 3 >= 0, "epoch": F.col("l_linenumber") - 1 > 0,
    }
    return relate.violations(t.lineitem, "l_orderkey", checks)


@query("orphan_rows", "Q3", cte("task") + """
SELECT 'task_worker' AS reference, task_id AS id FROM task WHERE worker_id IS NOT NULL AND worker_id NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'order_line', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)
""")
def orphan_rows(t):
    workers = relate.orphans(view(t, "task"), "worker_id", t.supplier, "s_suppkey").select(F.lit("task_worker").alias("reference"), F.col("task_id").alias("id"))
    lines = t.lineitem.select((F.col("l_orderkey") * 2).alias("ref"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    lines = relate.orphans(lines, "ref", t.orders, "o_orderkey").select(F.lit("order_line").alias("reference"), "id")
    return workers.unionByName(lines)


@query("repeated_keys", "Q4", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(t):
    return relate.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("null_counts", "Q4", """
SELECT count(*) FILTER (WHERE quality IS NULL) AS quality_nulls, count(*) FILTER (WHERE lang IS NULL) AS lang_nulls FROM documents LEFT JOIN labels USING (doc_id)
""")
def null_counts(t):
    return relate.null_counts(t.documents.join(t.labels, "doc_id", "left"), ["quality", "lang"])


@query("readiness_report", "Q5 P4", """
SELECT name, CASE WHEN name IN ('event_id', 'ts', 'user_id', 'event_type', 'value', 'props') THEN 'OK' ELSE 'MISSING' END AS state, n_rows
FROM (SELECT unnest(['event_id', 'ts', 'worker_uid', 'value', 'metadata']) AS name), (SELECT count(*) AS n_rows FROM events)
""")
def readiness_report(t):
    """Required columns of the events table, each OK or MISSING, beside the table's row count."""
    rows = t.events.agg(F.count("*").alias("n_rows"))
    return relate.readiness(t.events, ["event_id", "ts", "worker_uid", "value", "metadata"]).join(F.broadcast(rows))


@query("policy_readiness", "Q5", """
WITH p AS (SELECT p_size AS stage_no, p_type AS model_type, count(*) AS k_folds, CASE WHEN count(*) > 1 THEN max(p_retailprice) END AS tuning_limit FROM part GROUP BY ALL),
w AS (SELECT unnest([3, 4, 5, 99]) AS stage_no)
SELECT w.stage_no, p.model_type, p.k_folds, p.tuning_limit,
  CASE WHEN p.stage_no IS NULL THEN 'MISSING' WHEN p.tuning_limit IS NULL THEN 'INCOMPLETE' ELSE 'OK' END AS state
FROM w LEFT JOIN p ON p.stage_no = w.stage_no
""")
def policy_readiness(t):
    """Policies of stages 3, 4, 5 and of one that has none; here sizes are stages and types are models."""
    limit = F.when(F.count("*") > 1, F.max("p_retailprice"))
    policies = t.part.groupBy(F.col("p_size").alias("stage_no"), F.col("p_type").alias("model_type")).agg(F.count("*").alias("k_folds"), limit.alias("tuning_limit"))
    return relate.policy_listing(policies, "stage_no", [3, 4, 5, 99], ["k_folds", "tuning_limit"])


@query("count_gates", "Q6", """
SELECT (SELECT count(*) FROM documents) AS n_manifest, (SELECT count(*) FROM labels) AS n_features, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS equal
""")
def count_gates(t):
    both = t.documents.select(F.lit(1).alias("m"), F.lit(0).alias("f")).unionByName(t.labels.select(F.lit(0).alias("m"), F.lit(1).alias("f")))
    return both.agg(F.sum("m").alias("n_manifest"), F.sum("f").alias("n_features")).withColumn("equal", F.col("n_manifest") == F.col("n_features"))
