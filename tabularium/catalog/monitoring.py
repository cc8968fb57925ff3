"""Signals, candidates and worker health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.fixtures import cte, view
from tabularium.operators import monitor, tables

COUNTS = """
, c AS (SELECT s.stage_no, s.model_type, s.trials, count(t.task_id) AS total_tasks,
  count(*) FILTER (WHERE status = 'WAITING') AS waiting_tasks, count(*) FILTER (WHERE status = 'RUNNING') AS running_tasks,
  count(*) FILTER (WHERE status = 'DONE_WAITING_TELL') AS done_waiting_tell_tasks, count(*) FILTER (WHERE status = 'TOLD') AS told_tasks,
  count(*) FILTER (WHERE status = 'DONE') AS done_tasks, count(*) FILTER (WHERE status = 'FAILED') AS failed_tasks,
  count(*) FILTER (WHERE status = 'STALE') AS stale_tasks, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled_tasks
  FROM customer_stage s LEFT JOIN customer_task t ON s.stage_no = t.stage_no AND s.model_type = t.model_type GROUP BY s.stage_no, s.model_type, s.trials)
"""


@query("dispatcher_status", "A23 A22", cte("customer_task", "customer_stage") + COUNTS + """
, d AS (SELECT *, waiting_tasks + running_tasks + done_waiting_tell_tasks AS active_tasks,
  greatest(trials - (told_tasks + waiting_tasks + running_tasks + done_waiting_tell_tasks + failed_tasks), 0) AS remaining_trials FROM c),
e AS (SELECT *, greatest(least(3 - active_tasks, remaining_trials), 0) AS can_generate FROM d)
SELECT stage_no, model_type, active_tasks, remaining_trials, can_generate, CASE WHEN trials = 0 THEN 'NO_HPO_STAGE'
  WHEN told_tasks >= trials AND active_tasks = 0 THEN 'STAGE_COMPLETE' WHEN done_waiting_tell_tasks > 0 THEN 'HAS_RESULTS_TO_TELL'
  WHEN can_generate > 0 THEN 'GENERATE_TRIAL' ELSE 'WAIT_FOR_WORKERS' END AS signal FROM e
""")
def dispatcher_status(t):
    return monitor.dispatcher_status(view(t, "customer_stage"), view(t, "customer_task"), 3).select(
        "stage_no", "model_type", "active_tasks", "remaining_trials", "can_generate", "signal"
    )


@query("worker_signals", "A24 A22", cte("customer_task", "customer_stage") + COUNTS + """
SELECT stage_no, model_type, total_tasks, CASE WHEN waiting_tasks > 0 THEN 'HAS_WAITING_TASK' WHEN stale_tasks > 0 THEN 'HAS_STALE_TASK'
  WHEN running_tasks > 0 THEN 'WAIT_FOR_RUNNING_TASKS' WHEN done_waiting_tell_tasks > 0 THEN 'WAIT_FOR_OPTUNA_TELL'
  WHEN trials > 0 AND told_tasks >= trials THEN 'STAGE_COMPLETE' WHEN trials > 0 THEN 'WAIT_FOR_DISPATCHER'
  WHEN total_tasks = 0 THEN 'WAIT_FOR_TASK_GENERATION' WHEN failed_tasks = 0 THEN 'STAGE_COMPLETE' WHEN failed_tasks > 0 THEN 'HAS_FAILED_TASK' ELSE 'IDLE' END AS signal
FROM c
""")
def worker_signals(t):
    return monitor.worker_signal(view(t, "customer_stage"), view(t, "customer_task")).select("stage_no", "model_type", "total_tasks", "signal")


@query("tasks_ready_for_tell", "T4", cte("task") + """
SELECT task_id, objective_value, completed_at FROM task WHERE status = 'DONE_WAITING_TELL' AND tell_status = 'PENDING' AND objective_value IS NOT NULL
ORDER BY completed_at NULLS LAST, task_id LIMIT 50
""")
def tasks_ready_for_tell(t):
    return monitor.ready_for_tell(view(t, "task")).select("task_id", "objective_value", "completed_at")


@query("next_task_candidates", "T5", cte("customer_task") + """
, k AS (SELECT *, CASE WHEN task_id % 3 > 0 THEN updated_at END AS stale_marked_at FROM customer_task),
w AS (SELECT stage_no, model_type, min(task_id) AS task_id FROM k WHERE status = 'WAITING' GROUP BY ALL),
s AS (SELECT stage_no, model_type, task_id FROM k WHERE status = 'STALE' QUALIFY row_number() OVER (PARTITION BY stage_no, model_type ORDER BY stale_marked_at NULLS LAST, task_id) = 1)
SELECT stage_no, model_type, task_id, 'claim' AS action FROM w
UNION ALL SELECT stage_no, model_type, task_id, 'take_over' FROM s WHERE (stage_no, model_type) NOT IN (SELECT (stage_no, model_type) FROM w)
""")
def next_task_candidates(t):
    marked = F.when(F.col("task_id") % 3 > 0, F.col("updated_at"))
    return monitor.next_candidates(view(t, "customer_task").withColumn("stale_marked_at", marked))


@query("recent_tasks", "T7", cte("task") + "SELECT task_id, status, updated_at FROM task ORDER BY updated_at DESC, task_id DESC LIMIT 20")
def recent_tasks(t):
    return view(t, "task").select("task_id", "status", "updated_at").orderBy(F.desc("updated_at"), F.desc("task_id")).limit(20)


NOW = "2024-01-30 22:00:00"
LATEST = """
, last AS (SELECT worker_uid, status, ts AS last_seen_at FROM beat QUALIFY row_number() OVER (PARTITION BY worker_uid ORDER BY ts DESC, beat_id DESC) = 1)
"""


def newest(t):
    return tables.fold_heartbeats(view(t, "beat"), ["status"], []).select("worker_uid", "status", "last_seen_at")


@query("worker_health", "J8 W9 W10", cte("beat", "worker") + LATEST + f"""
SELECT worker_uid, status, worker_name, gpu_count, date_diff('second', last_seen_at, TIMESTAMP '{NOW}') AS last_seen_age
FROM last LEFT JOIN (SELECT concat('w', CAST(worker_id AS VARCHAR)) AS worker_uid, worker_name, gpu_count FROM worker) USING (worker_uid)
""")
def worker_health(t):
    nodes = view(t, "worker").select(F.concat(F.lit("w"), F.col("worker_id").cast("string")).alias("worker_uid"), "worker_name", "gpu_count")
    return monitor.worker_health(newest(t), nodes, F.lit(NOW).cast("timestamp_ntz")).select(
        "worker_uid", "status", "worker_name", "gpu_count", F.expr(f"timestampdiff(SECOND, date_trunc('SECOND', last_seen_at), TIMESTAMP_NTZ'{NOW}')").alias("last_seen_age")
    )


@query("stale_workers", "F17 W10 ST3", cte("beat") + LATEST + f"""
, a AS (SELECT *, date_diff('second', last_seen_at, TIMESTAMP '{NOW}') AS age FROM last)
SELECT worker_uid, status, CASE WHEN age > 300 THEN 'OFFLINE' WHEN age > 120 THEN 'STALE' ELSE 'OK' END AS health FROM a WHERE age > 120
""")
def stale_workers(t):
    rows = newest(t).withColumn("last_seen_at", F.date_trunc("SECOND", "last_seen_at"))
    return monitor.stale_workers(rows, F.lit(NOW).cast("timestamp_ntz")).select("worker_uid", "status", "health")


END = "2024-02-01 00:00:00"
SILENCE_SQL = cte("beat") + f"""
, g AS (SELECT *, date_diff('microsecond', ts, coalesce(lead(ts) OVER (PARTITION BY worker_uid ORDER BY ts, beat_id), TIMESTAMP '{END}')) AS silent FROM beat)
SELECT worker_uid, 'STALE' AS event_type, epoch_us(ts) AS last_seen_us, printf('Worker %s was %s, stale for 120 seconds', worker_uid, status) AS detail
FROM g WHERE silent > 120000000 AND status NOT IN ('OFFLINE', 'IDLE')
UNION ALL SELECT worker_uid, 'OFFLINE', epoch_us(ts), printf('Worker %s offline since %s', worker_uid, strftime(ts, '%Y-%m-%d %H:%M:%S'))
FROM g WHERE silent > 300000000 AND status = 'IDLE'
"""


@query("silence_events", "ST3 F17 F19", SILENCE_SQL)
def silence_events(t):
    events = monitor.silence_events(view(t, "beat"), F.lit(END).cast("timestamp_ntz"))
    return events.select("worker_uid", "event_type", F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("last_seen_us"), "detail")


@query("signal_view", "X5 A24", cte("customer_task", "customer_stage") + COUNTS + """
, s AS (SELECT CASE WHEN waiting_tasks > 0 THEN 'HAS_WAITING_TASK' WHEN stale_tasks > 0 THEN 'HAS_STALE_TASK'
  WHEN running_tasks > 0 THEN 'WAIT_FOR_RUNNING_TASKS' WHEN done_waiting_tell_tasks > 0 THEN 'WAIT_FOR_OPTUNA_TELL'
  WHEN trials > 0 AND told_tasks >= trials THEN 'STAGE_COMPLETE' WHEN trials > 0 THEN 'WAIT_FOR_DISPATCHER'
  WHEN total_tasks = 0 THEN 'WAIT_FOR_TASK_GENERATION' WHEN failed_tasks = 0 THEN 'STAGE_COMPLETE' WHEN failed_tasks > 0 THEN 'HAS_FAILED_TASK' ELSE 'IDLE' END AS signal FROM c)
SELECT signal, count(*) AS n_stages FROM s GROUP BY 1
""")
def signal_view(t):
    """The monitor functions registered as views and queried with SQL."""
    monitor.register_views(t.spark, view(t, "customer_stage"), view(t, "customer_task"))
    return t.spark.sql("SELECT signal, count(*) AS n_stages FROM worker_stage_signal GROUP BY signal")
