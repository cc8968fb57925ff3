"""Joins, set operations, duplicates and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.catalog.scans import FOLD_SQL, part_folds
from tabularium.fixtures import cte, view
from tabularium.operators import dedup, knn, monitor, relate, splits
from tabularium.operators.selection import resample
from tabularium.session import cut_lineage

# fixed rule for the similarity signature: bit i says whether the text holds the i-th letter pair
PAIRS = [a + b for a in "etaoinsh" for b in "etaoinsh"]
BITS_SQL = " + ".join(
    f"CASE WHEN contains(text, '{p}') THEN {1 << i if i < 63 else '(-9223372036854775807 - 1)'} ELSE 0 END" for i, p in enumerate(PAIRS)
)


def signature(docs):
    total = None
    for i, p in enumerate(PAIRS):
        bit = F.when(F.col("text").contains(p), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("bigint")
        total = bit if total is None else total.bitwiseOR(bit)
    return docs.select("doc_id", "lang", total.alias("bits"))


def text_hashes(t):
    """Whole texts are read and hashed once; what follows works on the short rows."""
    return cut_lineage(t.documents.select("doc_id", "lang", F.md5("text").alias("text_hash")))


@query("one_to_one_labels", "J1 U4", """
SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
""")
def one_to_one_labels(t):
    return relate.one_to_one(t.documents.select("doc_id", "lang"), t.labels, "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("label_conflicts", "J2", """
SELECT doc_id, CAST(quality AS INTEGER) AS label, CAST(toxic AS INTEGER) AS other_label FROM labels WHERE quality IS DISTINCT FROM toxic
""")
def label_conflicts(t):
    a = t.labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    b = t.labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    return relate.label_conflicts(a, b, "doc_id", "label")


@query("key_reconciliation", "J3 U3", """
SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
""")
def key_reconciliation(t):
    return relate.reconcile(t.documents, t.labels, "doc_id")


@query("shared_sources_per_fold", "J4 U2", FOLD_SQL + """
, sources AS (SELECT repeat_id, fold_id, p_partkey // 3 AS source, min(subset) <> max(subset) AS leaks FROM fold_rows GROUP BY ALL)
SELECT repeat_id, fold_id, count(*) FILTER (WHERE leaks) AS n_shared FROM sources GROUP BY ALL
""")
def shared_sources_per_fold(t):
    """Parts grouped into families of three leak between subsets; the guard counts them per fold."""
    rows = part_folds(t).withColumn("source", F.expr("p_partkey div 3"))
    return relate.shared_sources(rows, ["repeat_id", "fold_id"], "source", "subset")


@query("leak_free_folds", "J4 P17", FOLD_SQL + """
, sources AS (SELECT repeat_id, fold_id, p_partkey, min(subset) <> max(subset) AS leaks FROM fold_rows GROUP BY ALL)
SELECT repeat_id, fold_id, count(*) FILTER (WHERE leaks) AS n_shared FROM sources GROUP BY ALL
""")
def leak_free_folds(t):
    unit = ["repeat_id", "fold_id"]
    return relate.shared_sources(relate.require_no_overlap(part_folds(t), unit, "p_partkey", "subset"), unit, "p_partkey", "subset")


@query("key_intersection", "U2", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def key_intersection(t):
    return t.documents.where("lang = 'en'").select("doc_id").intersect(t.labels.select("doc_id"))


@query("key_difference", "U3", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def key_difference(t):
    return t.documents.select("doc_id").join(t.labels.where("quality = 1"), "doc_id", "left_anti").distinct()


@query("columns_by_key", "U4", """
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, round(CAST(embedding[2] AS DOUBLE), 6) AS second_value, label FROM embeddings
""")
def columns_by_key(t):
    x = F.col("embedding")
    left = t.embeddings.select("vec_id", F.round(x[0].cast("double"), 6).alias("first_value"))
    right = t.embeddings.select("vec_id", F.round(x[1].cast("double"), 6).alias("second_value"), "label")
    return relate.attach_by_key(left, right, "vec_id")


@query("exact_duplicates", "W1", """
SELECT doc_id, lang, doc_id <> first_value(doc_id) OVER w AS is_duplicate,
       CASE WHEN doc_id <> first_value(doc_id) OVER w THEN first_value(doc_id) OVER w END AS duplicate_of
FROM documents WINDOW w AS (PARTITION BY md5(text) ORDER BY lang, doc_id)
""")
def exact_duplicates(t):
    return dedup.mark_exact(text_hashes(t), "doc_id", "text_hash", ["lang"]).drop("text_hash")


@query("duplicates_per_class", "A3", """
SELECT lang, count(*) FILTER (WHERE dup) AS n_duplicates, count(*) AS n_before, count(*) FILTER (WHERE NOT dup) AS n_after
FROM (SELECT lang, row_number() OVER (PARTITION BY md5(text) ORDER BY lang, doc_id) > 1 AS dup FROM documents) GROUP BY lang
""")
def duplicates_per_class(t):
    marked = dedup.mark_exact(text_hashes(t), "doc_id", "text_hash", ["lang"])
    return marked.groupBy("lang").agg(
        F.count_if("is_duplicate").alias("n_duplicates"), F.count("*").alias("n_before"), F.count_if(~F.col("is_duplicate")).alias("n_after")
    ).orderBy(F.desc("n_duplicates"), "lang")


@query("two_pass_dedup", "B6", """
WITH once AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY lang, doc_id) = 1),
twice AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS plain FROM once)
SELECT doc_id, lang, md5(plain) AS plain_hash FROM twice QUALIFY row_number() OVER (PARTITION BY md5(plain) ORDER BY lang, doc_id) = 1
""")
def two_pass_dedup(t):
    """Hash, keep firsts, normalise the text, hash again, keep firsts."""

    def normalise(df):
        return df.withColumn("plain", F.regexp_replace(F.lower("text"), "[^a-z]+", " ")).drop("text")

    rows = t.documents.select("doc_id", "lang", "text")
    kept = dedup.two_pass(rows, "doc_id", ["lang"], F.md5("text"), normalise, F.md5("plain"))
    return kept.select("doc_id", "lang", F.md5("plain").alias("plain_hash"))


HEADS_SQL = f"WITH RECURSIVE s AS (SELECT doc_id, lang, CAST({BITS_SQL} AS BIGINT) AS bits FROM documents)"


@query("near_duplicate_pairs", "J12", HEADS_SQL + """
, h AS (SELECT DISTINCT bits FROM s)
SELECT a.bits AS a, b.bits AS b, CAST(bit_count(xor(a.bits, b.bits)) AS INT) AS distance
FROM h a JOIN h b ON a.bits < b.bits AND bit_count(xor(a.bits, b.bits)) <= 3
""")
def near_duplicate_pairs(t):
    return dedup.near_pairs(signature(t.documents).select("bits").distinct(), "bits", "bits", 3)


@query("near_duplicates", "J12", HEADS_SQL + """
, heads AS (SELECT bits, min(doc_id) AS own, row_number() OVER (ORDER BY min(doc_id)) AS rn FROM s GROUP BY bits),
walk(n, kept, bits, rep) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT n + 1,
         CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, h.bits)) <= 3)) = 0 THEN list_append(kept, h.bits) ELSE kept END,
         h.bits, coalesce(list_filter(kept, lambda k: bit_count(xor(k, h.bits)) <= 3)[1], h.bits)
  FROM walk JOIN heads h ON h.rn = n + 1
)
SELECT s.doc_id, s.lang, s.doc_id <> r.own AS is_duplicate, CASE WHEN s.doc_id <> r.own THEN r.own END AS duplicate_of
FROM s JOIN walk w ON s.bits = w.bits JOIN heads r ON r.bits = w.rep
""")
def near_duplicates(t):
    """Greedy marking within three bits: duplicates point to the first earlier retained document."""
    return dedup.mark_near(cut_lineage(signature(t.documents)), "doc_id", "bits", [], 3).drop("bits")


@query("stage_progress", "J5 A22", cte("customer_task", "customer_stage") + """
SELECT s.stage_no, s.model_type, s.stage_name, s.trials, count(t.task_id) AS total_tasks,
  count(*) FILTER (WHERE status = 'WAITING') AS waiting_tasks, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled_tasks,
  count(*) FILTER (WHERE tell_status = 'PENDING') AS pending_tell_tasks,
  greatest(s.trials - count(*) FILTER (WHERE status IN ('WAITING','RUNNING','DONE_WAITING_TELL','TOLD','FAILED','CANCELLED')), 0) AS remaining_trials,
  max(updated_at) AS last_task_update
FROM customer_stage s LEFT JOIN customer_task t ON s.stage_no = t.stage_no AND s.model_type = t.model_type
GROUP BY s.stage_no, s.model_type, s.stage_name, s.trials
""")
def stage_progress(t):
    return monitor.stage_progress(view(t, "customer_stage"), view(t, "customer_task")).select(
        "stage_no", "model_type", "stage_name", "trials", "total_tasks", "waiting_tasks", "cancelled_tasks", "pending_tell_tasks",
        F.col("remaining_trials").cast("bigint").alias("remaining_trials"), "last_task_update",
    )


STAGE10 = "stage AS (SELECT DISTINCT stage_no, model_type, concat('stage ', CAST(stage_no AS VARCHAR)) AS stage_name FROM task)"


def ten_stages(t):
    return view(t, "task").select("stage_no", "model_type").distinct().withColumn("stage_name", F.concat(F.lit("stage "), F.col("stage_no").cast("string")))


NOW = "1998-12-31 00:00:00"


@query("task_monitor", "J6 J10 W10", cte("task", "worker") + f""", {STAGE10},
slot AS (SELECT l_orderkey % 1000 AS slot_id, max(l_linenumber) AS current_epoch FROM lineitem GROUP BY 1)
SELECT task_id, stage_no, model_type, stage_name, status, worker_id, worker_name, slot_id, current_epoch,
       date_diff('second', last_heartbeat, TIMESTAMP '{NOW}') AS heartbeat_age
FROM task JOIN stage USING (stage_no, model_type) LEFT JOIN worker USING (worker_id) LEFT JOIN slot USING (slot_id)
""")
def task_monitor(t):
    slots = t.lineitem.groupBy((F.col("l_orderkey") % 1000).alias("slot_id")).agg(F.max("l_linenumber").alias("current_epoch"))
    return monitor.task_monitor(view(t, "task"), ten_stages(t), view(t, "worker"), slots, F.lit(NOW).cast("timestamp_ntz")).select(
        "task_id", "stage_no", "model_type", "stage_name", "status", "worker_id", "worker_name", "slot_id", "current_epoch", "heartbeat_age"
    )


@query("task_enrichment", "J10", cte("task") + f", {STAGE10} SELECT task_id, stage_no, model_type, stage_name FROM task JOIN stage USING (stage_no, model_type)")
def task_enrichment(t):
    return monitor.enrich_tasks(view(t, "task").select("task_id", "stage_no", "model_type"), ten_stages(t)).select(
        "task_id", "stage_no", "model_type", "stage_name"
    )


@query("worker_monitor", "J7 W10", cte("task", "worker") + f"""
SELECT worker_id, worker_name, count(task_id) FILTER (WHERE status = 'RUNNING') AS running_tasks,
  count(task_id) FILTER (WHERE status IN ('DONE', 'TOLD')) AS completed_tasks, count(task_id) FILTER (WHERE status = 'FAILED') AS failed_tasks,
  date_diff('second', max(last_heartbeat), TIMESTAMP '{NOW}') AS last_seen_age
FROM worker LEFT JOIN task USING (worker_id) GROUP BY worker_id, worker_name
""")
def worker_monitor(t):
    return monitor.worker_monitor(view(t, "worker"), view(t, "task"), F.lit(NOW).cast("timestamp_ntz")).select(
        "worker_id", "worker_name", "running_tasks", "completed_tasks", "failed_tasks", "last_seen_age"
    )


@query("checkpoint_monitor", "J9 P14", cte("file", "worker") + """
SELECT file_id, slot_id, kind, metric, created_at, concat('gdrive://', remote, '/', ltrim(relative_path, '/')) AS checkpoint_uri, worker_name
FROM file LEFT JOIN worker USING (worker_id)
""")
def checkpoint_monitor(t):
    return monitor.checkpoint_health(view(t, "file"), view(t, "worker")).select(
        "file_id", "slot_id", "kind", "metric", "created_at", "checkpoint_uri", "worker_name"
    )


RESUME_AT = "created_at, file_id"


@query("resume_files", "J11 K5", cte("file") + f"""
, f AS (SELECT *, row_number() OVER (PARTITION BY slot_id, kind IN ('INTERVAL', 'EPOCH', 'RECOVERY') ORDER BY created_at DESC, file_id DESC) AS m,
        row_number() OVER (PARTITION BY slot_id, kind ORDER BY created_at DESC, file_id DESC) AS k FROM file),
slots AS (SELECT slot_id, max(CASE WHEN m = 1 AND kind IN ('INTERVAL', 'EPOCH', 'RECOVERY') THEN file_id END) AS latest,
   max(CASE WHEN k = 1 AND kind = 'BEST' THEN file_id END) AS best, max(CASE WHEN k = 1 AND kind = 'FINAL' THEN file_id END) AS final FROM f GROUP BY 1),
first_final AS (SELECT slot_id, file_id FROM file WHERE kind = 'FINAL' QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY created_at, file_id) = 1),
pick AS (SELECT slots.slot_id, CASE slots.slot_id % 3 WHEN 0 THEN best WHEN 1 THEN final ELSE coalesce(latest, ff.file_id) END AS file_id
         FROM slots LEFT JOIN first_final ff USING (slot_id))
SELECT DISTINCT p.slot_id, p.file_id, f.kind, f.epoch FROM pick p JOIN file f ON p.file_id = f.file_id AND p.slot_id = f.slot_id WHERE p.file_id IS NOT NULL
""")
def resume_files(t):
    from tabularium.operators import tables

    files = view(t, "file")
    prefer = F.when(F.col("slot_id") % 3 == 0, "Best").when(F.col("slot_id") % 3 == 1, "final")
    slots = tables.fold_slots(files)
    found = monitor.resume_files(slots, files.select("file_id", F.col("slot_id").alias("file_slot"), "kind", "epoch"), prefer)
    return found.where("slot_id = file_slot").select("slot_id", "file_id", "kind", "epoch").distinct()


@query("bootstrap_resamples", "J14 W4", """
WITH n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM part GROUP BY p_type)),
r AS (SELECT b, p_type, p_partkey, p_retailprice, row_number() OVER (PARTITION BY b, p_type ORDER BY
       md5(concat_ws('|', '42', CAST(b AS VARCHAR), CAST(p_partkey AS VARCHAR))), p_partkey) AS rn FROM part, range(30) AS x(b))
SELECT CAST(b AS INT) AS bootstrap, p_type, count(*) AS n_rows, CAST(sum(p_partkey) AS BIGINT) AS key_sum, round(avg(p_retailprice), 6) AS mean_price
FROM r, n WHERE rn <= n GROUP BY b, p_type
""")
def bootstrap_resamples(t):
    rows = resample(t.part.select("p_partkey", "p_type", "p_retailprice"), "p_partkey", "p_type", 30)
    return rows.groupBy("bootstrap", "p_type").agg(
        F.count("*").alias("n_rows"), F.sum("p_partkey").alias("key_sum"), F.round(F.avg("p_retailprice"), 6).alias("mean_price")
    )


@query("class_neighbours", "J15", """
SELECT label, a, b, round(d, 6) AS distance, CAST(place AS INT) AS place FROM (
  SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS d,
         row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), y.vec_id) AS place
  FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id) WHERE place <= 5
""")
def class_neighbours(t):
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return knn.neighbours(rows, "vec_id", "label", "x", 5).withColumn("distance", F.round("distance", 6))


@query("seeded_class_sample", "W4", """
SELECT p_partkey, p_type FROM part
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5(concat_ws('|', '42', CAST(p_partkey AS VARCHAR))), p_partkey) <= 25
""")
def seeded_class_sample(t):
    return splits.sample_per_class(t.part.select("p_partkey", "p_type"), "p_partkey", "p_type", 25)
