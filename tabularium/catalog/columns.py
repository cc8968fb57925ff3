"""Projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.fixtures import cte, view
from tabularium.functions import scalars as S
from tabularium.operators import monitor, outliers, selection, splits, stats

FEATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
HOLES = "CASE WHEN l_linenumber = {0} THEN NULL ELSE {1} END"


@query("median_imputed_means", "P2", """
WITH h AS (SELECT l_returnflag, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS q,
                  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS p FROM lineitem),
m AS (SELECT quantile_cont(q, 0.5) AS mq, quantile_cont(p, 0.5) AS mp FROM h)
SELECT l_returnflag, round(avg(coalesce(q, mq)), 6) AS mean_quantity, round(avg(coalesce(p, mp)), 4) AS mean_price, count(*) AS n_rows
FROM h, m GROUP BY l_returnflag
""")
def median_imputed_means(t):
    """Missing and infinite values become the exact median of the rest."""
    infinite = F.lit(float("inf"))
    h = t.lineitem.select(
        "l_returnflag", F.when(F.col("l_linenumber") == 3, infinite).otherwise(F.col("l_quantity")).alias("q"),
        F.when(F.col("l_linenumber") == 5, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("p"),
    )
    return stats.impute_median(h, ["q", "p"]).groupBy("l_returnflag").agg(
        F.round(F.avg("q"), 6).alias("mean_quantity"), F.round(F.avg("p"), 4).alias("mean_price"), F.count("*").alias("n_rows")
    )


@query("varying_features", "P3", """
SELECT feature FROM (
  SELECT 'l_quantity' AS feature, stddev_samp(l_quantity) AS s FROM lineitem
  UNION ALL SELECT 'l_extendedprice', stddev_samp(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'constant', stddev_samp(7.0) FROM lineitem
  UNION ALL SELECT 'l_tax', stddev_samp(l_tax) FROM lineitem) WHERE s > 0
""")
def varying_features(t):
    rows = t.lineitem.select("l_quantity", "l_extendedprice", F.lit(7.0).alias("constant"), "l_tax")
    kept = stats.varying(rows, rows.columns)
    return t.spark.createDataFrame([(k,) for k in kept], "feature STRING")


@query("orders_by_optional_filter", "P5", """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
""")
def orders_by_optional_filter(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return monitor.optional_filter(rows, ["o_orderkey"], o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None).drop("o_custkey")


@query("stale_candidates", "P6 ST2", cte("task") + """
SELECT task_id, stage_no, worker_id FROM task
WHERE status = 'RUNNING' AND last_heartbeat < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 15 MINUTE
""")
def stale_candidates(t):
    now = F.lit("1998-06-01 00:00:00").cast("timestamp_ntz")
    return monitor.stale_candidates(view(t, "task"), now).select("task_id", "stage_no", "worker_id")


@query("outlier_strength_labels", "P10 M9", """
SELECT vec_id, consensus, CASE WHEN consensus >= 3 THEN 'strong_multivariate_outlier' WHEN consensus = 2 THEN 'moderate_multivariate_outlier'
  WHEN consensus = 1 THEN 'weak_single_method_outlier' ELSE 'normal' END AS outlier_strength
FROM (SELECT vec_id, CAST(embedding[1] > 0.15 AS INT) + CAST(embedding[2] > 0.1 AS INT) + CAST(embedding[3] > 0.1 AS INT)
             + CAST(embedding[4] > 0.1 AS INT) AS consensus FROM embeddings)
""")
def outlier_strength_labels(t):
    cuts = (0.15, 0.1, 0.1, 0.1)
    flags = [(F.col("embedding")[i] > c).alias(f) for i, (f, c) in enumerate(zip(outliers.FLAGS, cuts))]
    return outliers.consensus(t.embeddings.select("vec_id", *flags)).select("vec_id", "consensus", "outlier_strength")


@query("ranking_interpretation", "P11 X1", """
SELECT p_partkey, CASE WHEN p_size <= 5 AND p_partkey % 10 <= 5 THEN 'robust_linear_and_nonlinear'
  WHEN p_size <= 5 THEN 'mainly_mean_difference' WHEN p_partkey % 10 <= 5 THEN 'possible_nonlinear_dependency'
  ELSE 'secondary_feature' END AS interpretation FROM part
""")
def ranking_interpretation(t):
    label = selection.interpret(F.col("p_size"), F.col("p_partkey") % 10)
    return t.part.select("p_partkey", label.alias("interpretation"))


@query("melted_means", "P12", """
SELECT l_returnflag, 'Quantity' AS metric, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'Discount', round(avg(l_discount), 6) FROM lineitem GROUP BY 1
""")
def melted_means(t):
    names = {"l_quantity": "Quantity", "l_discount": "Discount"}
    means = t.lineitem.groupBy("l_returnflag").agg(*[F.round(F.avg(c), 6).alias(c) for c in names])
    long = means.unpivot("l_returnflag", list(names), "metric", "value")
    labels = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return long.withColumn("metric", labels[F.col("metric")])


@query("provenance_columns", "P13", """
SELECT p_partkey, 'development' AS split, 'train' AS subset, 3 AS stage_id, 0 AS fold_id, true AS is_original FROM part
""")
def provenance_columns(t):
    return t.part.select("p_partkey").withColumns({
        "split": F.lit("development"), "subset": F.lit("train"), "stage_id": F.lit(3), "fold_id": F.lit(0), "is_original": F.lit(True),
    })


@query("remote_uris", "P14", "SELECT page_id, 'gdrive://' || 'store' || '/' || ltrim(url, '/') AS uri FROM pages")
def remote_uris(t):
    return t.pages.select("page_id", S.remote_uri(F.lit("store"), F.col("url")).alias("uri"))


@query("error_texts", "P15 F12", """
SELECT doc_id, md5(left(coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END, 'Unknown error'), 5000)) AS message_hash,
       length(left(coalesce(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END, 'Unknown error'), 2000)) AS short_length FROM documents
""")
def error_texts(t):
    message = F.when(F.col("doc_id") % 9 > 0, F.col("text"))
    return t.documents.select(
        "doc_id", F.md5(S.error_text(message)).alias("message_hash"), F.length(S.error_text(message, 2000)).cast("bigint").alias("short_length")
    )


@query("clean_names", "P16", r"""
SELECT page_id, lower(trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_')) AS name,
       coalesce(nullif(regexp_replace(trim(url), '[^\p{L}\p{N}_.-]', '_', 'g'), ''), 'unknown') AS part FROM pages
""")
def clean_names(t):
    return t.pages.select("page_id", S.clean_name(F.col("url")).alias("name"), S.clean_part(F.col("url")).alias("part"))


@query("identifiers", "F1 F2 F6", """
SELECT p_partkey, substr(sha1(p_name), 1, 16) AS stable_id,
  CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 41), lambda i: CAST(('0x' || substr(sha1(p_name), i, 1)) AS BIGINT))),
       lambda a, d: (a * 16 + d) % 10000000) AS BIGINT) AS stable_int,
  printf('S3_R0_F2_%s_%05d_%s', p_type, p_partkey, substr(sha1(p_name), 1, 8)) AS augmentation_id,
  printf('stage_%02d', p_size) AS stage_folder, CASE WHEN p_partkey % 4 = 0 THEN 'non_hpo' ELSE printf('trial_%06d', p_partkey) END AS trial_folder
FROM part
""")
def identifiers(t):
    c = F.col
    return t.part.select(
        "p_partkey", S.stable_id(c("p_name")).alias("stable_id"),
        S.stable_int(c("p_name")).alias("stable_int"),
        S.augmentation_id(F.lit(3), F.lit(0), F.lit(2), c("p_type"), c("p_partkey"), S.stable_id(c("p_name"), 8)).alias("augmentation_id"),
        S.stage_folder(c("p_size")).alias("stage_folder"),
        S.trial_folder(F.when(c("p_partkey") % 4 > 0, c("p_partkey"))).alias("trial_folder"),
    )


@query("path_parts", "F5 X1", r"""
SELECT page_id, split_part(url, '/', -1) AS basename, regexp_replace(url, '/[^/]*$', '') AS parent, split_part(url, '/', -2) AS parent_name,
       lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1)) AS suffix, replace(replace(url, '/', '\'), '\', '/') AS posix FROM pages
""")
def path_parts(t):
    u = F.col("url")
    windows = F.replace(u, F.lit("/"), F.lit("\\"))
    return t.pages.select(
        "page_id", S.basename(windows).alias("basename"), S.parent_path(u).alias("parent"), S.parent_name(u).alias("parent_name"),
        S.suffix(u).alias("suffix"), S.posix(windows).alias("posix"),
    )


@query("checkpoint_file_names", "F7 F13", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN printf('epoch_%04d.pt', o_custkey) WHEN 1 THEN printf('epoch_%04d.pt', o_custkey)
  WHEN 2 THEN 'best.pt' WHEN 3 THEN 'final.pt' ELSE 'recovery.pt' END AS file_name FROM orders
""")
def checkpoint_file_names(t):
    kinds = F.array(*[F.lit(k) for k in (" interval", "Epoch", "best ", "FINAL", "recovery")])
    kind = F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", S.checkpoint_file_name(kind, F.col("o_custkey")).alias("file_name"))


@query("op_lists", "F8", """
SELECT p_partkey, array_to_string(list_filter(string_split(replace(p_name, ' ', '++') || '+', '+'), lambda x: trim(x) <> ''), '+') AS ops,
       len(list_filter(string_split(replace(p_name, ' ', '++') || '+', '+'), lambda x: trim(x) <> '')) AS n_ops FROM part
""")
def op_lists(t):
    ops = S.split_ops(F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("++")), F.lit("+")))
    return t.part.select("p_partkey", F.array_join(ops, "+").alias("ops"), F.size(ops).cast("bigint").alias("n_ops"))


@query("operation_pairs", "F9", """
WITH brands AS (SELECT DISTINCT p_type, p_size FROM part)
SELECT a.p_type AS first_group, b.p_type AS second_group, count(*) AS n_pairs, sum(a.p_size)::BIGINT AS first_sum
FROM brands a JOIN brands b ON a.p_type < b.p_type GROUP BY ALL
""")
def operation_pairs(t):
    """Pairs of operations from different groups; here types are the groups and sizes the operations."""
    ops = t.part.select(F.col("p_type").alias("g"), F.col("p_size").alias("i"), F.col("p_size").alias("op")).distinct()
    return splits.group_pairs(ops).groupBy(F.col("g1").alias("first_group"), F.col("g2").alias("second_group")).agg(
        F.count("*").alias("n_pairs"), F.sum(F.col("op1").cast("bigint")).alias("first_sum")
    )


@query("search_space_rows", "F10", """
SELECT user_id, event_id, 'k' AS parameter, CASE WHEN event_id % 2 = 0 THEN 'int' ELSE 'float' END AS kind,
       CAST(json_extract(props, '$.k') AS DOUBLE) AS low, CAST(json_extract(props, '$.k') AS DOUBLE) + 10 AS high,
       event_id % 3 = 0 AS log_scale, CAST(0 AS BIGINT) AS n_choices FROM events
UNION ALL SELECT user_id, event_id, 'c', 'categorical', NULL, NULL, false, 2 FROM events
""")
def search_space_rows(t):
    """Parameter objects built from the event properties, parsed back into typed, validated rows."""
    from tabularium.functions.search_space import parse

    k = F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit('{"k": {"type": "'), F.when(F.col("event_id") % 2 == 0, "int").otherwise("float"), F.lit('", "low": '), k, F.lit(', "high": '),
        (k.cast("int") + 10).cast("string"), F.when(F.col("event_id") % 3 == 0, ', "log": true').otherwise(""),
        F.lit('}, "c": {"type": "categorical", "choices": ["a", "b"]}}'),
    )
    rows = parse(t.events.select("user_id", "event_id", text.alias("space")), "space")
    return rows.select("user_id", "event_id", "parameter", "kind", "low", "high", "log_scale", F.size("choices").cast("bigint").alias("n_choices"))


@query("json_snapshots", "F11", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_snapshots(t):
    parsed = F.from_json("props", "MAP<STRING, STRING>")
    return t.events.select("event_id", parsed["k"].cast("bigint").alias("k"))


@query("null_handling", "F12 F13", """
SELECT doc_id, coalesce(l.quality, d.doc_id % 2) AS quality, nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE lang END), '') AS lang,
       upper(trim(' ' || lang || ' ')) AS upper_lang
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def null_handling(t):
    lang = F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("lang"))
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select(
        "doc_id", F.coalesce("quality", F.col("doc_id") % 2).alias("quality"),
        F.nullif(F.trim(lang), F.lit("")).alias("lang"), F.upper(F.trim(F.concat(F.lit(" "), "lang", F.lit(" ")))).alias("upper_lang"),
    )


@query("numeric_functions", "F14", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(ceil(l_discount * 10) AS BIGINT) AS up, CAST(floor(l_tax * 100) AS BIGINT) AS down,
       CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS half_even, greatest(l_tax, l_discount) AS hi, least(l_tax, l_discount) AS lo,
       round(sqrt(l_extendedprice), 6) AS root, round(ln(l_extendedprice), 6) AS log_e, round(log2(l_quantity), 6) AS log_2,
       round(power(l_discount, 2), 6) AS square, least(greatest(l_quantity, 10), 40) AS clipped, isfinite(l_tax) AS is_finite
FROM lineitem
""")
def numeric_functions(t):
    c = F.col
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.ceil(c("l_discount") * 10).alias("up"), F.floor(c("l_tax") * 100).alias("down"),
        F.bround(c("l_quantity") / 2, 0).cast("bigint").alias("half_even"), F.greatest("l_tax", "l_discount").alias("hi"),
        F.least("l_tax", "l_discount").alias("lo"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"),
        F.round(F.ln("l_extendedprice"), 6).alias("log_e"), F.round(F.log2("l_quantity"), 6).alias("log_2"),
        F.round(F.power("l_discount", F.lit(2)), 6).alias("square"),
        F.least(F.greatest(c("l_quantity"), F.lit(10.0)), F.lit(40.0)).alias("clipped"), S.finite(c("l_tax")).isNotNull().alias("is_finite"),
    )


MOMENT = "avg(power((value - m) / s, {0}))"


@query("value_moments", "F15", f"""
WITH g AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT event_type, count(*) AS n, round({MOMENT.format(3)}, 6) AS skewness, round({MOMENT.format(4)} - 3, 6) AS kurtosis,
       round(any_value(s) / abs(any_value(m)), 6) AS cv, round(({MOMENT.format(3)} * {MOMENT.format(3)} + 1) / {MOMENT.format(4)}, 6) AS bimodality
FROM events JOIN g USING (event_type) GROUP BY event_type
""")
def value_moments(t):
    m = stats.value_moments(t.events, ["event_type"], "value")
    return m.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("skewness", "kurtosis", "cv", "bimodality")])


@query("price_slopes", "F16", """
SELECT l_returnflag, round(coalesce(regr_slope(l_extendedprice, l_quantity), 0), 6) AS slope FROM lineitem GROUP BY 1
""")
def price_slopes(t):
    return stats.slope(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("slope", F.round("slope", 6))


@query("epoch_seeds", "F18", """
SELECT o_orderkey, 42 + (o_orderkey % 4) * 1000 + (o_orderkey % 5) * 100 + o_custkey AS seed FROM orders
""")
def epoch_seeds(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", S.epoch_seed(F.lit(42), k % 4, k % 5, F.col("o_custkey")).alias("seed"))


@query("messages", "F19", """
SELECT event_id, printf('Worker %s was %s, stale for %d', 'w' || user_id, event_type, event_id % 60) AS detail FROM events
""")
def messages(t):
    uid = F.concat(F.lit("w"), F.col("user_id").cast("string"))
    return t.events.select("event_id", F.format_string("Worker %s was %s, stale for %d", uid, "event_type", F.col("event_id") % 60).alias("detail"))


@query("sampled_documents", "T6", """
SELECT doc_id, lang FROM documents ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id LIMIT 50
""")
def sampled_documents(t):
    """A seeded sample of 50 rows: a top-n by hash, merged partition by partition."""
    return t.documents.select("doc_id", "lang").orderBy(splits.seeded(42, F.col("doc_id")), "doc_id").limit(50)


@query("sorted_manifest", "T1", "SELECT doc_id, lang, source FROM documents")
def sorted_manifest(t):
    return t.documents.select("doc_id", "lang", "source").orderBy("lang", "source", "doc_id")
