"""Sources, sinks and manifest handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.functions import scalars as S
from tabularium.operators import dedup, splits
from tabularium.operators.relate import restore_order
from tabularium.sources import files, logs, manifest as M

PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def scratch(spark, name: str) -> str:
    """Shared scratch folder beside the checkpoint folder; a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, f"{name}-{os.urandom(4).hex()}")


SUFFIX_SQL = r"lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\.[^.]+)$', 1))"


@query("item_listing", "S1 F5", f"""
SELECT url AS path, split_part(url, '/', -2) AS class, split_part(url, '/', -1) AS filename, {SUFFIX_SQL} AS suffix
FROM pages WHERE {SUFFIX_SQL} IN ('.com', '.net', '.org', '.html', '')
""")
def item_listing(t):
    return M.list_items(t.pages, "url", (".com", ".net", ".org", ".html", ""))


@query("manifest_roundtrip", "S3 S7", "SELECT doc_id, lang AS class, source, n_chars FROM documents")
def manifest_roundtrip(t):
    """Write a manifest and read it back through the reader that goes by file type."""
    path = scratch(t.spark, "manifest") + ".parquet"
    M.save(t.documents.select("doc_id", F.col("lang").alias("class"), "source", "n_chars"), path)
    return M.read_manifest(t.spark, path)


@query("manifest_csv_roundtrip", "S3 S7", "SELECT CAST(page_id AS VARCHAR) AS page_id, url AS path FROM pages")
def manifest_csv_roundtrip(t):
    path = scratch(t.spark, "manifest") + ".csv"
    M.save(t.pages.select("page_id", F.col("url").alias("path")), path, "csv")
    return M.read_manifest(t.spark, path)


@query("normalized_manifest", "S4 F1 F5", """
SELECT url AS path, CAST(page_id % 7 AS VARCHAR) AS class, split_part(url, '/', -1) AS filename,
       substr(sha1(url), 1, 16) AS source_id, url AS original_path
FROM pages
""")
def normalized_manifest(t):
    return M.normalize(t.pages.select(F.col("url").alias("image_path"), (F.col("page_id") % 7).alias("Label")))


@query("missing_paths", "S5 U3", """
SELECT url AS path FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 > 0)
""")
def missing_paths(t):
    listing = t.pages.where("page_id % 3 > 0").select(F.col("url").alias("path"))
    return M.missing_paths(t.pages.select(F.col("url").alias("path")), listing)


@query("final_manifest", "S5 T1", """
SELECT url AS path, CAST(page_id % 7 AS VARCHAR) AS class, split_part(url, '/', -1) AS filename FROM pages
""")
def final_manifest(t):
    rows = M.normalize(t.pages.select(F.col("url").alias("path"), (F.col("page_id") % 7).alias("class")))
    return M.load_final(rows.select("path", "class", "filename"), t.pages.select(F.col("url").alias("path")))


@query("feature_set_profile", "S6 P1", """
SELECT 'l_quantity' AS feature, count(l_quantity) AS n_values, count(*) AS n_rows FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), count(*) FROM lineitem
UNION ALL SELECT 'l_discount', count(l_discount), count(*) FROM lineitem
UNION ALL SELECT 'l_tax', count(l_tax), count(*) FROM lineitem
""")
def feature_set_profile(t):
    """Numeric columns found by type, metadata columns excluded, with their filled counts."""
    ids = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    feats = M.numeric_columns(M.require_columns(t.lineitem, ("l_returnflag",)), ids)
    row = t.lineitem.agg(F.count("*").alias("n_rows"), *[F.count(f).alias(f) for f in feats])
    return row.unpivot("n_rows", feats, "feature", "n_values")


FOLD_SQL = """
WITH items AS (
  SELECT p_partkey, p_type, md5(concat_ws('|', '42', '0', CAST(p_partkey AS VARCHAR))) AS h FROM part
), starts AS (
  SELECT p_type, coalesce(sum(n) OVER (ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
), ranked AS (
  SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY h, p_partkey) AS rn FROM items
), item_fold AS (
  SELECT p_partkey, p_type, CAST((rn - 1 + s) % 5 AS INT) AS item_fold FROM ranked JOIN starts USING (p_type)
), fold_rows AS (
  SELECT p_partkey, p_type, 0 AS repeat_id, CAST(f AS INT) AS fold_id,
         CASE WHEN f = item_fold THEN 'validation' ELSE 'train' END AS subset
  FROM item_fold, range(5) AS r(f)
)
"""


def part_folds(t):
    return splits.folds(t.part.select("p_partkey", "p_type"), "p_partkey", "p_type", 5)


@query("fold_subset_export", "S8 S9", FOLD_SQL + """
SELECT p_partkey, p_type, subset FROM fold_rows WHERE repeat_id = 0 AND fold_id = 2 AND subset = 'train'
""")
def fold_subset_export(t):
    """One partitioned write of every fold, then a pruned read of one unit."""
    path = scratch(t.spark, "folds")
    M.save(part_folds(t), path, partition_by=("repeat_id", "fold_id", "subset"))
    unit = M.select_unit(t.spark.read.parquet(path), stage_id=3, repeat_id=0, fold_id=2, subset="train")
    return unit.select("p_partkey", "p_type", "subset")


@query("subset_index", "S8 S10 A21", FOLD_SQL + """
, counts AS (SELECT repeat_id, fold_id, subset, p_type, count(*) AS n FROM fold_rows GROUP BY ALL),
j AS (SELECT repeat_id, fold_id, subset, CAST(sum(n) AS BIGINT) AS n, '{' || string_agg('"' || p_type || '":' || n, ',' ORDER BY p_type) || '}' AS js FROM counts GROUP BY ALL)
SELECT t.repeat_id, t.fold_id, t.n AS n_train_natural, v.n AS n_validation_natural, t.js AS train_class_count_json, v.js AS validation_class_count_json,
  concat('subsets/repeat_id=', t.repeat_id, '/fold_id=', t.fold_id, '/subset=train') AS train_path,
  concat('subsets/repeat_id=', t.repeat_id, '/fold_id=', t.fold_id, '/subset=validation') AS validation_path
FROM j t JOIN j v ON t.repeat_id = v.repeat_id AND t.fold_id = v.fold_id AND t.subset = 'train' AND v.subset = 'validation'
""")
def subset_index(t):
    return splits.subset_index(part_folds(t), ["repeat_id", "fold_id"], "p_type")


@query("subset_distribution", "S8 S10", FOLD_SQL + """
SELECT repeat_id, fold_id, subset, p_type, count(*) AS "count",
       round(count(*) / sum(count(*)) OVER (PARTITION BY repeat_id, fold_id, subset), 8) AS percent
FROM fold_rows GROUP BY repeat_id, fold_id, subset, p_type
""")
def subset_distribution(t):
    d = splits.subset_distribution(part_folds(t), ["repeat_id", "fold_id"], "p_type")
    return d.withColumn("percent", F.round("percent", 8))


@query("natural_manifests", "S9", FOLD_SQL + """
SELECT p_partkey, p_type, fold_id, subset FROM fold_rows WHERE (fold_id, subset) IN ((1, 'train'), (1, 'validation'), (4, 'validation'))
""")
def natural_manifests(t):
    """Two subsets of a unit from their own folders, and one, after the export is gone, from the assignment table."""
    exported, bare = scratch(t.spark, "curriculum"), scratch(t.spark, "curriculum")
    rows = part_folds(t).withColumn("stage_id", F.lit(3))
    unit = ("stage_id", "repeat_id", "fold_id", "subset")
    M.save(rows, f"{exported}/subsets", partition_by=unit)
    M.save(rows, f"{bare}/assignments")
    found = [(exported, 1, "train"), (exported, 1, "validation"), (bare, 4, "validation")]
    parts = [M.natural_manifest(t.spark, root, 3, 0, f, s).select("p_partkey", "p_type", F.lit(f).alias("fold_id"), F.lit(s).alias("subset")) for root, f, s in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("final_manifest_fallback", "S5", "SELECT url AS path, CAST(page_id % 7 AS VARCHAR) AS class, split_part(url, '/', -1) AS filename FROM pages")
def final_manifest_fallback(t):
    """A stored manifest is preferred to the folder's listing, and checked against the pages."""
    path = scratch(t.spark, "final")
    rows = M.normalize(t.pages.select(F.col("url").alias("path"), (F.col("page_id") % 7).alias("class")))
    M.save(rows.select("path", "class", "filename"), path)
    return M.load_final_manifest(t.spark, path, f"{path}-none", t.pages.select(F.col("url").alias("path")))


@query("final_features_second_file", "S6", """
SELECT 'l_quantity' AS feature, count(l_quantity) AS n_values FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax) FROM lineitem
""")
def final_features_second_file(t):
    """The first file is missing, so the second one is read."""
    path = scratch(t.spark, "features")
    M.save(t.lineitem.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.col("l_returnflag").alias("class"), "l_quantity", "l_tax"), path)
    features, names = M.load_final_feature_set(t.spark, f"{path}-none", path, t.lineitem)
    return features.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "n_values")


@query("pending_items", "S12 P8", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def pending_items(t):
    return M.pending(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("pruned_results", "S12 P8 U2", """
SELECT DISTINCT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')
""")
def pruned_results(t):
    return M.prune_results(t.labels, t.documents.where("lang = 'en'"), "doc_id")


@query("incremental_extraction", "S12 Q6", "SELECT doc_id, length(text) AS n_text FROM documents")
def incremental_extraction(t):
    """Two runs of an extraction job: the second one only touches what the first one had not seen."""
    path = scratch(t.spark, "features")

    def job(rows):
        return rows.select("doc_id", F.length("text").cast("bigint").alias("n_text"))

    docs = t.documents.select("doc_id", "text")
    M.extract_incrementally(docs.where("doc_id % 3 > 0"), path, "doc_id", job, force=True)
    return M.extract_incrementally(docs, path, "doc_id", job)


@query("error_side_output", "S13 X3", """
SELECT lang, count(*) FILTER (WHERE n_chars >= 100) AS n_ok, count(*) FILTER (WHERE n_chars < 100) AS n_error
FROM documents GROUP BY lang
""")
def error_side_output(t):
    """Rows split by status, and both sides counted per class."""
    status = t.documents.select("lang", F.when(F.col("n_chars") < 100, "error").otherwise("ok").alias("status"))
    ok, bad = M.split_errors(status)
    return ok.unionByName(bad).groupBy("lang").agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "error").alias("n_error")
    )


@query("epoch_metric_append", "S14 ST6 X6", """
SELECT CAST(user_id AS BIGINT) AS task_id, count(*) AS n_rows, round(min(value), 6) AS best_loss FROM events GROUP BY user_id
""")
def epoch_metric_append(t):
    """Events appended to the typed epoch log twice over, read back and summarised."""
    folder = scratch(t.spark, "logs")
    rows = t.events.select(F.col("user_id").alias("task_id"), F.col("value").alias("val_loss"), F.col("event_id").cast("int").alias("epoch"))
    logs.append(rows.where("epoch % 2 = 0"), "epoch_metric", folder)
    logs.append(rows.where("epoch % 2 = 1"), "epoch_metric", folder)
    log = t.spark.read.parquet(f"{folder}/epoch_metric")
    return log.groupBy("task_id").agg(F.count("*").alias("n_rows"), F.round(F.min("val_loss"), 6).alias("best_loss"))


@query("class_encoding", "S15", """
SELECT p_partkey, p_type, CAST(list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) - 1 AS BIGINT) AS class_index
FROM part
""")
def class_encoding(t):
    encoded = M.encode_class(t.part.select("p_partkey", "p_type"), "p_type", PART_TYPES)
    return M.require_known(encoded, "class_index", "p_type")


@query("first_text_per_hash", "P7", """
SELECT doc_id, lang, md5(text) AS text_hash FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1
""")
def first_text_per_hash(t):
    rows = t.documents.select("doc_id", "lang", F.md5("text").alias("text_hash"))
    return dedup.first_per_key(rows, "text_hash", ["doc_id"])


@query("restored_order", "P9", """
SELECT l.doc_id, l.quality, d.n_chars AS position FROM labels l JOIN documents d USING (doc_id)
""")
def restored_order(t):
    order = t.documents.select("doc_id", F.col("n_chars").alias("position"))
    return restore_order(t.labels.select("doc_id", "quality"), order, "doc_id", "position")


@query("row_concatenation", "U1", """
SELECT doc_id, lang, CAST(NULL AS INTEGER) AS quality FROM documents
UNION ALL SELECT doc_id, NULL, CAST(quality AS INTEGER) FROM labels
""")
def row_concatenation(t):
    return t.documents.select("doc_id", "lang").unionByName(
        t.labels.select("doc_id", F.col("quality").cast("int").alias("quality")), allowMissingColumns=True
    )


@query("content_hashes", "F3", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hashes(t):
    return t.documents.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"), F.md5("text").alias("md5"))


@query("verified_contents", "F4", """
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || '!' WHEN doc_id % 11 = 0 THEN 'x' || substr(text, 2) ELSE text END AS text FROM documents WHERE doc_id % 7 > 0)
SELECT d.doc_id, coalesce(octet_length(encode(d.text)) = octet_length(encode(s.text)), false) AS size_ok, coalesce(sha256(d.text) = sha256(s.text), false) AS hash_ok
FROM documents d LEFT JOIN s USING (doc_id)
""")
def verified_contents(t):
    """Registered sizes and hashes against contents of which some are missing, longer or changed."""
    body = lambda text: F.encode(text, "UTF-8")
    registry = files.fingerprint(t.documents.select("doc_id", body(F.col("text")).alias("content")), "doc_id")
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).when(
        F.col("doc_id") % 11 == 0, F.concat(F.lit("x"), F.expr("substring(text, 2)"))
    ).otherwise(F.col("text"))
    stored = files.fingerprint(t.documents.where("doc_id % 7 > 0").select("doc_id", body(changed).alias("content")), "doc_id")
    return files.verify(registry, stored, "doc_id")
