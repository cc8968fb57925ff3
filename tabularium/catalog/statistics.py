"""Class statistics, outlier flags, correlation, feature scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.operators import knn, selection, stats

FEATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def union_features(template: str, feats=FEATS, glue: str = " UNION ALL ") -> str:
    return glue.join(template.replace("{f}", f) for f in feats)


@query("class_distribution", "A1", """
SELECT l_returnflag, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS fraction FROM lineitem GROUP BY 1
""")
def class_distribution(t):
    return stats.class_distribution(t.lineitem, "l_returnflag").withColumn("fraction", F.round("fraction", 9))


@query("class_balance", "A2", """
SELECT count(DISTINCT n) = 1 AS balanced, count(*) AS n_classes FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
""")
def class_balance(t):
    return stats.is_balanced(t.part, "p_type")


@query("class_statistics", "A4", union_features("""
SELECT l_returnflag, '{f}' AS feature, round(avg({f}), 5) AS mean, round(stddev_samp({f}), 5) AS std,
       round(quantile_cont({f}, 0.5), 6) AS median, min({f}) AS min, max({f}) AS max FROM lineitem GROUP BY 1
"""))
def class_statistics(t):
    rows = stats.class_statistics(t.lineitem, "l_returnflag", FEATS)
    return rows.withColumns({"mean": F.round("mean", 5), "std": F.round("std", 5), "median": F.round("median", 6)})


@query("class_feature_matrix", "A5", "WITH m AS (SELECT l_returnflag, " + union_features("avg({f}) AS {f}", glue=", ") + """
 FROM lineitem GROUP BY 1) SELECT l_returnflag, """ + union_features(
    "round(coalesce(({f} - min({f}) OVER ()) / nullif(max({f}) OVER () - min({f}) OVER (), 0), 0), 5) AS {f}", glue=", ") + " FROM m")
def class_feature_matrix(t):
    rows = stats.class_feature_matrix(t.lineitem, "l_returnflag", FEATS)
    return rows.select("l_returnflag", *[F.round(f, 5).alias(f) for f in FEATS])


def iqr_sql(table: str, cls: str, feats) -> str:
    return union_features(f"""
SELECT d.{cls}, '{{f}}' AS feature, count(*) AS n_rows, count(*) FILTER (WHERE {{f}} < lo OR {{f}} > hi) AS n_outliers,
       round(any_value(lo), 5) AS lower, round(any_value(hi), 5) AS upper, round(count(*) FILTER (WHERE {{f}} < lo OR {{f}} > hi) / count(*), 9) AS ratio
FROM {table} d JOIN (SELECT {cls}, quantile_cont({{f}}, 0.25) - 1.5 * (quantile_cont({{f}}, 0.75) - quantile_cont({{f}}, 0.25)) AS lo,
     quantile_cont({{f}}, 0.75) + 1.5 * (quantile_cont({{f}}, 0.75) - quantile_cont({{f}}, 0.25)) AS hi FROM {table} GROUP BY 1) b USING ({cls})
GROUP BY d.{cls}
""", feats)


def rounded_summary(rows):
    return rows.withColumns({"lower": F.round("lower", 5), "upper": F.round("upper", 5), "ratio": F.round("ratio", 9)})


@query("univariate_outlier_summary", "A6", iqr_sql("events", "event_type", ["value"]))
def univariate_outlier_summary(t):
    return rounded_summary(stats.outlier_summary(t.events, "event_type", ["value"]))


@query("feature_outlier_summary", "A6", iqr_sql("lineitem", "l_returnflag", FEATS))
def feature_outlier_summary(t):
    return rounded_summary(stats.outlier_summary(t.lineitem, "l_returnflag", FEATS))


@query("outlier_flags", "A6 A7", """
WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
                  quantile_cont(event_id, 0.25) AS e1, quantile_cont(event_id, 0.75) AS e3 FROM events GROUP BY 1)
SELECT event_id, event_type, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS value_outlier,
       CAST(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS INT)
         + CAST(event_id < e1 - 1.5 * (e3 - e1) OR event_id > e3 + 1.5 * (e3 - e1) AS INT) AS outlier_count
FROM events JOIN b USING (event_type)
""")
def outlier_flags(t):
    rows = t.events.select("event_id", "event_type", "value")
    return stats.outlier_flags(rows, "event_type", ["value", "event_id"]).select("event_id", "event_type", "value_outlier", "outlier_count")


@query("mean_outlier_count", "A7", """
WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(avg(CAST(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS INT)), 9) AS mean_outliers
FROM events JOIN b USING (event_type) GROUP BY 1
""")
def mean_outlier_count(t):
    flags = stats.outlier_flags(t.events, "event_type", ["value"])
    return flags.groupBy("event_type").agg(F.round(F.avg("outlier_count"), 9).alias("mean_outliers"))


CORRELATION_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a in FEATS for b in FEATS
)


@query("feature_correlations", "A8", CORRELATION_SQL)
def feature_correlations(t):
    return stats.correlations(t.lineitem, FEATS).withColumn("r", F.round("r", 8))


@query("condition_number", "A9", """
SELECT round(sqrt((1 + abs(r)) / greatest(1 - abs(r), 1e-12)), 6) AS condition_number FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
""")
def condition_number(t):
    value = stats.condition_number(t.lineitem, ["l_quantity", "l_extendedprice"])
    return t.spark.createDataFrame([(round(value, 6),)], "condition_number DOUBLE")


@query("two_feature_vif", "A10", """
WITH g AS (SELECT sum(l_quantity * l_quantity) AS xx, sum(l_tax * l_tax) AS yy, sum(l_quantity * l_tax) AS xy FROM lineitem)
SELECT feature, round(1 / (1 - xy * xy / (xx * yy)), 6) AS vif FROM g, (SELECT unnest(['l_quantity', 'l_tax']) AS feature)
""")
def two_feature_vif(t):
    return stats.vif(t.lineitem, ["l_quantity", "l_tax"]).withColumn("vif", F.round("vif", 6))


@query("feature_vif", "A10")
def feature_vif(t):
    return stats.vif(t.lineitem, FEATS)


@query("vif_pruning", "A11")
def vif_pruning(t):
    rows = t.lineitem.select(*FEATS, (F.col("l_quantity") + F.col("l_tax")).alias("mixed"), (2 * F.col("l_discount")).alias("doubled"))
    return stats.prune_by_vif(rows, rows.columns)


@query("three_feature_pruning", "A11", """
WITH g AS (SELECT sum(x * x) AS xx, sum(y * y) AS yy, sum(z * z) AS zz, sum(x * y) AS xy, sum(x * z) AS xz, sum(y * z) AS yz
           FROM (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_tax AS DOUBLE) AS z FROM lineitem)),
v AS (SELECT 'l_quantity' AS feature, 1 / (1 - (xy * xy * zz - 2 * xy * xz * yz + xz * xz * yy) / (yy * zz - yz * yz) / xx) AS vif FROM g
 UNION ALL SELECT 'l_extendedprice', 1 / (1 - (xy * xy * zz - 2 * xy * yz * xz + yz * yz * xx) / (xx * zz - xz * xz) / yy) FROM g
 UNION ALL SELECT 'l_tax', 1 / (1 - (xz * xz * yy - 2 * xz * yz * xy + yz * yz * xx) / (xx * yy - xy * xy) / zz) FROM g),
worst AS (SELECT * FROM v ORDER BY vif DESC LIMIT 1),
pair AS (SELECT v.feature, CASE (SELECT feature FROM worst) WHEN 'l_quantity' THEN 1 / (1 - yz * yz / (yy * zz)) WHEN 'l_extendedprice' THEN 1 / (1 - xz * xz / (xx * zz)) ELSE 1 / (1 - xy * xy / (xx * yy)) END AS vif
         FROM v, g WHERE v.feature <> (SELECT feature FROM worst))
SELECT feature, 1 AS removed_at, round(vif, 6) AS vif, false AS kept FROM worst UNION ALL SELECT feature, NULL, round(vif, 6), true FROM pair
""")
def three_feature_pruning(t):
    """Of three features the worst goes, and two stay, whatever their factor; SQL says the normal equations of two regressors."""
    rows = t.lineitem.select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_tax")])
    return stats.prune_by_vif(rows, rows.columns, threshold=1.0, min_features=2).withColumn("vif", F.round("vif", 6))


ANOVA_SQL = union_features("""
SELECT '{f}' AS feature, round((sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f_value FROM (
  SELECT *, sum(n * m) OVER () / sum(n) OVER () AS g FROM (
    SELECT l_returnflag, count(*) AS n, avg({f}) AS m, var_pop({f}) AS v FROM lineitem GROUP BY 1))
""")


@query("anova_scores", "A12", ANOVA_SQL)
def anova_scores(t):
    long = stats.unpivot(t.lineitem, ["l_returnflag"], FEATS)
    return stats.anova(long, ["feature"], "l_returnflag").select("feature", F.round("f_value", 6).alias("f_value"))


@query("anova_p_values", "A12")
def anova_p_values(t):
    long = stats.unpivot(t.lineitem, ["l_returnflag"], FEATS)
    return stats.with_p_value(stats.anova(long, ["feature"], "l_returnflag")).orderBy(F.desc("f_value"), "feature")


@query("binned_information", "A13", union_features("""
SELECT '{f}' AS feature, round(greatest(sum(c / n * ln(c * n / (a * b))), 0), 8) AS information FROM (
  SELECT c, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY l_returnflag) AS a, sum(c) OVER (PARTITION BY bin) AS b FROM (
    SELECT l_returnflag, bin, count(*)::DOUBLE AS c FROM (
      SELECT l_returnflag, ((rank() OVER (ORDER BY {f}) - 1) * 10) // count(*) OVER () AS bin FROM lineitem) GROUP BY ALL))
"""))
def binned_information(t):
    return stats.binned_information(t.lineitem, "l_returnflag", FEATS).withColumn("information", F.round("information", 8))


DIMS = [f"x{i}" for i in range(64)]


def wide(t):
    """Every dimension as a DOUBLE column."""
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(DIMS)])


LONG_SQL = "(SELECT vec_id, label, concat('x', i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS dims(i))"


def digamma_sql(n: str) -> str:
    x = f"CAST({n} AS DOUBLE)"
    exact = f"(list_sum(list_transform(range(1, 17), lambda j: CASE WHEN j < {n} THEN 1.0::DOUBLE / j ELSE 0 END)) - 0.5772156649015329::DOUBLE)"
    series = (f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * pow({x}, 2)) + 1 / (120 * pow({x}, 4)) - 1 / (252 * pow({x}, 6)) + 1 / (240 * pow({x}, 8)))")
    return f"CASE WHEN {n} < 16 THEN {exact} ELSE {series} END"


@query("neighbour_information", "A13", f"""
WITH v AS {LONG_SQL}, nc AS (SELECT feature, label, count(*) AS nc FROM v GROUP BY ALL),
d AS (SELECT a.feature, a.label, a.vec_id, a.x, abs(a.x - b.x) AS d,
      row_number() OVER (PARTITION BY a.feature, a.vec_id ORDER BY abs(a.x - b.x)) AS place FROM v a JOIN v b
      ON a.feature = b.feature AND a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT d.*, nc.nc FROM d JOIN nc USING (feature, label) WHERE place = least(3, nc.nc - 1)),
m AS (SELECT r.feature, r.vec_id, any_value(r.nc) AS nc, count(*) FILTER (WHERE CASE WHEN r.d > 0 THEN b.x > r.x - r.d AND b.x < r.x + r.d ELSE b.x = r.x END) AS m
      FROM r JOIN v b ON r.feature = b.feature GROUP BY r.feature, r.vec_id),
n AS (SELECT feature, count(*) AS n FROM m GROUP BY feature)
SELECT m.feature, round(greatest(any_value({digamma_sql('n.n')}) + avg(({digamma_sql('least(3, nc - 1)')}) - ({digamma_sql('nc')}) - ({digamma_sql('greatest(m, 1)')})), 0), 6) AS information
FROM m JOIN n USING (feature) GROUP BY m.feature
""")
def neighbour_information(t):
    long = stats.unpivot(wide(t), ["label"], DIMS)
    return stats.neighbour_information(long, ["feature"], "label").withColumn("information", F.round("information", 6))


@query("balanced_feature_ranking", "A14 W2 W3", f"""
WITH n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)),
pick AS (SELECT b, vec_id FROM (SELECT b, vec_id, row_number() OVER (PARTITION BY b, label ORDER BY
   md5(concat_ws('|', '42', CAST(b AS VARCHAR), CAST(vec_id AS VARCHAR))), vec_id) AS rn FROM embeddings, range(30) AS x(b)), n WHERE rn <= n),
v AS (SELECT b, label, feature, x FROM pick JOIN {LONG_SQL} USING (vec_id)),
f AS (SELECT b, feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM (
   SELECT *, sum(n * m) OVER (PARTITION BY b, feature) / sum(n) OVER (PARTITION BY b, feature) AS g FROM (
     SELECT b, feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS s FROM v GROUP BY ALL)) GROUP BY ALL),
i AS (SELECT b, feature, greatest(sum(c / n * ln(c * n / (p * q))), 0) AS i FROM (
   SELECT b, feature, c, sum(c) OVER (PARTITION BY b, feature) AS n, sum(c) OVER (PARTITION BY b, feature, label) AS p,
          sum(c) OVER (PARTITION BY b, feature, bin) AS q FROM (
     SELECT b, feature, label, bin, count(*)::DOUBLE AS c FROM (
       SELECT b, feature, label, ((rank() OVER (PARTITION BY b, feature ORDER BY x) - 1) * 10) // count(*) OVER (PARTITION BY b, feature) AS bin FROM v)
     GROUP BY ALL)) GROUP BY ALL),
e AS (SELECT f.b, f.feature, round(f, 10) AS f, round(i, 10) AS i FROM f JOIN i ON f.b = i.b AND f.feature = i.feature),
r AS (SELECT f.b, f.feature, f, i, rank() OVER (PARTITION BY f.b ORDER BY f DESC) + (count(*) OVER (PARTITION BY f.b, f) - 1) / 2.0::DOUBLE AS fr,
   rank() OVER (PARTITION BY f.b ORDER BY i DESC) + (count(*) OVER (PARTITION BY f.b, i) - 1) / 2.0::DOUBLE AS ir,
   (f - min(f) OVER (PARTITION BY f.b)) / (max(f) OVER (PARTITION BY f.b) - min(f) OVER (PARTITION BY f.b) + 1e-12) AS fn,
   (i - min(i) OVER (PARTITION BY f.b)) / (max(i) OVER (PARTITION BY f.b) - min(i) OVER (PARTITION BY f.b) + 1e-12) AS inn
   FROM e AS f),
s AS (SELECT feature, avg(f) AS fm, stddev_samp(f) AS fs, avg(i) AS im, stddev_samp(i) AS is_, avg(fr) AS frm, avg(ir) AS irm, avg(fn) AS fnm, avg(inn) AS inm FROM r GROUP BY 1)
SELECT feature, round(fm, 6) AS anova_mean, round(fs, 6) AS anova_std, round(im, 6) AS info_mean, round(is_, 6) AS info_std,
  round(frm, 6) AS anova_rank_mean, round(irm, 6) AS info_rank_mean, round((frm + irm) / 2, 6) AS consensus_rank, round((fnm + inm) / 2, 6) AS consensus_score,
  CASE WHEN frm <= 5 AND irm <= 5 THEN 'robust_linear_and_nonlinear' WHEN frm <= 5 THEN 'mainly_mean_difference'
       WHEN irm <= 5 THEN 'possible_nonlinear_dependency' ELSE 'secondary_feature' END AS interpretation FROM s
""")
def balanced_feature_ranking(t):
    """Thirty balanced resamples scored by F value and by binned information gain."""
    rows = selection.balanced_ranking(wide(t), "vec_id", "label", DIMS, binned=10)
    names = ("anova_mean", "anova_std", "info_mean", "info_std", "anova_rank_mean", "info_rank_mean", "consensus_rank", "consensus_score")
    return rows.select("feature", "interpretation", *[F.round(c, 6).alias(c) for c in names])


@query("neighbour_feature_ranking", "A14")
def neighbour_feature_ranking(t):
    return selection.balanced_ranking(wide(t), "vec_id", "label", DIMS)


@query("average_ranks", "W2 W3", """
SELECT p_partkey, p_type, rank() OVER w + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2.0::DOUBLE AS size_rank,
  round((p_retailprice - min(p_retailprice) OVER v) / (max(p_retailprice) OVER v - min(p_retailprice) OVER v + 1e-12), 6) AS price_norm
FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_size DESC), v AS (PARTITION BY p_type)
""")
def average_ranks(t):
    """Mean ranks of tied values per class, through value counts so that no class is sorted in one task."""
    counts = t.part.groupBy("p_type", "p_size").agg(F.count("*").alias("c"))
    from tabularium.operators.skew import match, small_table, value_ranks

    ranked = value_ranks(counts.withColumn("down", -F.col("p_size")), ["p_type"], "down", "c")
    rank = (F.col("below") + 1 + (F.col("c") - 1) / 2).alias("size_rank")
    span = t.part.groupBy("p_type").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    rows = match(t.part, small_table(span)[0], ["p_type"]).join(ranked.select("p_type", "p_size", rank), ["p_type", "p_size"])
    norm = (F.col("p_retailprice") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12)
    return rows.select("p_partkey", "p_type", "size_rank", F.round(norm, 6).alias("price_norm"))


SCORES_SQL = """
s AS (SELECT p_brand AS feature, avg(p_size) AS a, avg(p_retailprice) AS m FROM part GROUP BY 1),
r AS (SELECT feature, rank() OVER (ORDER BY a DESC) AS anova_rank_mean, rank() OVER (ORDER BY m DESC) AS info_rank_mean FROM s)
"""


def brand_scores(t):
    """One row per brand with two ranks, standing in for per-feature mean ranks."""
    s = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("a"), F.avg("p_retailprice").alias("m"))
    from pyspark.sql import Window as W

    return s.select(
        "feature", F.rank().over(W.partitionBy().orderBy(F.desc("a"))).alias("anova_rank_mean"),
        F.rank().over(W.partitionBy().orderBy(F.desc("m"))).alias("info_rank_mean"),
    ).withColumn("consensus_rank", (F.col("anova_rank_mean") + F.col("info_rank_mean")) / 2)


@query("core_feature_selection", "A15 T2 U2 U3", f"""
WITH {SCORES_SQL},
p AS (SELECT *, (anova_rank_mean + info_rank_mean) / 2.0::DOUBLE AS consensus_rank, row_number() OVER (ORDER BY anova_rank_mean, feature) <= 10 AS a,
      row_number() OVER (ORDER BY info_rank_mean, feature) <= 10 AS m FROM r),
q AS (SELECT *, row_number() OVER (ORDER BY consensus_rank, feature) AS c, count(*) FILTER (WHERE a AND m) OVER () AS n FROM p)
SELECT feature, consensus_rank, CASE WHEN n = 0 AND c <= 1 THEN 'Fallback_Consensus_Core' WHEN m AND NOT a THEN 'Top_IG_Only_Residual'
  WHEN a AND NOT m THEN 'Top_ANOVA_Only_Residual' WHEN a AND m THEN 'Core_Stable_ANOVA_and_IG' ELSE 'Residual_Hybrid_PCA' END AS selection_group,
  (a AND m) OR (n = 0 AND c <= 1) AS is_core, n = 0 AS fallback_used FROM q
""")
def core_feature_selection(t):
    return selection.select_core(brand_scores(t))


@query("top_ranked_features", "T2", f"WITH {SCORES_SQL} SELECT feature, anova_rank_mean FROM r ORDER BY anova_rank_mean, feature LIMIT 10")
def top_ranked_features(t):
    return brand_scores(t).select("feature", F.col("anova_rank_mean").cast("bigint").alias("anova_rank_mean")).orderBy("anova_rank_mean", "feature").limit(10)


@query("dispersion_ratio", "A16", """
WITH v AS (SELECT vec_id, label, unnest(range(1, 65)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings),
c AS (SELECT label, d, count(*) AS n, avg(x) AS m, var_pop(x) AS s FROM v GROUP BY ALL),
g AS (SELECT *, sum(n * m) OVER (PARTITION BY d) / sum(n) OVER (PARTITION BY d) AS g FROM c)
SELECT round((sum(n * (m - g) * (m - g)) / (count(DISTINCT label) - 1)) / (sum(n * s) / (sum(n) / 64 - count(DISTINCT label))), 6) AS score,
       count(DISTINCT label) AS n_classes, CAST(sum(n) / 64 AS BIGINT) AS n_rows FROM g
""")
def dispersion_ratio(t):
    feats = [f"x{i}" for i in range(64)]
    rows = t.embeddings.select("label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)])
    return stats.calinski_harabasz(rows, "label", feats).withColumn("score", F.round("score", 6))


SILHOUETTE_SQL = """
WITH p AS (SELECT a.vec_id, a.label, b.label AS other, sum({d}) AS t, count(*) AS n FROM embeddings a, embeddings b GROUP BY ALL),
q AS (SELECT vec_id, label, max(CASE WHEN label = other AND n > 1 THEN t / (n - 1) END) AS i, min(CASE WHEN label <> other THEN t / n END) AS o FROM p GROUP BY ALL)
SELECT vec_id, label, round(coalesce((o - i) / greatest(i, o), 0), 6) AS silhouette FROM q
"""


@query("silhouette_samples", "A17", SILHOUETTE_SQL.format(d="list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"))
def silhouette_samples(t):
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return knn.silhouette(rows, "vec_id", "label", "x").withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette_squared", "A17", SILHOUETTE_SQL.format(d="pow(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2)"))
def silhouette_squared(t):
    feats = [f"x{i}" for i in range(64)]
    rows = t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)])
    return knn.silhouette_squared(rows, "vec_id", "label", feats).withColumn("silhouette", F.round("silhouette", 6))


@query("mean_silhouette", "A17", SILHOUETTE_SQL.format(d="list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))").replace(
    "SELECT vec_id, label, round(coalesce((o - i) / greatest(i, o), 0), 6) AS silhouette FROM q",
    "SELECT round(avg(coalesce((o - i) / greatest(i, o), 0)), 6) AS silhouette, count(*) AS n_rows FROM q"))
def mean_silhouette(t):
    rows = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return knn.silhouette(rows, "vec_id", "label", "x").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"), F.count("*").alias("n_rows"))


@query("centroid_distances", "A29", "WITH m AS (SELECT l_returnflag AS c, " + union_features("avg({f}) AS {f}", glue=", ") + " FROM lineitem GROUP BY 1), z AS (SELECT c, "
       + union_features("coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0) AS {f}", glue=", ") + """ FROM m)
SELECT a.c AS l_returnflag, b.c AS other, round(sqrt(""" + union_features("pow(a.{f} - b.{f}, 2)", glue=" + ") + "), 5) AS distance FROM z a JOIN z b ON a.c < b.c")
def centroid_distances(t):
    return stats.centroid_proximity(t.lineitem, "l_returnflag", FEATS).withColumn("distance", F.round("distance", 5))
