"""Scaling, projections and multivariate outlier scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.catalog.statistics import DIMS, FEATS, union_features, wide
from tabularium.operators import matrix, outliers
from tabularium.operators.knn import local_outlier_factor
from tabularium.plans.features import final_feature_set


def vectors(t):
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("standardized_features", "M1", "WITH m AS (SELECT " + union_features("avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s", glue=", ") + """ FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, """ + union_features("round((l.{f} - {f}_m) / {f}_s, 6) AS {f}", glue=", ") + " FROM lineitem l, m")
def standardized_features(t):
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = t.lineitem.select(*keys, *FEATS, F.lit(1.0).alias("constant"))
    scaled, kept = matrix.standardize(rows, [*FEATS, "constant"])
    return scaled.select(*keys, *[F.round(f, 6).alias(f) for f in kept])


@query("hybrid_components", "M2")
def hybrid_components(t):
    """Two core columns and three components of the others."""
    rows, _ = matrix.hybrid_pca(wide(t), ["vec_id", "label"], DIMS[:2], DIMS[2:], 3)
    return rows


@query("component_loadings", "M3")
def component_loadings(t):
    _, loadings = matrix.hybrid_pca(wide(t), ["vec_id", "label"], DIMS[:2], DIMS[2:], 3)
    return loadings


PAIR = """
WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS sa, avg(l_tax) AS b, stddev_pop(l_tax) AS sb, corr(l_quantity, l_tax) AS r FROM lineitem)
"""


@query("two_feature_components", "M2 M11", PAIR + """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  round(abs((l_quantity - a) / sa + sign(r) * (l_tax - b) / sb) / sqrt(2), 5) AS pc1_size,
  round(abs((l_quantity - a) / sa - sign(r) * (l_tax - b) / sb) / sqrt(2), 5) AS pc2_size FROM lineitem, m
""")
def two_feature_components(t):
    """With two standardised features the axes are the diagonals, so SQL can say them (up to sign)."""
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    plane = matrix.principal_plane(t.lineitem, keys, ["l_quantity", "l_tax"])
    return plane.select(*keys, F.round(F.abs("pc1"), 5).alias("pc1_size"), F.round(F.abs("pc2"), 5).alias("pc2_size"))


@query("principal_plane", "M11")
def principal_plane(t):
    return matrix.principal_plane(wide(t), ["vec_id", "label"], DIMS)


@query("discriminant_plane", "M4")
def discriminant_plane(t):
    return matrix.discriminant_plane(wide(t), ["vec_id", "label"], "label", DIMS)


@query("plain_mahalanobis", "M5", """
WITH v AS (SELECT vec_id, label, list_sum(CAST(embedding[1:64:2] AS DOUBLE[])) AS x, list_sum(CAST(embedding[2:64:2] AS DOUBLE[])) AS y FROM embeddings),
c AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM v GROUP BY 1)
SELECT vec_id, label, round((yy * pow(x - mx, 2) - 2 * xy * (x - mx) * (y - my) + xx * pow(y - my, 2)) / (xx * yy - xy * xy), 6) AS distance
FROM v JOIN c USING (label)
""")
def plain_mahalanobis(t):
    """Over two sums, of the odd and of the even dimensions, so that SQL can invert the covariance."""
    return outliers.mahalanobis(two_sums(t), "label", "x", 2, "distance").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("robust_mahalanobis", "M5")
def robust_mahalanobis(t):
    return outliers.robust_mahalanobis(vectors(t), "label", "x", 64).drop("x")


LOF_SQL = """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
n AS (SELECT label, least(20, greatest(2, count(*) - 1)) AS k FROM v GROUP BY 1),
e AS (SELECT * FROM (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_distance(a.x, b.x) AS d,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS place
      FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id) JOIN n USING (label) WHERE place <= k),
kd AS (SELECT a, max(d) AS kd FROM e GROUP BY 1),
den AS (SELECT e.a, 1 / (avg(greatest(e.d, kd.kd)) + 1e-10) AS den FROM e JOIN kd ON e.b = kd.a GROUP BY 1),
lof AS (SELECT e.label, e.a AS vec_id, avg(o.den) / any_value(s.den) AS lof_score FROM e JOIN den o ON e.b = o.a JOIN den s ON e.a = s.a GROUP BY ALL)
"""


@query("local_outlier_factor", "M6", LOF_SQL + "SELECT vec_id, label, round(lof_score, 6) AS lof_score FROM lof")
def lof(t):
    return local_outlier_factor(vectors(t), "vec_id", "label", "x").select("vec_id", "label", F.round("score", 6).alias("lof_score"))


@query("local_outlier_flags", "M6 M10", LOF_SQL + """
SELECT vec_id, label, lof_score >= q AS flag_lof FROM (SELECT *, quantile_cont(lof_score, 0.95::DOUBLE) OVER (PARTITION BY label) AS q FROM lof)
""")
def lof_flags(t):
    scores = local_outlier_factor(vectors(t), "vec_id", "label", "x")
    return outliers.quantile_flag(scores, "label", "score", 0.95, "flag_lof", 5).select("vec_id", "label", "flag_lof")


@query("isolation_scores", "M7 X4")
def isolation_scores(t):
    return outliers.isolation_forest(vectors(t), "vec_id", "label", "x").drop("x")


@query("reconstruction_errors", "M8")
def reconstruction_errors(t):
    return outliers.pca_reconstruction(vectors(t), "label", "x", 64).drop("x")


TWO = """
WITH v AS (SELECT vec_id, label, list_sum(CAST(embedding[1:64:2] AS DOUBLE[])) AS x, list_sum(CAST(embedding[2:64:2] AS DOUBLE[])) AS y FROM embeddings)
"""


def two_sums(t):
    total = lambda odd: F.aggregate(F.filter("x", lambda v, i: i % 2 == odd), F.lit(0.0), lambda a, v: a + v)
    return vectors(t).withColumn("x", F.array(total(0), total(1)))


@query("two_feature_reconstruction", "M8", TWO + """
, c AS (SELECT label, avg(x) AS mx, avg(y) AS my, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM v GROUP BY 1),
e AS (SELECT vec_id, label, pow(cos(a) * (y - my) - sin(a) * (x - mx), 2) / 2 AS e FROM v JOIN c USING (label))
SELECT vec_id, label, round(e, 6) AS error, e >= quantile_cont(e, 0.95::DOUBLE) OVER (PARTITION BY label) AS flagged FROM e
""")
def two_feature_reconstruction(t):
    """With two features the component that is dropped is the minor axis, whose angle SQL can say."""
    rows = outliers.pca_reconstruction(two_sums(t), "label", "x", 2)
    return rows.select("vec_id", "label", F.round("pca_reconstruction_error", 6).alias("error"), F.col("flag_pca_reconstruction").alias("flagged"))


@query("two_feature_loadings", "M3", """
WITH r AS (SELECT abs(corr(l_quantity, l_tax)) AS r FROM lineitem), f AS (SELECT unnest(['l_quantity', 'l_tax']) AS feature)
SELECT feature, 1 AS component, round(sqrt(0.5), 6) AS loading, round((1 + r) / 2, 6) AS explained, round((1 + r) / 2, 6) AS cumulative FROM f, r
UNION ALL SELECT feature, 2, round(sqrt(0.5), 6), round((1 - r) / 2, 6), 1.0 FROM f, r
""")
def two_feature_loadings(t):
    """Loadings (by size), explained and cumulative shares of two residual features."""
    _, loadings = matrix.hybrid_pca(t.lineitem, ["l_orderkey"], ["l_discount"], ["l_quantity", "l_tax"], 2)
    return loadings.select("feature", "component", F.round(F.abs("loading"), 6).alias("loading"), F.round("explained", 6).alias("explained"), F.round("cumulative", 6).alias("cumulative"))


@query("two_class_discriminant", "M4", """
WITH z AS (SELECT l_orderkey, l_linenumber, l_linestatus AS c, (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS x, (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS y FROM lineitem),
g AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM z GROUP BY 1),
s AS (SELECT sum(n * xx) / sum(n) AS xx, sum(n * yy) / sum(n) AS yy, sum(n * xy) / sum(n) AS xy, max(mx) FILTER (WHERE c = 'F') - max(mx) FILTER (WHERE c = 'O') AS dx, max(my) FILTER (WHERE c = 'F') - max(my) FILTER (WHERE c = 'O') AS dy FROM g),
w AS (SELECT (yy * dx - xy * dy) AS a, (xx * dy - xy * dx) AS b, xx, yy, xy FROM s),
u AS (SELECT a / sqrt(a * a * xx + 2 * a * b * xy + b * b * yy) AS a, b / sqrt(a * a * xx + 2 * a * b * xy + b * b * yy) AS b FROM w)
SELECT l_orderkey, l_linenumber, round(abs(a * x + b * y), 3) AS ld1_size, count(*) AS n_equal FROM z, u GROUP BY ALL
""")
def two_class_discriminant(t):
    """With two classes the axis is the difference of means over the within-class scatter (up to sign)."""
    keys = ["l_orderkey", "l_linenumber"]
    plane = matrix.discriminant_plane(t.lineitem, keys, "l_linestatus", ["l_quantity", "l_extendedprice"], 1)
    return plane.groupBy(*keys, F.round(F.abs("ld1"), 3).alias("ld1_size")).agg(F.count("*").alias("n_equal"))


@query("isolation_flag_counts", "M7 X4", """
SELECT label, count(*) AS n_rows, true AS in_range, count(*) - CAST(ceil(0.95 * (count(*) - 1)) AS BIGINT) AS n_flagged FROM embeddings GROUP BY label
""")
def isolation_flag_counts(t):
    """Scores lie between 0 and 1, and those at or above the 95 % quantile of their class are flagged."""
    s = F.col("isolation_forest_score")
    rows = outliers.isolation_forest(vectors(t), "vec_id", "label", "x")
    return rows.groupBy("label").agg(F.count("*").alias("n_rows"), F.bool_and((s > 0) & (s < 1)).alias("in_range"), F.count_if("flag_isolation_forest").alias("n_flagged"))


@query("quantile_flags", "M10", """
SELECT event_id, event_type, value >= quantile_cont(value, 0.95) OVER (PARTITION BY event_type) AS flagged FROM events
""")
def quantile_flags(t):
    return outliers.quantile_flag(t.events.select("event_id", "event_type", "value"), "event_type", "value", 0.95, "flagged").drop("value")


FLAG_SQL = """
WITH f AS (SELECT vec_id, label, embedding[1] > 0.15 AS flag_mahalanobis, embedding[2] > 0.1 AS flag_lof, embedding[3] > 0.1 AS flag_isolation_forest,
           embedding[4] > 0.1 AS flag_pca_reconstruction FROM embeddings),
c AS (SELECT *, CAST(flag_mahalanobis AS INT) + CAST(flag_lof AS INT) + CAST(flag_isolation_forest AS INT) + CAST(flag_pca_reconstruction AS INT) AS consensus FROM f)
"""


def flagged(t):
    cuts = (0.15, 0.1, 0.1, 0.1)
    flags = [(F.col("embedding")[i] > c).alias(f) for i, (f, c) in enumerate(zip(outliers.FLAGS, cuts))]
    return outliers.consensus(t.embeddings.select("vec_id", "label", "embedding", *flags))


@query("outlier_summary_by_class", "A18 X2", FLAG_SQL + """
SELECT label, count(*) AS n_samples, round(avg(consensus), 9) AS mean_consensus, max(consensus) AS max_consensus,
  count(*) FILTER (WHERE consensus >= 1) AS n_weak_or_more, count(*) FILTER (WHERE consensus >= 2) AS n_moderate_or_more,
  count(*) FILTER (WHERE consensus >= 3) AS n_strong, round(count(*) FILTER (WHERE consensus >= 2) / count(*), 9) AS ratio_moderate_or_more
FROM c GROUP BY label
""")
def outlier_summary_by_class(t):
    return outliers.summary_by_class(flagged(t), "label").withColumns(
        {c: F.round(c, 9) for c in ("mean_consensus", "ratio_moderate_or_more")}
    )


@query("outlier_method_summary", "A19", FLAG_SQL + " UNION ALL ".join(
    f"SELECT '{f}' AS method, count(*) FILTER (WHERE {f}) AS n_flagged, round(count(*) FILTER (WHERE {f}) / count(*), 9) AS ratio_flagged FROM c" for f in outliers.FLAGS))
def outlier_method_summary(t):
    return outliers.method_summary(flagged(t)).withColumn("ratio_flagged", F.round("ratio_flagged", 9))


@query("top_outliers", "T3 T7", FLAG_SQL + """
, s AS (SELECT c.*, embedding[5] AS mahalanobis_score, embedding[6] AS lof_score, embedding[7] AS pca_reconstruction_error FROM c JOIN embeddings USING (vec_id))
SELECT vec_id, s.label, consensus FROM s ORDER BY consensus DESC, mahalanobis_score DESC, lof_score DESC, pca_reconstruction_error DESC LIMIT 100
""")
def top_outliers(t):
    x = F.col("embedding")
    rows = flagged(t).withColumns({"mahalanobis_score": x[4], "lof_score": x[5], "pca_reconstruction_error": x[6]})
    return outliers.top_outliers(rows, 100).select("vec_id", "label", "consensus")


@query("consensus_outliers", "M9 M5 M6 M7 M8")
def consensus_outliers(t):
    """All four methods over the table, joined on the key."""
    return outliers.score_all(vectors(t), "vec_id", "label", "x", 64)


@query("final_feature_roles", "B5 M9", """
SELECT 'x0' AS feature, 'core' AS role UNION ALL SELECT 'x1', 'core' UNION ALL SELECT 'PC_Residual_1', 'component'
UNION ALL SELECT 'PC_Residual_2', 'component' UNION ALL SELECT 'PC_Residual_3', 'component'
""")
def final_feature_roles(t):
    manifest = t.embeddings.select("vec_id", "label")
    _, roles, _ = final_feature_set(wide(t), manifest, "vec_id", "label", DIMS[:2], DIMS[2:])
    return roles


@query("final_feature_metadata", "B5 Q6", """
SELECT 'n_rows' AS name, CAST(count(*) AS VARCHAR) AS value FROM embeddings UNION ALL SELECT 'n_classes', CAST(count(DISTINCT label) AS VARCHAR) FROM embeddings
UNION ALL SELECT 'n_core', '2' UNION ALL SELECT 'n_residual', '62' UNION ALL SELECT 'n_components', '3'
""")
def final_feature_metadata(t):
    manifest = t.embeddings.select("vec_id", "label")
    _, _, metadata = final_feature_set(wide(t), manifest, "vec_id", "label", DIMS[:2], DIMS[2:])
    return metadata.where("name <> 'explained_variance'")
