"""Class-wise multivariate outlier scores and their consensus."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabularium.functions.tails import chi2_quantile
from tabularium.operators.arrow import rows_of
from tabularium.operators.matrix import fit_models, moments, score, whitening
from tabularium.operators.robust import CLASS_BYTES, robust_models
from tabularium.operators.skew import grouped_quantiles, match, small_table, take_smallest
from tabularium.session import cut_lineage

# Flag columns and strength labels.
FLAGS = ("flag_mahalanobis", "flag_lof", "flag_isolation_forest", "flag_pca_reconstruction")


def strength(consensus: Column) -> Column:
    return (
        F.when(consensus >= 3, "strong_multivariate_outlier")
        .when(consensus == 2, "moderate_multivariate_outlier")
        .when(consensus == 1, "weak_single_method_outlier")
        .otherwise("normal")
    )


def quantile_flag(df: DataFrame, cls: str, value: str, q: float, flag: str, min_rows: int = 0) -> DataFrame:
    """``value >= quantile`` of the class; classes below ``min_rows`` are never flagged."""
    cuts = grouped_quantiles(df, [cls], [value], [q]).select(cls, F.col(value)[0].alias("_cut"))
    sizes = df.groupBy(cls).agg(F.count("*").alias("_n"))
    joined = match(df, small_table(match(cuts, sizes, [cls]))[0], [cls])
    return joined.withColumn(flag, (F.col(value) >= F.col("_cut")) & (F.col("_n") >= min_rows)).drop("_cut", "_n")


def _plain(n: int, mean: np.ndarray, cov: np.ndarray):
    try:
        return mean, whitening(cov), 1.0
    except np.linalg.LinAlgError:
        return mean, np.eye(len(mean)), 1.0


def mahalanobis(df: DataFrame, cls: str, x: str, p: int, name: str = "mahalanobis_score") -> DataFrame:
    """Squared distance under the plain class covariance."""
    return score(df, fit_models(moments(df, cls, x, p), cls, p, _plain), cls, x, name)


def robust_mahalanobis(
    df: DataFrame, cls: str, x: str, p: int, support: float = 0.75, alpha: float = 0.975, max_steps: int = 30, class_bytes: int = CLASS_BYTES,
) -> DataFrame:
    """Squared distance under a reweighted minimum-determinant covariance, with its flag.

    Classes of fewer than max(10, p + 3) rows use the plain covariance. Vectors with missing or infinite components have no
    distance and no flag.
    """
    robust = robust_models(df, cls, x, p, support, max_steps, class_bytes)
    plain = fit_models(moments(df, cls, x, p), cls, p, _plain)
    same = F.col(cls).eqNullSafe(F.col("_c"))
    models = robust.unionByName(plain.join(robust.select(F.col(cls).alias("_c")), same, "left_anti"))
    scored = score(df, cut_lineage(models), cls, x, "mahalanobis_score")
    return scored.withColumn("flag_mahalanobis", F.coalesce(F.col("mahalanobis_score") >= chi2_quantile(alpha, p), F.lit(False)))


def pca_reconstruction(df: DataFrame, cls: str, x: str, p: int, q: float = 0.95) -> DataFrame:
    """Mean squared residual after keeping about 70 % of the class's components, with its flag."""

    def fit(n: int, mean: np.ndarray, cov: np.ndarray):
        if n < 5 or p < 2:
            return mean, np.eye(p), 1.0
        keep = min(max(1, math.ceil(0.7 * p)), p - 1, n - 1)
        values, vectors = np.linalg.eigh(cov)
        rest = vectors[:, values.argsort()[::-1][keep:]]
        return mean, rest.T, float(p)

    scored = score(df, fit_models(moments(df, cls, x, p), cls, p, fit), cls, x, "pca_reconstruction_error")
    return quantile_flag(scored, cls, "pca_reconstruction_error", q, "flag_pca_reconstruction")


def average_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    long = 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def _grow(data: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random isolation tree as flat rows (feature, threshold, left, right, path length of a leaf)."""
    limit = int(np.ceil(np.log2(max(len(data), 2))))
    nodes: list[list] = []
    stack = [(np.arange(len(data)), 0, None, None)]
    while stack:
        rows, depth, parent, side = stack.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent][side] = here
        low, high = data[rows].min(0), data[rows].max(0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        goes = data[rows, f] <= cut
        nodes.append([f, cut, -1, -1, 0.0])
        stack += [(rows[goes], depth + 1, here, 2), (rows[~goes], depth + 1, here, 3)]
    return [tuple(n) for n in nodes]


FOREST = "roots array<int>, feature array<int>, cut array<double>, lo array<int>, hi array<int>, depth array<double>"
SLICE_ROWS = 50_000  # rows that meet a forest in one call


def flattened(trees: list[list[tuple]]) -> dict[str, list]:
    """Trees end to end as arrays; children are places in the arrays."""
    out: dict[str, list] = {k: [] for k in ("roots", "feature", "cut", "lo", "hi", "depth")}
    for nodes in trees:
        base = len(out["feature"])
        out["roots"].append(base)
        for feature, cut, lo, hi, depth in nodes:
            for k, v in zip(("feature", "cut", "lo", "hi", "depth"), (feature, cut, base + lo, base + hi, depth), strict=True):
                out[k].append(v)
    return out


def path_lengths(data: np.ndarray, forest: dict[str, np.ndarray]) -> np.ndarray:
    """Sum over the trees of each row's path length."""
    total = np.zeros(len(data))
    for root in forest["roots"]:
        at = np.full(len(data), root)
        live = np.flatnonzero(forest["feature"][at] >= 0)
        while len(live):
            node = at[live]
            goes = data[live, forest["feature"][node]] <= forest["cut"][node]
            at[live] = np.where(goes, forest["lo"][node], forest["hi"][node])
            live = live[forest["feature"][at[live]] >= 0]
        total += forest["depth"][at]
    return total


def isolation_forest(
    df: DataFrame, key: str, cls: str, x: str, trees: int = 200, subsample: int = 256, contamination: float = 0.05,
    min_rows: int = 10, seed: int = 42, groves: int = 8, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(…, isolation_forest_score, flag): larger is more isolated; classes below ``min_rows`` score 0.

    Trees are grown in parallel and draw from a pool of ``trees * subsample`` hashed rows per class. A grove is one row of arrays. Rows
    go by class and slice of their key to the class's groves, so that a class of any size is met in calls of bounded size, all classes in
    one scan, and no forest passes the driver. Vectors with missing or infinite components score null.
    """
    p = len((df.select(x).where(F.col(x).isNotNull()).first() or [[]])[0])
    sizes = df.groupBy(cls).agg(F.count("*").alias("_n"))
    sizes, _ = small_table(sizes)
    pool_rows = trees * subsample
    hashed = F.md5(F.concat_ws("|", F.lit(f"forest{seed}"), F.col(key).cast("string")))
    whole = df.where((F.size(x) == p) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    pool = take_smallest(whole, [cls], sizes.where(F.col("_n") >= min_rows).withColumn("_want", F.lit(pool_rows)), "_want", hashed, [F.col(key)])
    pool = pool.select(cls, x, hashed.alias("_order"), F.explode(F.sequence(F.lit(0), F.lit(groves - 1))).alias("_grove"))
    kind, names = df.schema[cls].dataType.simpleString(), df.columns

    def plant(part: pa.Table) -> pa.Table:
        part = part.sort_by("_order")
        data, grove, name = rows_of(part, x, p), part.column("_grove")[0].as_py(), part.column(cls)[0].as_py()
        take = min(subsample, len(data))
        grown = []
        for tree in range(grove, trees, groves):
            digest = hashlib.md5(f"{seed}|{name}|{tree}".encode()).digest()
            rng = np.random.default_rng(int.from_bytes(digest[:8], "big"))
            grown.append(_grow(data[rng.choice(len(data), take, replace=False)], rng))
        flat = flattened(grown)
        arrays = [pa.array([flat[k]], pa.list_(pa.float64() if k in ("cut", "depth") else pa.int32())) for k in flat]
        return pa.Table.from_arrays([part.column(cls)[:1], part.column("_grove")[:1], *arrays], [cls, "_grove", *flat])

    forest = cut_lineage(pool.groupBy(cls, "_grove").applyInArrow(plant, f"`{cls}` {kind}, _grove int, {FOREST}"))
    parts = F.ceil(F.col("_n") / slice_rows).cast("int")
    met = match(df, sizes.select(cls, "_n", parts.alias("_slices")), [cls]).withColumn("_slice", F.pmod(F.xxhash64(F.col(key)), F.col("_slices")).cast("int"))
    everywhere = match(forest, sizes.select(cls, parts.alias("_slices")), [cls]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")

    def walk(rows: pa.Table, groves: pa.Table) -> pa.Table:
        data = rows_of(rows, x, p)
        good = np.isfinite(data).all(1)
        depth = np.zeros(len(data))
        for i in range(groves.num_rows):
            arrays = {k: groves.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("roots", "feature", "cut", "lo", "hi", "depth")}
            depth[good] += path_lengths(data[good], arrays)
        value = np.zeros(len(data))
        if groves.num_rows:
            scale = float(average_path(min(subsample, rows.column("_n")[0].as_py())))
            value = np.where(good, 2.0 ** (-(depth / trees) / scale), np.nan)
        return rows.select(names).append_column("isolation_forest_score", pa.array(value, mask=np.isnan(value)))

    schema = T.StructType([*df.schema.fields, T.StructField("isolation_forest_score", T.DoubleType())])
    scored = met.groupBy(cls, "_slice").cogroup(everywhere.groupBy(cls, "_slice")).applyInArrow(walk, schema)
    return quantile_flag(scored, cls, "isolation_forest_score", 1 - contamination, "flag_isolation_forest", min_rows)


def consensus(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags])
    return df.withColumn("consensus", total).withColumn("outlier_strength", strength(F.col("consensus")))


def summary_by_class(df: DataFrame, cls: str) -> DataFrame:
    c = F.col("consensus")
    out = df.groupBy(cls).agg(
        F.count("*").alias("n_samples"), F.avg(c).alias("mean_consensus"), F.max(c).alias("max_consensus"),
        F.count_if(c >= 1).alias("n_weak_or_more"), F.count_if(c >= 2).alias("n_moderate_or_more"),
        F.count_if(c >= 3).alias("n_strong"),
    )
    return out.withColumn("ratio_moderate_or_more", F.col("n_moderate_or_more") / F.col("n_samples")).orderBy(
        F.desc("ratio_moderate_or_more"), F.desc("mean_consensus"), cls
    )


def method_summary(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    return row.unpivot("_n", list(flags), "method", "n_flagged").select(
        "method", "n_flagged", (F.col("n_flagged") / F.col("_n")).alias("ratio_flagged")
    )


def top_outliers(df: DataFrame, n: int = 100) -> DataFrame:
    keys = ["consensus", "mahalanobis_score", "lof_score", "pca_reconstruction_error"]
    return df.orderBy(*[F.desc_nulls_last(k) for k in keys]).limit(n)


def score_all(df: DataFrame, key: str, cls: str, x: str, p: int) -> DataFrame:
    """The four methods joined on the key, with consensus score and label."""
    from tabularium.operators.knn import local_outlier_factor

    base = df.select(key, cls, x)
    lof = quantile_flag(
        local_outlier_factor(base, key, cls, x).withColumnRenamed("score", "lof_score"), cls, "lof_score", 0.95, "flag_lof", 5
    )
    joined = robust_mahalanobis(base, cls, x, p).drop(x)
    for part in (
        lof.drop(cls), isolation_forest(base, key, cls, x).drop(cls, x), pca_reconstruction(base, cls, x, p).drop(cls, x)
    ):
        joined = joined.join(part, key)
    return consensus(joined)
