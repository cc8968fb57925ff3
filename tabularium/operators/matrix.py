"""Class-wise second moments, small per-class models and their application as column expressions.

A model is one row per class: ``center`` array, ``rows`` array of arrays, ``divisor``. Models are
fitted by a task per class on p*p aggregated numbers, never on the class's rows, and reach the rows
through a join (broadcast after a size check).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabularium.operators import radix
from tabularium.operators.arrow import classes_of, rows_of
from tabularium.operators.skew import SMALL_BYTES, match
from tabularium.operators.stats import impute_median, varying
from tabularium.session import cut_lineage

MODEL = "center ARRAY<DOUBLE>, rows ARRAY<ARRAY<DOUBLE>>, divisor DOUBLE"


def standardize(df: DataFrame, feats: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Impute, drop constants, z-score with the population standard deviation."""
    full = impute_median(df, feats)
    kept = varying(full, feats)
    row = full.agg(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f) for f in kept]).first()
    dropped = [f for f in feats if f not in kept]
    scaled = full.withColumns({f: (F.col(f) - row[f]["m"]) / row[f]["s"] for f in kept}).drop(*dropped)
    return scaled, kept


def vector(feats: Sequence[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in feats])


def near_centre(df: DataFrame, x: str, p: int) -> np.ndarray:
    """A point near the data (the mean of a few rows), from which sums are taken so that they do not cancel."""
    few = df.select(x).limit(16).toArrow()
    data = rows_of(few, x, p)
    data = data[np.isfinite(data).all(1)]
    return data.mean(0) if len(data) else np.zeros(p)


def moments(df: DataFrame, cls: str, x: str, p: int, centre: np.ndarray | None = None) -> DataFrame:
    """(class, pos, value): count at 0, sums of x - centre at 1..p, products of all pairs after that, then count * centre.

    Each task sends one array per class it saw; positions are then summed in a balanced shuffle. Vectors with a missing or
    infinite component take no part.
    """
    kind = df.schema[cls].dataType
    centre = near_centre(df, x, p) if centre is None else centre

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict = {}
        like = None
        for table in radix.chunks(batches):
            like = table.schema.field(cls).type
            data = rows_of(table, x, p)
            good = np.isfinite(data).all(1)
            code, names = classes_of(table, cls)
            for k, name in enumerate(names):
                part = data[good & (code == k)] - centre
                if len(part):
                    row = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel(), len(part) * centre])
                    acc[name] = acc[name] + row if name in acc else row
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), like), pa.array(list(acc.values()), pa.list_(pa.float64()))], [cls, "m"])

    schema = T.StructType([T.StructField(cls, kind), T.StructField("m", T.ArrayType(T.DoubleType()))])
    return (
        df.select(cls, x).mapInArrow(partial, schema)
        .select(cls, F.posexplode("m").alias("pos", "value"))
        .groupBy(cls, "pos").agg(F.sum("value").alias("value"))
    )


def unpack(part: pd.DataFrame, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and maximum-likelihood covariance from one class's moment rows."""
    values = np.zeros(1 + 2 * p + p * p)
    values[part["pos"].to_numpy()] = part["value"].to_numpy()
    n = values[0]
    mean = values[1 : 1 + p] / n
    cov = values[1 + p : 1 + p + p * p].reshape(p, p) / n - np.outer(mean, mean)
    return int(n), mean + values[1 + p + p * p :] / n, (cov + cov.T) / 2


def fit_models(
    moment_rows: DataFrame, cls: str, p: int, fit: Callable[[int, np.ndarray, np.ndarray], tuple]
) -> DataFrame:
    """One model row per class from ``fit(n, mean, covariance) -> (center, rows, divisor)``."""
    kind = moment_rows.schema[cls].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        center, rows, divisor = fit(*unpack(part, p))
        return pd.DataFrame({
            cls: pd.Series([part[cls].iloc[0]], dtype=part[cls].dtype), "center": [list(map(float, center))],
            "rows": [[list(map(float, r)) for r in rows]], "divisor": [float(divisor)],
        })

    return moment_rows.groupBy(cls).applyInPandas(one, f"`{cls}` {kind}, {MODEL}")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def project(rows: Column, x: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, x))


def square_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)


def local_models(models: DataFrame) -> dict | None:
    """Models by class as matrices, if they are small enough to be sent to every task."""
    few = models.limit(16).toArrow()
    most = SMALL_BYTES // max(1, few.nbytes // max(1, few.num_rows))
    table = models.limit(most + 1).toArrow()
    if table.num_rows > most or table.nbytes > SMALL_BYTES:
        return None
    cls = table.schema.names[0]
    return {r[cls]: (np.array(r["center"]), np.array(r["rows"]).reshape(-1, len(r["center"])), r["divisor"]) for r in table.to_pylist()}


def score(df: DataFrame, models: DataFrame, cls: str, x: str, name: str) -> DataFrame:
    """|rows (x - center)|^2 / divisor for every row of ``df`` whose class has a model; null for a vector with a missing or infinite component.

    Models that fit in memory are applied as matrix products, class by class; others meet the rows in a join.
    """
    known = local_models(models.select(cls, "center", "rows", "divisor"))
    if known is None:
        joined = match(df, cut_lineage(models), [cls])
        value = square_sum(project(F.col("rows"), minus(F.col(x), F.col("center")))) / F.col("divisor")
        return joined.withColumn(name, value).drop("center", "rows", "divisor")
    shared = df.sparkSession.sparkContext.broadcast(known)
    p = len(next(iter(known.values()))[0]) if known else 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, names = classes_of(batch, cls)
            data, value, has = rows_of(batch, x, p), np.full(batch.num_rows, np.nan), np.zeros(batch.num_rows, bool)
            data[~np.isfinite(data).all(1)] = np.nan
            for k, each in enumerate(names):
                if each in shared.value:
                    center, rows, divisor = shared.value[each]
                    of = np.flatnonzero(code == k)
                    has[of] = True
                    value[of] = (((data[of] - center) @ rows.T) ** 2).sum(1) / divisor
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(value, mask=np.isnan(value))], [*batch.schema.names, name])
            yield out.filter(pa.array(has))

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def whitening(cov: np.ndarray) -> np.ndarray:
    """Rows W with |W d|^2 = d' pinv(cov) d."""
    values, vectors = np.linalg.eigh(cov)
    keep = values > max(values.max(), 0) * 1e-12
    if not keep.any():
        raise np.linalg.LinAlgError("zero covariance")
    return (vectors[:, keep] / np.sqrt(values[keep])).T


def orient(vectors: np.ndarray) -> np.ndarray:
    """Fix each column's sign so that its largest absolute loading is positive."""
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1, signs)


def whole_moments(df: DataFrame, feats: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of the whole table; p*p numbers reach the driver."""
    one = df.select(F.lit(0).alias("_all"), vector(feats).alias("_x"))
    return unpack(moments(one, "_all", "_x", len(feats)).toPandas(), len(feats))


def principal_axes(df: DataFrame, feats: Sequence[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, p x k loadings and explained-variance ratios."""
    _, mean, cov = whole_moments(df, feats)
    values, vectors = np.linalg.eigh(cov)
    order = values.argsort()[::-1][:k]
    return mean, orient(vectors[:, order]), np.clip(values[order], 0, None) / values.sum()


def linear_columns(feats: Sequence[str], center: np.ndarray, loadings: np.ndarray, prefix: str) -> dict[str, Column]:
    out = {}
    for j in range(loadings.shape[1]):
        total = F.lit(0.0)
        for f, c, w in zip(feats, center, loadings[:, j]):
            total = total + (F.col(f) - float(c)) * float(w)
        out[f"{prefix}{j + 1}"] = total
    return out


def hybrid_pca(df: DataFrame, keys: Sequence[str], core: Sequence[str], residual: Sequence[str], n_components: int = 3):
    """Core columns untouched, residual columns replaced by their leading components.

    Returns the frame and the loadings table (feature, component, loading, explained, cumulative).
    """
    if not core:
        raise ValueError("no core features")
    spark = df.sparkSession
    schema = "feature STRING, component INT, loading DOUBLE, explained DOUBLE, cumulative DOUBLE"
    if not residual:
        return df.select(*keys, *core), spark.createDataFrame([], schema)
    renamed = df.withColumns({f"_r_{f}": F.col(f) for f in residual})
    scaled, kept = standardize(renamed, [f"_r_{f}" for f in residual])
    center, loadings, ratios = principal_axes(scaled, kept, min(n_components, len(kept)))
    components = linear_columns(kept, center, loadings, "PC_Residual_")
    out = scaled.select(*keys, *core, *[c.alias(n) for n, c in components.items()])
    running = np.cumsum(ratios)
    table = [
        (f[3:], j + 1, float(loadings[i, j]), float(ratios[j]), float(running[j]))
        for i, f in enumerate(kept) for j in range(len(ratios))
    ]
    return out, spark.createDataFrame(table, schema)


def principal_plane(df: DataFrame, keys: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """First two components of the standardised features."""
    scaled, kept = standardize(df, feats)
    center, loadings, _ = principal_axes(scaled, kept, 2)
    return scaled.select(*keys, *[c.alias(n) for n, c in linear_columns(kept, center, loadings, "pc").items()])


def discriminant_plane(df: DataFrame, keys: Sequence[str], cls: str, feats: Sequence[str], k: int = 2) -> DataFrame:
    """Supervised projection: leading axes of between-class over within-class scatter."""
    scaled, kept = standardize(df, feats)
    p = len(kept)
    rows = moments(scaled.select(cls, vector(kept).alias("_x")), cls, "_x", p)

    def scatter(part: pd.DataFrame) -> pd.DataFrame:
        n, mean, cov = unpack(part, p)
        flat = np.concatenate([[n], n * mean, (n * cov).ravel(), (n * np.outer(mean, mean)).ravel(), [1.0]])
        return pd.DataFrame({"pos": np.arange(len(flat)), "value": flat})

    total = (
        rows.groupBy(cls).applyInPandas(scatter, "pos INT, value DOUBLE")
        .groupBy("pos").agg(F.sum("value").alias("value")).orderBy("pos").toPandas()["value"].to_numpy()
    )
    n, n_classes = total[0], int(round(total[-1]))
    mean = total[1 : 1 + p] / n
    within = total[1 + p : 1 + p + p * p].reshape(p, p) / n
    between = total[1 + p + p * p : -1].reshape(p, p) / n - np.outer(mean, mean)
    white = whitening(within)
    values, vectors = np.linalg.eigh(white @ between @ white.T)
    order = values.argsort()[::-1][: min(k, n_classes - 1, p)]
    loadings = orient(white.T @ vectors[:, order])
    return scaled.select(*keys, *[c.alias(a) for a, c in linear_columns(kept, mean, loadings, "ld").items()])
