"""Per-class statistics, outlier flags, correlation and feature scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from tabularium.functions.scalars import finite
from tabularium.functions.tails import digamma, f_tail_udf
from tabularium.operators import radix
from tabularium.operators.arrow import classes_of
from tabularium.operators.binned import bin_edges, class_sums
from tabularium.operators.skew import grouped_quantiles, match, small_table, value_ranks

TASK_ROWS = 2_000_000  # values of a feature that one task sorts


def class_distribution(df: DataFrame, cls: str) -> DataFrame:
    """Count and share per class, by class. The total is taken over the k class rows, not the table."""
    counts = df.groupBy(cls).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy())).orderBy(cls)


def is_balanced(df: DataFrame, cls: str) -> DataFrame:
    counts = df.groupBy(cls).agg(F.count("*").alias("n"))
    return counts.agg((F.count_distinct("n") == 1).alias("balanced"), F.count("*").alias("n_classes"))


def impute_median(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Infinite or missing values become the exact column median of the rest."""
    clean = df.withColumns({f: finite(F.col(f)) for f in feats})
    medians = grouped_quantiles(clean, [], feats, [0.5]).first()
    return clean.withColumns({
        f: F.coalesce(F.col(f), F.lit(medians[f][0] if medians and medians[f] else None).cast("double")) for f in feats
    })


def finite_only(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """NaN and infinite values of the features become null; only fractional columns can hold them."""
    odd = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns({f: finite(F.col(f)) for f in feats if f in odd})


def outside(f: str) -> Column:
    value = F.col(f).cast("double")
    return ((value < F.col(f"{f}_lower")) | (value > F.col(f"{f}_upper"))) & ~F.isnan(value)


def varying(df: DataFrame, feats: Sequence[str]) -> list[str]:
    """Features whose sample standard deviation is positive, found in one pass."""
    spread = df.agg(*[F.stddev_samp(f).alias(f) for f in feats]).first()
    return [f for f in feats if spread[f] is not None and spread[f] > 0]


def class_statistics(df: DataFrame, cls: str, feats: Sequence[str]) -> DataFrame:
    """Long form: class, feature, mean, sample std, exact median, min, max, over finite values."""
    df = finite_only(df, feats)
    sums = df.groupBy(cls).agg(*[
        F.struct(F.avg(f).alias("mean"), F.stddev_samp(f).alias("std"), F.min(f).cast("double").alias("min"),
                 F.max(f).cast("double").alias("max")).alias(f)
        for f in feats
    ])
    medians = grouped_quantiles(df, [cls], feats, [0.5]).select(cls, *[F.col(f)[0].alias(f"{f}_median") for f in feats])
    both = match(sums, medians, [cls])
    rows = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("s"), F.col(f"{f}_median").alias("median")) for f in feats
    ]))
    return both.select(cls, rows.alias("r")).select(
        cls, "r.feature", "r.s.mean", "r.s.std", "r.median", "r.s.min", "r.s.max"
    )


def class_feature_matrix(df: DataFrame, cls: str, feats: Sequence[str]) -> DataFrame:
    """Class means scaled to [0, 1] across classes; a feature without range becomes 0."""
    means = finite_only(df, feats).groupBy(cls).agg(*[F.avg(f).alias(f) for f in feats])
    every = W.partitionBy()

    def scaled(f: str) -> Column:
        low, high = F.min(f).over(every), F.max(f).over(every)
        return F.coalesce((F.col(f) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))

    return means.select(cls, *[scaled(f).alias(f) for f in feats])


def outlier_bounds(df: DataFrame, cls: str, feats: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Lower and upper bound per class, null for classes with fewer than four finite values of a feature."""
    df = finite_only(df, feats)
    quartiles = grouped_quantiles(df, [cls], feats, [0.25, 0.75])
    filled = df.groupBy(cls).agg(*[F.count(f).alias(f"{f}_n") for f in feats], F.count("*").alias("n_rows"))
    both = match(quartiles, filled, [cls])
    columns = []
    for f in feats:
        spread = F.col(f)[1] - F.col(f)[0]
        enough = F.col(f"{f}_n") >= 4
        columns += [
            F.when(enough, F.col(f)[0] - multiplier * spread).alias(f"{f}_lower"),
            F.when(enough, F.col(f)[1] + multiplier * spread).alias(f"{f}_upper"),
        ]
    return small_table(both.select(cls, "n_rows", *columns))[0]


def outlier_flags(df: DataFrame, cls: str, feats: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """``<feature>_outlier`` per row and their sum; infinite values are outliers, NaN and values on a bound are not."""
    bounded = match(df, outlier_bounds(df, cls, feats, multiplier), [cls])
    flags = {
        f"{f}_outlier": F.coalesce(outside(f), F.lit(False)) for f in feats
    }
    bounded = bounded.withColumns(flags)
    total = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in flags])
    return bounded.withColumn("outlier_count", total).select(*df.columns, *flags, "outlier_count")


def outlier_summary(df: DataFrame, cls: str, feats: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Flagged count and ratio per feature and class; the ratio counts every row of the class."""
    bounds = outlier_bounds(df, cls, feats, multiplier)
    flagged = match(df.select(cls, *feats), bounds, [cls]).groupBy(cls).agg(
        F.count("*").alias("n_rows"),
        *[
            F.struct(
                F.count_if(outside(f)).alias("n_outliers"),
                F.first(f"{f}_lower").alias("lower"), F.first(f"{f}_upper").alias("upper"),
            ).alias(f) for f in feats
        ],
    )
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("s")) for f in feats]))
    return (
        flagged.select(cls, "n_rows", rows.alias("r"))
        .select(cls, "r.feature", "n_rows", "r.s.n_outliers", "r.s.lower", "r.s.upper")
        .where("lower is not null")
        .withColumn("ratio", F.col("n_outliers") / F.col("n_rows"))
        .orderBy(F.desc("ratio"), F.desc("n_outliers"), "feature", cls)
    )


def correlations(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form over pairs of finite values, one pass over the table.

    A task sends five p x p matrices of sums (of a pair's rows, values, squares and products), whatever its rows; they are added by position.
    """
    feats, p = list(feats), len(feats)
    wide = df.select(*[F.col(f).cast("double").alias(f) for f in feats])
    few = wide.limit(64).toArrow()
    centre = np.array([x[np.isfinite(x)].mean() if np.isfinite(x).any() else 0.0 for x in (radix.numbers(few, f) for f in feats)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, p, p))
        for table in radix.chunks(batches):
            x = np.stack([radix.numbers(table, f) for f in feats], 1) - centre
            good = np.isfinite(x)
            x, there = np.where(good, x, 0.0), good.astype(float)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    places = wide.mapInArrow(partial, "m array<double>").select(F.posexplode("m").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v"))
    name = lambda at: F.element_at(F.array(*[F.lit(f) for f in feats]), at.cast("int") + 1)
    i, j, kind = F.col("pos") % (p * p) / p, F.col("pos") % p, F.col("pos") / (p * p)
    cells = places.select(F.floor(i).cast("int").alias("i"), j.cast("int").alias("j"), F.floor(kind).cast("int").alias("kind"), "v")
    other = cells.where("kind IN (1, 2)").select(F.col("j").alias("i"), F.col("i").alias("j"), (F.col("kind") + 3).alias("kind"), "v")
    at = {k: F.sum(F.when(F.col("kind") == k, F.col("v"))) for k in range(6)}
    n, sx, qx, xy, sy, qy = (at[k].alias(a) for k, a in zip(range(6), ("n", "sx", "qx", "xy", "sy", "qy"), strict=True))
    pairs = cells.unionByName(other).groupBy("i", "j").agg(n, sx, qx, xy, sy, qy)
    spread = lambda q, s: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    vx, vy, floor = spread("qx", "sx"), spread("qy", "sy"), F.lit(1e-13)
    varies = (F.col("n") > 1) & (vx > floor * F.col("qx")) & (vy > floor * F.col("qy"))
    r = F.when(F.col("i") == F.col("j"), 1.0).otherwise((F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    return pairs.select(name(F.col("i")).alias("feature_a"), name(F.col("j")).alias("feature_b"), F.when(varies, r).alias("r"))


def _square(long: DataFrame, feats: Sequence[str], value: str) -> np.ndarray:
    """p x p matrix on the driver from its p*p long rows."""
    place = {f: i for i, f in enumerate(feats)}
    out = np.full((len(feats), len(feats)), np.nan)
    for r in long.collect():
        out[place[r["feature_a"]], place[r["feature_b"]]] = np.nan if r[value] is None else r[value]
    return out


def condition_number(df: DataFrame, feats: Sequence[str]) -> float:
    """Square root of the eigenvalue ratio of the correlation matrix of complete rows."""
    df = finite_only(df, feats).na.drop(subset=list(feats))
    values = np.linalg.eigvalsh(np.nan_to_num(_square(correlations(df, feats), feats, "r")))
    return float(np.sqrt(values.max() / max(values.min(), 1e-12)))


def gram(df: DataFrame, feats: Sequence[str]) -> np.ndarray:
    """X'X over the rows with every feature present, in one aggregate."""
    complete = df.select(*[finite(F.col(f)).alias(f) for f in feats]).na.drop()
    pairs = [(i, j) for i in range(len(feats)) for j in range(i, len(feats))]
    row = complete.agg(*[F.sum(F.col(feats[i]) * F.col(feats[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(feats), len(feats)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"g{i}_{j}"] or 0.0
    return out


def vif_from_gram(g: np.ndarray, centred: np.ndarray | None = None) -> np.ndarray:
    """Variance inflation without an added intercept; a singular system gives infinity.

    ``centred`` holds the column sums followed by the row count. Where the other columns span a
    constant, the regression has an intercept after all and the sums of squares are centred.
    """
    scale = np.sqrt(np.clip(np.diag(g), 1e-300, None))
    out = np.empty(len(g))
    for i in range(len(g)):
        rest = [j for j in range(len(g)) if j != i]
        a = g[np.ix_(rest, rest)] / np.outer(scale[rest], scale[rest])
        b = g[rest, i] / (scale[rest] * scale[i])
        explained = float(b @ np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b) if rest else 0.0
        total = 1.0
        if centred is not None and rest:
            sums, n = centred[:-1], centred[-1]
            s = sums[rest] / scale[rest]
            constant = float(s @ np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ s) / n
            if abs(constant - 1.0) < 1e-9:
                shift = (sums[i] / scale[i]) ** 2 / n
                explained, total = explained - shift, total - shift
        left = total - explained
        out[i] = np.inf if left <= 1e-12 * max(total, 1e-300) else total / left
    return out


def _vif_inputs(df: DataFrame, feats: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    complete = df.select(*[finite(F.col(f)).alias(f) for f in feats]).na.drop()
    feats = varying(complete, feats)
    g = gram(complete, feats)
    row = complete.agg(*[F.sum(f) for f in feats], F.count("*")).first()
    return feats, g, np.array([float(v or 0) for v in row])


def vif(df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """feature, vif; largest first."""
    kept, g, sums = _vif_inputs(df, feats)
    rows = [(f, float(v)) for f, v in zip(kept, vif_from_gram(g, sums))]
    return df.sparkSession.createDataFrame(rows, "feature STRING, vif DOUBLE").orderBy(F.desc("vif"), "feature")


def prune_by_vif(df: DataFrame, feats: Sequence[str], threshold: float = 10.0, min_features: int = 3) -> DataFrame:
    """Drop the largest factor until all are within the threshold; every step reuses one Gram matrix."""
    kept, g, sums = _vif_inputs(df, feats)
    alive, rows, step = list(range(len(kept))), [], 0
    while len(alive) > min_features:
        part = vif_from_gram(g[np.ix_(alive, alive)], np.append(sums[alive], sums[-1]))
        worst = int(np.argmax(np.where(np.isfinite(part), part, np.inf)))
        if np.isfinite(part[worst]) and part[worst] <= threshold:
            break
        step += 1
        rows.append((kept[alive[worst]], step, float(part[worst]), False))
        del alive[worst]
    final = vif_from_gram(g[np.ix_(alive, alive)], np.append(sums[alive], sums[-1]))
    rows += [(kept[i], None, float(v), True) for i, v in zip(alive, final)]
    return df.sparkSession.createDataFrame(rows, "feature STRING, removed_at INT, vif DOUBLE, kept BOOLEAN")


def unpivot(df: DataFrame, ids: Sequence[str], feats: Sequence[str]) -> DataFrame:
    """Rows (ids, feature, value) without the missing values."""
    return df.select(*ids, *[F.col(f).cast("double").alias(f) for f in feats]).unpivot(
        list(ids), list(feats), "feature", "value"
    ).where("value is not null")


def anova(long: DataFrame, by: Sequence[str], cls: str) -> DataFrame:
    """One-way F per group of ``by`` from per-class counts, means and variances."""
    return f_from(long.groupBy(*by, cls).agg(F.count("*").alias("_n"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v")), by)


def f_from(per_class: DataFrame, by: Sequence[str]) -> DataFrame:
    """One-way F per group of ``by`` from rows (_n, _m, _v) per class."""
    total = W.partitionBy(*by)
    grand = F.sum(F.col("_n") * F.col("_m")).over(total) / F.sum("_n").over(total)
    sums = per_class.withColumn("_g", grand).groupBy(*by).agg(
        F.sum(F.col("_n") * (F.col("_m") - F.col("_g")) ** 2).alias("_ssb"),
        F.sum(F.col("_n") * F.col("_v")).alias("_ssw"), F.sum("_n").alias("_rows"), F.count("*").alias("_k"),
    )
    return sums.select(
        *by,
        F.try_divide(F.col("_ssb") / (F.col("_k") - 1), F.col("_ssw") / (F.col("_rows") - F.col("_k"))).alias("f_value"),
        (F.col("_k") - 1).cast("double").alias("df_between"), (F.col("_rows") - F.col("_k")).cast("double").alias("df_within"),
    )


def with_p_value(scores: DataFrame) -> DataFrame:
    return scores.withColumn("p_value", f_tail_udf("f_value", "df_between", "df_within"))


def binned_information(df: DataFrame, cls: str, feats: Sequence[str], bins: int = 10) -> DataFrame:
    """Information gain (nats) of the class given equal-frequency bins of each feature's finite values; equal values share a bin."""
    one = df.select(cls, *feats, F.lit(1).cast("long").alias("_mask"))
    sums = class_sums(one, cls, feats, bin_edges(one, feats, 1, bins))
    return gain_from(sums.where("bin >= 0"), ["f"], "cls").select(named_by("f", feats).alias("feature"), "information")


def named_by(place: str, feats: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in feats]), F.col(place) + 1)


def gain_from(cells: DataFrame, by: Sequence[str], cls: str) -> DataFrame:
    """Information gain per group of ``by`` from counts ``n`` per class and ``bin``."""
    cells = cells.repartition(*by)  # serves all three windows
    n = F.sum("n").over(W.partitionBy(*by))
    row = F.sum("n").over(W.partitionBy(*by, cls))
    col = F.sum("n").over(W.partitionBy(*by, "bin"))
    term = F.col("n") / n * F.ln(F.col("n") * n / (row * col))
    return cells.withColumn("_t", term).groupBy(*by).agg(F.greatest(F.sum("_t"), F.lit(0.0)).alias("information"))


def neighbour_information(
    long: DataFrame, by: Sequence[str], cls: str, k: int = 3, block: int = 200_000, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Nearest-neighbour mutual information between the value and the class, never negative.

    For a row, r is the distance to its k-th neighbour inside its class and m the number of rows of
    any class strictly closer than r (itself included; equal values when r = 0). A group of at most ``task_rows``
    finite values is sorted in one task. Beyond that, everything runs on distinct (class, value) rows with multiplicities. Neighbours come from windows over blocks of
    consecutive ranks with k rows of overlap, and m from two prefix counts.
    """
    by = list(by)
    if fits_in_tasks(long, by, task_rows):
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for c in by for f in long.schema if f.name == c]

        def score(part: pa.Table) -> pa.Table:
            values = part.column("value").to_numpy()
            order = np.argsort(values, kind="stable")
            gain = neighbour_gain(values[order], classes_of(part, cls)[0][order], k)
            one = 0 if math.isnan(gain) else 1
            return pa.Table.from_arrays([*[part.column(c)[:one] for c in by], pa.array([gain][:one], pa.float64())], [*by, "information"])

        return long.select(*by, cls, "value").groupBy(*by).applyInArrow(score, ", ".join([*kinds, "information double"]))
    group = [*by, cls]
    counts = long.groupBy(*group, "value").agg(F.count("*").alias("_c"))
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("_nc")).where("_nc > 1")
    sizes, _ = small_table(sizes)
    counts = match(counts, sizes, group)
    ranked = value_ranks(counts, group, "value", "_c").withColumn("_at", F.col("place") - 1)
    home = F.floor(F.col("_at") / block)
    inside = F.col("_at") % block
    homes = F.array_compact(F.array(
        home, F.when((inside < k) & (home > 0), home - 1), F.when(inside >= block - k, home + 1)
    ))
    spread = ranked.withColumn("_home", home).withColumn("_block", F.explode(homes))
    order = W.partitionBy(*group, "_block").orderBy("value")
    near = [F.struct(F.lit(0.0).alias("d"), (F.col("_c") - 1).alias("c"))]
    for i in range(1, k + 1):
        for side in (F.lag, F.lead):
            near.append(F.struct(
                F.abs(side("value", i).over(order) - F.col("value")).alias("d"), side("_c", i).over(order).alias("c")
            ))
    spread = spread.withColumn("_near", F.array(*near)).where("_block = _home")
    kk = F.least(F.lit(k), F.col("_nc") - 1)
    sorted_near = F.array_sort(F.filter("_near", lambda s: s["d"].isNotNull()))
    radius = F.aggregate(
        sorted_near,
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("r")),
        lambda acc, s: F.struct(
            (acc["seen"] + s["c"]).alias("seen"),
            F.when(acc["r"].isNotNull(), acc["r"]).when(acc["seen"] + s["c"] >= F.col("_kk"), s["d"]).alias("r"),
        ),
    )["r"]
    points = spread.withColumn("_kk", kk).withColumn("_r", radius).select(
        *group, "value", "_c", "_nc", "_kk", "_r",
        (F.col("value") - F.col("_r")).alias("_lo"), (F.col("value") + F.col("_r")).alias("_hi"),
    )
    marks = (
        points.select(*by, F.col("value").alias("_x"), F.col("_c").alias("_w"))
        .unionByName(points.where("_r > 0").select(
            *by, F.explode(F.array("_lo", "_hi")).alias("_x"), F.lit(0).cast("bigint").alias("_w")))
        .groupBy(*by, "_x").agg(F.sum("_w").alias("_w"))
    )
    line = value_ranks(marks, by, "_x", "_w").select(*by, "_x", F.col("below").alias("_b"), F.col("_w").alias("_own"))
    low = line.select(*by, F.col("_x").alias("_lo"), (F.col("_b") + F.col("_own")).alias("_upto"), F.col("_own").alias("_same"))
    high = line.select(*by, F.col("_x").alias("_hi"), F.col("_b").alias("_under"))
    found = points.join(low, [*by, "_lo"]).join(high, [*by, "_hi"])
    m = F.when(F.col("_r") > 0, F.col("_under") - F.col("_upto")).otherwise(F.col("_same"))
    found = found.withColumn("_m", F.greatest(m, F.lit(1)))
    n = F.sum("_c")
    return found.groupBy(*by).agg(
        F.greatest(
            digamma(n) + F.sum(F.col("_c") * (digamma(F.col("_kk")) - digamma(F.col("_nc")) - digamma(F.col("_m")))) / n,
            F.lit(0.0),
        ).alias("information")
    )


def digammas(n: np.ndarray) -> np.ndarray:
    """``digamma`` of whole numbers from 1: a sum below 16, else the asymptotic series."""
    x = np.asarray(n, np.float64)
    exact = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 16))]) - np.euler_gamma
    return np.where(x < 16, exact[np.clip(x, 1, 16).astype(np.int64) - 1], np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8))


def neighbour_gain(values: np.ndarray, classes: np.ndarray, k: int) -> float:
    """``neighbour_information`` of one ascending column of finite values with its class numbers; NaN without a class of two rows."""
    sizes = np.bincount(classes)
    inside = sizes[classes] > 1
    values, classes = values[inside], classes[inside]
    if not len(values):
        return math.nan
    by_class = np.argsort(classes, kind="stable")
    total, at = 0.0, 0
    for size in np.bincount(classes).tolist():
        v, at = values[by_class[at : at + size]], at + size
        if not size:
            continue
        kk = min(k, size - 1)
        ends = np.concatenate([np.full(kk, -np.inf), v, np.full(kk, np.inf)])  # r is the least reach of kk + 1 rows in a row
        r = np.min([np.maximum(v - ends[j : j + size], ends[j + kk : j + kk + size] - v) for j in range(kk + 1)], axis=0)
        near = np.searchsorted(values, v + r, "left") - np.searchsorted(values, v - r, "right")
        same = np.searchsorted(values, v, "right") - np.searchsorted(values, v, "left")
        m = np.maximum(np.where(r > 0, near, same), 1)
        total += float((digammas(np.array(kk)) - digammas(np.array(size)) - digammas(m)).sum())
    return max(float(digammas(np.array(len(values)))) + total / len(values), 0.0)


def f_value(values: np.ndarray, classes: np.ndarray) -> float:
    """One-way F of one column; 0 where it is not defined."""
    n = np.bincount(classes)
    known = n > 0
    means = np.bincount(classes, values, len(n)) / np.maximum(n, 1)
    within = np.bincount(classes, (values - means[classes]) ** 2, len(n)).sum()
    grand = (n * means).sum() / max(1, n.sum())
    between, groups = (n * (means - grand) ** 2).sum(), known.sum()
    if groups < 2 or n.sum() == groups or within == 0:
        return 0.0
    return float(between / (groups - 1) / (within / (n.sum() - groups)))


def sampled_scores(long: DataFrame, cls: str, size: int, k: int = 3) -> DataFrame:
    """(sample, feature, f_value, information) of every sample in the bits of ``_mask``, from rows (feature, class, value, _mask).

    A feature's finite values are sorted once, in one task, and each sample picks its rows from them: the caller sees that they are few enough.
    """

    def score(part: pa.Table) -> pa.Table:
        values, mask = part.column("value").to_numpy(), part.column("_mask").to_numpy()
        classes = classes_of(part, cls)[0]
        order = np.argsort(values, kind="stable")
        values, mask, classes = values[order], mask[order], classes[order]
        rows = []
        for b in range(size):
            picked = (mask >> b) & 1 == 1
            v, c = values[picked], classes[picked]
            if len(v):
                rows.append((b, f_value(v, c), neighbour_gain(v, c, k)))
        rows = [r for r in rows if not math.isnan(r[2])]
        name = part.column("feature")[0].as_py()
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.string()), *[pa.array([r[i] for r in rows], pa.float64()) for i in (1, 2)]]
        return pa.Table.from_arrays(columns, ["sample", "feature", "f_value", "information"])

    return long.groupBy("feature").applyInArrow(score, "sample int, feature string, f_value double, information double")


def fits_in_tasks(long: DataFrame, by: Sequence[str], rows: int = TASK_ROWS) -> bool:
    """Whether no group has more than ``rows`` values, and all are finite, so that one task may sort a group."""
    odd = F.count_if(F.isnan("value") | (F.abs("value") == float("inf")))
    most, odd = long.groupBy(*by).agg(F.count("*").alias("n"), odd.alias("odd")).agg(F.max("n"), F.sum("odd")).first()
    return (most or 0) <= rows and not odd


def centroid_proximity(df: DataFrame, cls: str, feats: Sequence[str]) -> DataFrame:
    """Pairwise distance of the k standardised class means (k rows, not table rows)."""
    means = finite_only(df, feats).groupBy(cls).agg(*[F.avg(f).alias(f) for f in feats])
    every = W.partitionBy()
    z = means.select(cls, *[
        F.coalesce((F.col(f) - F.avg(f).over(every)) / F.nullif(F.stddev_pop(f).over(every), F.lit(0.0)), F.lit(0.0)).alias(f)
        for f in feats
    ])
    z, small = small_table(z)
    other = z.select(F.col(cls).alias("other"), *[F.col(f).alias(f"o_{f}") for f in feats])
    square = reduce(lambda a, b: a + b, [(F.col(f) - F.col(f"o_{f}")) ** 2 for f in feats])
    return z.join(F.broadcast(other) if small else other, F.col(cls) < F.col("other")).select(cls, "other", F.sqrt(square).alias("distance"))


def calinski_harabasz(df: DataFrame, cls: str, feats: Sequence[str]) -> DataFrame:
    """Ratio of between-class to within-class dispersion from per-class counts, means and variances."""
    per = df.groupBy(cls).agg(F.count("*").alias("_n"), *[
        F.struct(F.avg(f).alias("m"), F.var_pop(f).alias("v")).alias(f) for f in feats
    ])
    every = W.partitionBy()
    n = F.sum("_n").over(every)
    between = reduce(lambda a, b: a + b, [
        F.col("_n") * (F.col(f)["m"] - F.sum(F.col("_n") * F.col(f)["m"]).over(every) / n) ** 2 for f in feats
    ])
    within = reduce(lambda a, b: a + b, [F.col("_n") * F.col(f)["v"] for f in feats])
    sums = per.withColumn("_b", between).withColumn("_w", within)
    return sums.agg(
        ((F.sum("_b") / (F.count("*") - 1)) / (F.sum("_w") / (F.sum("_n") - F.count("*")))).alias("score"),
        F.count("*").alias("n_classes"), F.sum("_n").alias("n_rows"),
    )


def value_moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Population skewness, excess kurtosis, coefficient of variation and bimodality per group."""
    mean, std = F.avg(value), F.stddev_pop(value)
    s, k = F.skewness(value), F.kurtosis(value)
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), s.alias("skewness"), k.alias("kurtosis"),
        F.when(F.abs(mean) < 1e-12, 0.0).otherwise(std / F.abs(mean)).alias("cv"),
        F.when((F.count(value) < 4) | (std == 0), 0.0).otherwise((s * s + 1) / (k + 3)).alias("bimodality"),
    )


def slope(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares slope; 0 where x does not vary."""
    return df.groupBy(*by).agg(F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"))
