"""Resampled feature ranking and core/residual selection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from tabularium.operators.binned import MOST_SAMPLES, bin_edges, class_sums
from tabularium.operators.skew import last_taken, match, small_table
from tabularium.operators.splits import seeded
from tabularium.operators.stats import TASK_ROWS, anova, f_from, fits_in_tasks, gain_from, named_by, neighbour_information, sampled_scores, unpivot
from tabularium.session import cut_lineage, spread

DIGITS = 10


def resample_masks(df: DataFrame, key: str, cls: str, n_bootstrap: int = 30, max_per_class: int | None = None, seed: int = 42, first: int = 0) -> DataFrame:
    """Balanced resamples without replacement, as bits of ``_mask``: bit b is set if the row is in resample ``first`` + b.

    A resample holds the rows of each class with the smallest hashes, as many as the smallest class has. A histogram of hash prefixes finds
    where each class's share ends, and only rows with that prefix are ranked; what comes back are the last hash and key taken,
    against which every row compares its own. The table is not shuffled, and no row is repeated.
    """
    if n_bootstrap > MOST_SAMPLES:
        raise ValueError(f"at most {MOST_SAMPLES} resamples in one mask")
    counts = df.groupBy(cls).agg(F.count("*").alias("n"))
    per_class = counts.agg(F.min("n")).first()[0] or 0
    if max_per_class is not None:
        per_class = min(per_class, max_per_class)
    if per_class < 3:
        raise ValueError("fewer than 3 rows in the smallest class")
    hashes = [seeded(seed, F.lit(first + b), F.col(key)) for b in range(n_bootstrap)]
    many = df.select(cls, F.col(key).alias("_key"), F.posexplode(F.array(*hashes)).alias("_b", "_h"))
    wanted = counts.select(cls, F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))).alias("_b"), F.lit(per_class).cast("bigint").alias("quota"))
    last = last_taken(many, ["_b", cls], wanted, "quota", F.col("_h"), "_key")
    ends = last.groupBy(cls).agg(F.map_from_entries(F.collect_list(F.struct("_b", "_last"))).alias("_ends"))  # n_bootstrap entries
    bits = [F.when(F.struct(h.alias("_hash"), F.col(key).alias("_key")) <= F.element_at("_ends", F.lit(b)), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b, h in enumerate(hashes)]
    return match(df, small_table(ends)[0], [cls]).withColumn("_mask", reduce(lambda a, b: a.bitwiseOR(b), bits)).drop("_ends")


def resample(df: DataFrame, key: str, cls: str, n_bootstrap: int = 30, max_per_class: int | None = None, seed: int = 42) -> DataFrame:
    """The rows of every resample, with its number in ``bootstrap``."""
    parts, df = [], spread(df)  # thirty hashes a row are work for all cores, however small the file
    for first in range(0, n_bootstrap, MOST_SAMPLES):
        size = min(MOST_SAMPLES, n_bootstrap - first)
        marked = resample_masks(df, key, cls, size, max_per_class, seed, first)
        members = F.array_compact(F.array(*[F.when(F.getbit("_mask", F.lit(b)) == 1, first + b) for b in range(size)]))
        parts.append(marked.withColumn("bootstrap", F.explode(members)).drop("_mask"))
    return reduce(DataFrame.unionByName, parts)


def binned_scores(df: DataFrame, key: str, cls: str, feats: Sequence[str], n_bootstrap: int, max_per_class: int | None, seed: int, bins: int) -> DataFrame:
    """(bootstrap, feature, f_value, information) of all resamples, from masks."""
    parts, rows = [], spread(df.select(key, cls, *feats))
    for first in range(0, n_bootstrap, MOST_SAMPLES):
        size = min(MOST_SAMPLES, n_bootstrap - first)
        marked = resample_masks(rows, key, cls, size, max_per_class, seed, first)
        marked = cut_lineage(marked.where("_mask <> 0").select(cls, "_mask", *[F.col(f).cast("double").alias(f) for f in feats]))  # drawn once
        sums = class_sums(marked, cls, feats, bin_edges(marked, feats, size, bins))
        by = ["sample", "f"]
        mean = F.col("s") / F.col("n")
        per_class = sums.where("bin < 0").select(*by, F.col("n").alias("_n"), (F.col("c") + mean).alias("_m"), F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)).alias("_v"))
        both = f_from(per_class, by).join(gain_from(sums.where("bin >= 0"), by, "cls"), by)
        parts.append(both.select((F.col("sample") + first).alias("bootstrap"), named_by("f", feats).alias("feature"), F.coalesce("f_value", F.lit(0.0)).alias("f_value"), "information"))
    return reduce(DataFrame.unionByName, parts)


def _sampled(df: DataFrame, key: str, cls: str, feats: Sequence[str], n_bootstrap: int, max_per_class: int | None, seed: int, k: int) -> DataFrame:
    """(bootstrap, feature, f_value, information) by neighbours: a value is shuffled once, with the mask of its resamples."""
    parts, rows = [], spread(df.select(key, cls, *feats))
    for first in range(0, n_bootstrap, MOST_SAMPLES):
        size = min(MOST_SAMPLES, n_bootstrap - first)
        marked = resample_masks(rows, key, cls, size, max_per_class, seed, first).where("_mask <> 0")
        scores = sampled_scores(unpivot(marked, [cls, "_mask"], feats), cls, size, k)
        parts.append(scores.withColumn("bootstrap", F.col("sample") + first).drop("sample"))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def average_rank(by: Sequence[str], value: str) -> Column:
    """Rank in descending order; ties share the mean rank. Rank and ties share one sort."""
    order = W.partitionBy(*by).orderBy(F.desc(value))
    ties = F.count("*").over(order.rangeBetween(W.currentRow, W.currentRow))
    return F.rank().over(order) + (ties - 1) / 2


def min_max(by: Sequence[str], value: str) -> Column:
    group = W.partitionBy(*by)
    low = F.min(value).over(group)
    return (F.col(value) - low) / (F.max(value).over(group) - low + 1e-12)


def interpret(a: Column, m: Column, cut: float = 5) -> Column:
    return (
        F.when((a <= cut) & (m <= cut), "robust_linear_and_nonlinear")
        .when((a <= cut) & (m > cut), "mainly_mean_difference")
        .when((a > cut) & (m <= cut), "possible_nonlinear_dependency")
        .otherwise("secondary_feature")
    )


def rank_resamples(scores: DataFrame) -> DataFrame:
    """Mean ranks and scores over resamples from rows (bootstrap, feature, f_value, information).

    Both are rounded to ten digits first: sums that are equal but for the order of addition tie.
    """
    by = ["bootstrap"]
    scores = scores.withColumns({c: F.round(c, DIGITS) for c in ("f_value", "information")})
    ranked = scores.withColumns({
        "anova_rank": average_rank(by, "f_value"), "info_rank": average_rank(by, "information"),
        "anova_norm": min_max(by, "f_value"), "info_norm": min_max(by, "information"),
    })
    out = ranked.groupBy("feature").agg(
        F.avg("f_value").alias("anova_mean"), F.stddev_samp("f_value").alias("anova_std"),
        F.avg("information").alias("info_mean"), F.stddev_samp("information").alias("info_std"),
        F.avg("anova_rank").alias("anova_rank_mean"), F.avg("info_rank").alias("info_rank_mean"),
        F.avg("anova_norm").alias("anova_norm_mean"), F.avg("info_norm").alias("info_norm_mean"),
    )
    return out.withColumns({
        "consensus_rank": (F.col("anova_rank_mean") + F.col("info_rank_mean")) / 2,
        "consensus_score": (F.col("anova_norm_mean") + F.col("info_norm_mean")) / 2,
        "interpretation": interpret(F.col("anova_rank_mean"), F.col("info_rank_mean")),
    }).orderBy("consensus_rank", "feature")


def balanced_ranking(
    df: DataFrame, key: str, cls: str, feats: Sequence[str], n_bootstrap: int = 30, max_per_class: int | None = None,
    k: int = 3, seed: int = 42, binned: int | None = None, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """F value and mutual information averaged over balanced resamples.

    All resamples are scored together, grouped by (bootstrap, feature), or by feature alone while one has at most ``task_rows`` finite values. ``binned`` swaps the
    neighbour estimate for information gain over that many equal-frequency bins.
    """
    if binned:
        return rank_resamples(binned_scores(df, key, cls, feats, n_bootstrap, max_per_class, seed, binned))
    if fits_in_tasks(unpivot(df, [cls], feats), ["feature"], task_rows):
        return rank_resamples(_sampled(df, key, cls, feats, n_bootstrap, max_per_class, seed, k))
    drawn = cut_lineage(resample(df.select(key, cls, *feats), key, cls, n_bootstrap, max_per_class, seed))  # both scores read it
    long = unpivot(drawn, ["bootstrap", cls], feats)
    by = ["bootstrap", "feature"]
    f = anova(long, by, cls).select(*by, F.coalesce("f_value", F.lit(0.0)).alias("f_value"))
    return rank_resamples(f.join(neighbour_information(long, by, cls, k, task_rows=task_rows), by))


def select_core(summary: DataFrame, top_k: int = 10, fallback: int = 1) -> DataFrame:
    """Selection group per feature. Core is in both top lists; if none is, the best consensus stands in.

    The frame has one row per feature, so its global windows are bounded by the column count.
    """
    every = W.partitionBy()

    def place(column: str) -> Column:
        return F.row_number().over(every.orderBy(column, "feature"))

    ranked = summary.withColumns({
        "_a": place("anova_rank_mean") <= top_k, "_m": place("info_rank_mean") <= top_k, "_c": place("consensus_rank"),
    })
    both = F.col("_a") & F.col("_m")
    n_core = F.count_if(both).over(every)
    stand_in = (n_core == 0) & (F.col("_c") <= fallback)
    group = (
        F.when(stand_in, "Fallback_Consensus_Core")
        .when(F.col("_m") & ~both, "Top_IG_Only_Residual")
        .when(F.col("_a") & ~both, "Top_ANOVA_Only_Residual")
        .when(both, "Core_Stable_ANOVA_and_IG")
        .otherwise("Residual_Hybrid_PCA")
    )
    return ranked.select(
        "feature", "consensus_rank", group.alias("selection_group"), (both | stand_in).alias("is_core"),
        (n_core == 0).alias("fallback_used"),
    ).orderBy("consensus_rank", "feature")
