"""Stratified splits, folds, balancing and augmentation plans.

Choice is by md5 order of (seed, key), so it does not depend on partitioning. A quota is filled with
``take_smallest`` - rows below the boundary bucket are taken in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

from tabularium.functions import scalars as S
from tabularium.operators.skew import mark_smallest, match, numbered, small_table, take_smallest


def seeded(seed, *parts) -> Column:
    """md5 of the parts, in an order that the seed decides."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in (seed, *parts)]
    return F.md5(F.concat_ws("|", *columns))


def quotas(counts: DataFrame, by: Sequence[str], cls: str, target: Column) -> DataFrame:
    """Largest-remainder share of ``target`` rows per class within each ``by`` group.

    ``counts`` has one row per (by, class) with ``n``; ``target`` may use ``total``, the group's rows.
    Integer arithmetic throughout; equal remainders go to the class that sorts first.
    """
    group = W.partitionBy(*by)
    base = counts.withColumn("total", F.sum("n").over(group)).withColumn("_target", target.cast("bigint"))
    base = base.withColumn("_floor", F.expr("n * _target div total")).withColumn(
        "_rest", F.col("n") * F.col("_target") % F.col("total")
    )
    left = F.col("_target") - F.sum("_floor").over(group)
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_rest"), F.col(cls).asc_nulls_first()))
    return base.withColumn("quota", F.col("_floor") + F.when(place <= left, 1).otherwise(0)).select(*by, cls, "n", "quota")


def share_down(percent: int) -> Column:
    """floor(total * percent / 100) in integers."""
    return F.expr(f"total * {percent} div 100")


def share_up(percent: int) -> Column:
    return F.expr(f"(total * {percent} + 99) div 100")


def stratified_pick(df: DataFrame, key: str, cls: str, target: Column, seed, by: Sequence[str] = (), hashed: Column | None = None) -> DataFrame:
    """The rows chosen when each class fills its quota in hash order."""
    by = list(by)
    counts = df.groupBy(*by, cls).agg(F.count("*").alias("n"))
    wanted, _ = small_table(quotas(counts, by, cls, target))
    hashed = seeded(seed, F.col(key)) if hashed is None else hashed
    return take_smallest(df, [*by, cls], wanted, "quota", hashed, [F.col(key)])


def _labelled(df: DataFrame, key: str, cls: str, target: Column, seed, column: str, yes: str, no: str, by: Sequence[str] = ()) -> DataFrame:
    """``column`` = yes for the rows that fill the quota; rows are labelled in place, not joined back."""
    by = list(by)
    counts = df.groupBy(*by, cls).agg(F.count("*").alias("n"))
    wanted, _ = small_table(quotas(counts, by, cls, target))
    marked = mark_smallest(df, [*by, cls], wanted, "quota", seeded(seed, F.col(key)), [F.col(key)], "_yes")
    return marked.withColumn(column, F.when(F.col("_yes"), yes).otherwise(no)).drop("_yes")


def global_split(df: DataFrame, key: str, cls: str, percent: int = 90, seed: int = 42) -> DataFrame:
    """``split`` = development (floor of the percentage, stratified) or holdout_test."""
    if not 0 < percent < 100:
        raise ValueError("the development share must lie strictly between 0 and 100 percent")
    return _labelled(df, key, cls, share_down(percent), seed, "split", "development", "holdout_test")


def stage_subset(df: DataFrame, key: str, cls: str, percent: int, stage: int, seed: int = 42) -> DataFrame:
    """Stratified share of the development rows; 100 percent keeps all."""
    if not 0 < percent <= 100:
        raise ValueError("the stage share must be in (0, 100] percent")
    rows = df if percent == 100 else stratified_pick(df, key, cls, share_down(percent), seed + stage)
    return rows.withColumns({"stage_id": F.lit(stage), "stage_fraction": F.lit(percent / 100)})


def holdout_validation(df: DataFrame, key: str, cls: str, percent: int | Column = 20, seed=42, by: Sequence[str] = ()) -> DataFrame:
    """``subset``: validation is the percentage rounded up (or a target expression), the rest trains."""
    target = percent if isinstance(percent, Column) else share_up(percent)
    return _labelled(df, key, cls, target, seed, "subset", "validation", "train", by).withColumns(
        {"repeat_id": F.lit(0), "fold_id": F.lit(0)}
    )


def require_two_classes(df: DataFrame, cls: str) -> DataFrame:
    if df.select(cls).distinct().limit(2).count() < 2:
        raise ValueError("a stratified split needs at least two classes")
    return df


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def item_folds(df: DataFrame, key: str, cls: str, n_splits, n_repeats=1, seed=42, by: Sequence[str] = ()) -> DataFrame:
    """One row per item and repeat with ``item_fold``, the fold in which the item validates.

    Items are numbered in hash order inside their class; each class starts where the previous one
    stopped, so fold sizes differ by at most one.
    """
    by = list(by)
    counts = df.groupBy(*by, cls).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*by).orderBy(F.col(cls).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    starts, _ = small_table(counts.select(*by, cls, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    repeated = df.withColumn("repeat_id", F.explode(F.sequence(F.lit(0), _column(n_repeats) - 1)))
    repeated = repeated.withColumn("_hash", seeded(seed, F.col("repeat_id"), F.col(key)))
    ranked = numbered(
        repeated, [*by, "repeat_id", cls], F.substring("_hash", 1, 3), [F.col("_hash"), F.col(key)], "_rank"
    ).drop("_hash")
    fold = F.pmod(F.col("_rank") - 1 + F.col("_start"), _column(n_splits)).cast("int")
    return match(ranked, starts, [*by, cls]).withColumn("item_fold", fold).drop("_rank", "_start")


def fold_counts(counts: DataFrame, cls: str, n: str, n_splits, by: Sequence[str] = ()) -> DataFrame:
    """(by, cls, fold_id, subset, n) of ``item_folds`` from class counts alone: classes follow each other, and items go round the folds."""
    by, total = list(by), F.col(n).cast("bigint")
    before = W.partitionBy(*by).orderBy(F.col(cls).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(total).over(before), F.lit(0).cast("bigint"))
    every = counts.select(*by, cls, total.alias("_n"), start.alias("_start"), _column(n_splits).alias("_k")).withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    upto = lambda place: F.floor((place - 1 - F.col("fold_id")) / F.col("_k"))
    inside = (upto(F.col("_start") + F.col("_n")) - upto(F.col("_start"))).cast("bigint")
    sides = F.array(F.struct(F.lit("validation").alias("subset"), inside.alias("n")), F.struct(F.lit("train").alias("subset"), (F.col("_n") - inside).alias("n")))
    return every.select(*by, cls, "fold_id", F.inline(sides)).where("n > 0")


def folds(df: DataFrame, key: str, cls: str, n_splits, n_repeats=1, seed=42, by: Sequence[str] = ()) -> DataFrame:
    """Long form: every item in every fold of every repeat, validation exactly once per repeat."""
    items = item_folds(df, key, cls, n_splits, n_repeats, seed, by)
    every = items.withColumn("fold_id", F.explode(F.sequence(F.lit(0), _column(n_splits) - 1)))
    subset = F.when(F.col("fold_id") == F.col("item_fold"), "validation").otherwise("train")
    return every.withColumn("subset", subset).drop("item_fold")


def sample_per_class(df: DataFrame, key: str, cls: str, n: int, seed: int = 42) -> DataFrame:
    counts, _ = small_table(df.groupBy(cls).agg(F.lit(n).cast("bigint").alias("quota")))
    return take_smallest(df, [cls], counts, "quota", seeded(seed, F.col(key)), [F.col(key)])


def balance(
    train: DataFrame, key: str, cls: str, unit: Sequence[str], cap: int = 210, mode: str = "equal_unique_cap", seed: int = 42
) -> DataFrame:
    """Cut classes within each unit: all to min(cap, smallest class), or only those above the cap."""
    if mode not in ("equal_unique_cap", "cap_only"):
        raise ValueError("mode must be equal_unique_cap or cap_only")
    unit = list(unit)
    sizes, _ = small_table(balance_targets(train, cls, unit, cap, mode))
    hashed = seeded(seed, F.lit("balance"), *[F.col(u) for u in unit], F.col(key))
    kept = take_smallest(train, [*unit, cls], sizes, "take_n", hashed, [F.col(key)])
    return kept.withColumns({
        "is_original": F.lit(True), "is_augmented": F.lit(False), "augmentation_id": F.lit(""),
        "augmentation_ops": F.lit(""), "base_source_id": F.col(key).cast("string"),
    })


def balance_targets(train: DataFrame, cls: str, unit: Sequence[str], cap: int, mode: str) -> DataFrame:
    return unique_targets(train.groupBy(*unit, cls).agg(F.count("*").alias("n")), unit, cap, mode)


def unique_targets(counts: DataFrame, unit: Sequence[str], cap: int, mode: str) -> DataFrame:
    """Class counts ``n`` per unit with ``target_unique`` and ``take_n``, what balancing asks for and gets."""
    smallest = F.min("n").over(W.partitionBy(*unit))
    target = F.least(F.lit(cap), smallest) if mode == "equal_unique_cap" else F.lit(cap)
    return counts.withColumn("target_unique", target.cast("bigint")).withColumn(
        "take_n", F.least(F.col("n"), F.col("target_unique"))
    )


# Augmentation groups, in order.
AUGMENTATION_GROUPS = {
    "geometric": ("rotate_small", "shift_small", "zoom_small", "horizontal_flip_safe"),
    "photometric": ("brightness_small", "contrast_small", "gamma_small"),
    "texture_noise": ("gaussian_noise_low", "blur_light", "sharpen_light"),
    "spatial": ("random_crop_pad_small", "affine_small"),
}


def group_pairs(ops: DataFrame) -> DataFrame:
    """Pairs of operations (op1, op2) from two different groups; ``ops`` has group g, place i and op."""
    first = ops.select(F.col("g").alias("g1"), F.col("i").alias("i1"), F.col("op").alias("op1"))
    second = ops.select(F.col("g").alias("g2"), F.col("i").alias("i2"), F.col("op").alias("op2"))
    return first.join(small_table(second)[0], F.col("g1") < F.col("g2"))


def op_pairs(spark, groups: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The pairs of a configured list of groups: (pair_no, op1, op2), in group and list order."""
    groups = AUGMENTATION_GROUPS if groups is None else groups
    ops = spark.createDataFrame(
        [(g, i, op) for g, names in enumerate(groups.values()) for i, op in enumerate(names)], "g INT, i INT, op STRING"
    )
    place = F.row_number().over(W.partitionBy().orderBy("g1", "g2", "i1", "i2"))
    return group_pairs(ops).select((place - 1).cast("bigint").alias("pair_no"), "op1", "op2")


def augmentation_plan(
    balanced: DataFrame, key: str, cls: str, unit: Sequence[str], target: Column, seed: int = 42,
    groups: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Draws with replacement of a base row and an operation pair, up to ``target`` rows per class.

    ``unit`` is (stage, repeat, fold). Draw numbers are a sequence per (unit, class); a draw meets its
    base row by an equi-join on the row's number. A class already at its target gets nothing.
    """
    stage, repeat, fold = unit
    group = [*unit, cls]
    sizes, _ = small_table(balanced.groupBy(*group).agg(F.count("*").alias("_base"), F.first(target).cast("bigint").alias("_target")))
    draws = sizes.withColumn("_need", F.greatest(F.col("_target") - F.col("_base"), F.lit(0))).where("_need > 0").withColumn(
        "_draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_need")))
    )
    name = [F.col(c).cast("string") for c in group] + [F.col("_draw").cast("string")]
    pairs = op_pairs(balanced.sparkSession, groups)
    n_pairs = pairs.count()
    draws = draws.withColumns({
        "_pick": S.hashed_index(F.concat_ws("|", F.lit(f"{seed}base"), *name), F.col("_base")) + 1,
        "_pair": S.hashed_index(F.concat_ws("|", F.lit(f"{seed}ops"), *name), F.lit(n_pairs)),
    }).drop("_base", "_target", "_need")
    hashed = seeded(seed, F.lit("draw"), *[F.col(u) for u in unit], F.col(key))
    base = numbered(
        balanced.withColumn("_h", hashed), group, F.substring("_h", 1, 1), [F.col("_h"), F.col(key)], "_pick"
    ).drop("_h")
    drawn = match(draws, base, [*group, "_pick"]).join(
        F.broadcast(pairs.select(F.col("pair_no").alias("_pair"), "op1", "op2")), "_pair"
    )
    source = F.col(key).cast("string")
    short = S.stable_id(F.concat_ws("_", source, F.col("op1"), F.col("op2")), 8)
    aug = S.augmentation_id(F.col(stage), F.col(repeat), F.col(fold), F.col(cls), F.col("_draw"), short)
    folder = F.concat(
        F.lit("augmented/stage_"), F.col(stage).cast("string"), F.lit("/repeat_"), F.col(repeat).cast("string"),
        F.lit("/fold_"), F.col(fold).cast("string"), F.lit("/"), F.col(cls), F.lit("/"),
    )
    return drawn.withColumns({
        "is_original": F.lit(False), "is_augmented": F.lit(True), "augmentation_id": aug,
        "augmentation_ops": F.concat_ws("+", "op1", "op2"), "base_source_id": source,
    }).withColumn("planned_output_path", F.concat(folder, F.col("augmentation_id"), F.lit(".png"))).drop(
        "_draw", "_pick", "_pair", "op1", "op2"
    )


def subset_index(assigned: DataFrame, unit: Sequence[str], cls: str, root: str = "subsets") -> DataFrame:
    """One row per unit: sizes, folders below ``root`` and class counts as JSON of its train and validation subset."""
    counts = assigned.groupBy(*unit, "subset", cls).agg(F.count("*").alias("n"))
    of = lambda s: F.col("subset") == s
    folder = F.concat(F.lit(f"{root}/"), F.concat_ws("/", *[F.concat(F.lit(f"{u}="), F.col(u).cast("string")) for u in unit]), F.lit("/subset="))
    sides = ("train", "validation")
    return counts.groupBy(*unit).agg(
        *[F.coalesce(F.sum(F.when(of(s), F.col("n"))), F.lit(0).cast("bigint")).alias(f"n_{s}_natural") for s in sides],
        *[class_json(cls, "n", of(s)).alias(f"{s}_class_count_json") for s in sides],
    ).withColumns({f"{s}_path": F.concat(folder, F.lit(s)) for s in sides})


def class_json(cls: str, n: str, where: Column | None = None) -> Column:
    """{class: n} text, classes in order; collects class counts, not rows. A null class counts with one that is named null."""
    entry = F.struct(F.coalesce(F.col(cls).cast("string"), F.lit("null")).alias("c"), F.col(n).cast("bigint").alias("n"))
    rows = F.collect_list(entry if where is None else F.when(where, entry))
    names = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["c"])))
    total = lambda c: F.aggregate(F.filter(rows, lambda r: r["c"] == c), F.lit(0).cast("bigint"), lambda acc, r: acc + r["n"])
    return F.to_json(F.map_from_arrays(names, F.transform(names, total)))


def subset_distribution(assigned: DataFrame, unit: Sequence[str], cls: str) -> DataFrame:
    """Count and share (a fraction) of each class within its unit's subset."""
    counts = assigned.groupBy(*unit, "subset", cls).agg(F.count("*").alias("count"))
    return counts.withColumn("percent", F.col("count") / F.sum("count").over(W.partitionBy(*unit, "subset")))


def size_summary(assigned: DataFrame, stage: str, unit: Sequence[str]) -> DataFrame:
    """Per stage: number of units, mean, least and greatest train and validation size."""
    sizes = assigned.groupBy(stage, *unit).agg(
        F.count_if(F.col("subset") == "train").alias("t"), F.count_if(F.col("subset") == "validation").alias("v")
    )
    return sizes.groupBy(stage).agg(
        F.count("*").alias("n_units"),
        F.avg("t").alias("mean_train"), F.min("t").alias("min_train"), F.max("t").alias("max_train"),
        F.avg("v").alias("mean_validation"), F.min("v").alias("min_validation"), F.max("v").alias("max_validation"),
    )


def split_deviation(full: DataFrame, part: DataFrame, cls: str) -> DataFrame:
    """Largest absolute difference between class percentages, rounded to two digits, of two frames."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(cls).agg(F.count("*").alias("n"))
        return n.select(cls, F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 2).alias(name))

    return match(shares(full, "full_pct"), shares(part, "part_pct"), [cls], "left").agg(
        F.max(F.abs(F.col("full_pct") - F.coalesce("part_pct", F.lit(0.0)))).alias("max_deviation")
    )
