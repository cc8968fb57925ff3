"""Curriculum build: all stages, repeats and folds as one set of plans keyed by (stage, repeat, fold)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabularium.operators import splits
from tabularium.operators.relate import require_no_overlap
from tabularium.session import cut_lineage, spread

UNIT = ["stage_id", "repeat_id", "fold_id"]


@dataclass(frozen=True)
class Stage:
    stage_id: int
    stage_name: str
    dev_percent: int
    epoch: int
    cv_mode: str
    n_splits: int = 5
    n_repeats: int = 1
    val_percent: int = 20
    final_augmented_per_class: int = 1000
    augmentation_fraction: float = 1.0
    max_unique_per_class: int = 210
    seed: int = 42


# The default stages.
STAGES = (
    Stage(1, "Sanity Test", 5, 2, "holdout", augmentation_fraction=0.05),
    Stage(2, "Warm Start", 25, 10, "holdout", augmentation_fraction=0.25),
    Stage(3, "Tuning for Convergence", 50, 25, "kfold", augmentation_fraction=0.50),
    Stage(4, "Tuning for Max Accuracy", 100, 50, "kfold"),
    Stage(5, "Final Repeated K-Fold Evaluation", 100, 100, "repeated_kfold", n_repeats=5),
)


def stage_table(spark: SparkSession, stages=STAGES, n_classes: int = 10) -> DataFrame:
    """Configured stages with the derived target per class (half to even, at least 1) and in total."""
    rows = [
        (s.stage_id, s.stage_name, s.dev_percent / 100, s.epoch, s.cv_mode, s.n_splits, s.n_repeats,
         s.final_augmented_per_class, s.augmentation_fraction)
        for s in stages
    ]
    table = spark.createDataFrame(
        rows, "stage_id INT, stage_name STRING, dev_fraction DOUBLE, epoch INT, cv_mode STRING, n_splits INT, "
        "n_repeats INT, final_augmented_per_class INT, augmentation_fraction DOUBLE"
    )
    target = F.greatest(F.lit(1), F.bround(F.col("final_augmented_per_class") * F.col("augmentation_fraction"), 0).cast("bigint"))
    return table.withColumn("target_per_class", target).withColumn("target_total", F.col("target_per_class") * n_classes)


def _kept(dev: DataFrame, key: str, cls: str, stages) -> tuple[DataFrame, DataFrame]:
    """Rows each stage keeps, and those of holdout stages with their subset."""
    for s in stages:
        if s.cv_mode not in ("holdout", "kfold", "repeated_kfold"):
            raise ValueError(f"unknown cv_mode {s.cv_mode}")
        if not 0 < s.dev_percent <= 100:
            raise ValueError("the stage share must be in (0, 100] percent")
    rows = [
        (s.stage_id, s.dev_percent, s.val_percent, s.seed + s.stage_id, s.cv_mode == "holdout", s.n_splits,
         s.n_repeats if s.cv_mode == "repeated_kfold" else 1)
        for s in stages
    ]
    names = ("stage_id", "_dev", "_val", "_seed", "_holdout", "_splits", "_repeats")
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    many = spread(dev).select("*", F.inline(listed))  # a row is hashed for each of its units, so a small file is work for all cores
    partial = splits.stratified_pick(
        many.where("_dev < 100"), key, cls, F.expr("total * _dev div 100"), F.col("_seed"), ["stage_id", "_dev"]
    )
    kept = cut_lineage(partial.unionByName(many.where("_dev = 100")))
    held = splits.holdout_validation(
        kept.where("_holdout"), key, cls, F.expr("(total * _val + 99) div 100"), F.col("_seed"), ["stage_id", "_val"]
    )
    return kept, held


def assignments(dev: DataFrame, key: str, cls: str, stages=STAGES) -> DataFrame:
    """Every (stage, repeat, fold, item) with its subset, for all stages in one pass.

    Development rows meet the short list of stages, each stage keeps its share by quota, and the kept
    rows - written once, since holdout and fold stages both read them - get their subset.
    """
    kept, held = _kept(dev, key, cls, stages)
    folded = splits.folds(
        kept.where("not _holdout"), key, cls, F.col("_splits"), F.col("_repeats"), F.col("_seed"), ["stage_id"]
    )
    fraction = (F.col("_dev") / 100).alias("stage_fraction")
    columns = [*dev.columns, "stage_id", "repeat_id", "fold_id", "subset"]
    return held.select(*columns, fraction).unionByName(folded.select(*columns, fraction))


def class_counts(dev: DataFrame, key: str, cls: str, stages=STAGES) -> DataFrame:
    """Class counts ``n`` of every unit's subsets. Those of folds follow from each stage's counts, so no item is placed to count it."""
    kept, held = _kept(dev, key, cls, stages)
    held = held.groupBy(*UNIT, "subset", cls).agg(F.count("*").alias("n"))
    per = kept.where("not _holdout").groupBy("stage_id", "_splits", "_repeats", cls).agg(F.count("*").alias("_total"))
    folded = splits.fold_counts(per, cls, "_total", F.col("_splits"), ["stage_id", "_repeats"])
    folded = folded.withColumn("repeat_id", F.explode(F.sequence(F.lit(0), F.col("_repeats") - 1)))
    columns = [*UNIT, "subset", cls, "n"]
    return held.select(*columns).unionByName(folded.select(*columns))


def train_plan(assigned: DataFrame, key: str, cls: str, stages=STAGES, mode: str = "equal_unique_cap", seed: int = 42):
    """(balanced originals, augmentation rows, combined) for every unit at once."""
    spark = assigned.sparkSession
    targets = F.broadcast(stage_table(spark, stages).select("stage_id", "target_per_class"))
    train = assigned.where("subset = 'train'").join(targets, "stage_id")
    balanced = cut_lineage(splits.balance(train, key, cls, UNIT, stages[0].max_unique_per_class, mode, seed))
    plan = splits.augmentation_plan(balanced, key, cls, UNIT, F.col("target_per_class"), seed)
    combined = balanced.unionByName(plan, allowMissingColumns=True)
    return balanced, plan, combined


def metadata(assigned: DataFrame, key: str, cls: str, stages=STAGES, mode: str = "equal_unique_cap") -> DataFrame:
    """One row per unit. Sizes of the plan follow from class counts, so no plan row is built to count it."""
    return metadata_of(assigned.groupBy(*UNIT, "subset", cls).agg(F.count("*").alias("n")), cls, stages, mode)


def metadata_of(counts: DataFrame, cls: str, stages=STAGES, mode: str = "equal_unique_cap") -> DataFrame:
    """``metadata`` from ``class_counts``."""
    spark = counts.sparkSession
    cap = stages[0].max_unique_per_class
    sizes = splits.unique_targets(counts.where("subset = 'train'"), UNIT, cap, mode)
    table = stage_table(spark, stages)
    joined = sizes.join(F.broadcast(table), "stage_id").withColumn(
        "_extra", F.greatest(F.col("target_per_class") - F.col("take_n"), F.lit(0))
    )
    return joined.groupBy(*UNIT).agg(
        F.first("stage_name").alias("stage_name"), F.first("cv_mode").alias("cv_mode"),
        F.first("dev_fraction").alias("stage_dev_fraction"),
        F.first("target_per_class").alias("augmented_target_per_class"),
        F.first("augmentation_fraction").alias("augmentation_fraction_of_final"),
        F.lit(mode).alias("balance_mode"), F.lit(cap).cast("bigint").alias("max_unique_per_class"),
        F.max("target_unique").alias("target_unique_equal_cap"),
        splits.class_json(cls, "take_n").alias("actual_per_class"),
        F.sum("take_n").alias("n_train_unique_after_balance"), F.sum("_extra").alias("n_augmented_rows"),
        F.sum(F.col("take_n") + F.col("_extra")).alias("n_train_total_after_plan"),
    )


def build(
    dev: DataFrame, key: str, cls: str, out: str, stages=STAGES, mode: str = "equal_unique_cap", source: str | None = None
) -> dict[str, str]:
    """Write assignments and combined plans partitioned by unit, then the small tables beside them.

    No ``source`` may be on both sides of a unit: rows of one origin share it. It defaults to the manifest's ``source_id``; without either
    there is nothing to guard, since a key has one place in a unit.
    """
    spark = dev.sparkSession
    splits.require_two_classes(dev, cls)
    places = {n: f"{out}/{n}" for n in ("assignments", "train_plan", "metadata", "index", "distribution")}
    assignments(dev, key, cls, stages).write.mode("overwrite").partitionBy(*UNIT, "subset").parquet(places["assignments"])
    assigned = spark.read.parquet(places["assignments"])
    source = source or ("source_id" if "source_id" in dev.columns else None)
    if source is not None:
        require_no_overlap(assigned, UNIT, source, "subset")
    _, _, combined = train_plan(assigned, key, cls, stages, mode)
    combined.write.mode("overwrite").partitionBy(*UNIT).parquet(places["train_plan"])
    metadata(assigned, key, cls, stages, mode).write.mode("overwrite").parquet(places["metadata"])
    splits.subset_index(assigned, UNIT, cls, places["assignments"]).write.mode("overwrite").parquet(places["index"])
    splits.subset_distribution(assigned, UNIT, cls).write.mode("overwrite").parquet(places["distribution"])
    return places
