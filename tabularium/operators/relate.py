"""Checked joins, reconciliation and rule reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabularium.session import cut_lineage


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails when either side repeats a key."""
    for side, frame in (("left", left), ("right", right)):
        twice = duplicate_keys(frame, [key]).limit(5).collect()
        if twice:
            raise ValueError(f"{side} side repeats {key}: {[r[key] for r in twice]}")
    return left.join(right, key, "left")


def label_conflicts(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    other = right.select(key, F.col(label).alias("other_label"))
    return (
        left.select(key, label).join(other, key)
        .where(~F.col(label).eqNullSafe(F.col("other_label")))
    )


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys present on one side only, found in one aggregation instead of two anti joins."""
    both = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = both.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_r") == 0, "left_only").otherwise("right_only")
    return sides.where("_l + _r = 1").select(key, side.alias("side"))


def shared_sources(assigned: DataFrame, unit: Sequence[str], source: str, subset: str) -> DataFrame:
    """Number of sources found in more than one subset of a unit, for all units in one pass."""
    per_source = assigned.groupBy(*unit, source).agg(
        (F.min(subset) != F.max(subset)).alias("_leaks")
    )
    return per_source.groupBy(*unit).agg(F.count_if("_leaks").alias("n_shared"))


def require_no_overlap(assigned: DataFrame, unit: Sequence[str], source: str, subset: str) -> DataFrame:
    bad = shared_sources(assigned, unit, source, subset).where("n_shared > 0").limit(5).collect()
    if bad:
        raise ValueError(f"sources shared between subsets: {[r.asDict() for r in bad]}")
    return assigned


def attach_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Column-wise concatenation, aligned on the key."""
    return left.join(right, key)


def restore_order(results: DataFrame, manifest: DataFrame, key: str, position: str) -> DataFrame:
    return results.join(manifest.select(key, position), key).orderBy(position)


def enum_rule(column: str, allowed: Sequence[str], nullable: bool) -> Column:
    ok = F.col(column).isin(*allowed)
    return F.coalesce(ok, F.lit(nullable))


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) for each broken rule; a rule that evaluates to null holds, as in a CHECK constraint."""
    broken = F.array_compact(F.array(*[
        F.when(F.coalesce(rule, F.lit(True)), F.lit(None)).otherwise(F.lit(name)) for name, rule in rules.items()
    ]))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def orphans(child: DataFrame, foreign: str, parent: DataFrame, primary: str) -> DataFrame:
    """Child rows whose non-null reference has no parent."""
    known = parent.select(F.col(primary).alias(foreign)).distinct()
    return child.where(F.col(foreign).isNotNull()).join(known, foreign, "left_anti")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def readiness(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """OK or MISSING per required column name."""
    have = set(df.columns)
    rows = [(name, "OK" if name in have else "MISSING") for name in required]
    return df.sparkSession.createDataFrame(rows, "name STRING, state STRING")


def policy_listing(policies: DataFrame, stage: str, wanted: Sequence[int], required: Sequence[str]) -> DataFrame:
    """The policies of the wanted stages, each OK, or INCOMPLETE if a required setting is null; a stage without a policy is MISSING.

    The wanted stages are few and are sent to the policies; a stage named twice is listed once, policies of a null stage are not listed.
    """
    kind = policies.schema[stage].dataType.simpleString()
    stages = F.broadcast(policies.sparkSession.createDataFrame([(w,) for w in sorted(set(wanted))], "_stage BIGINT").select(F.col("_stage").cast(kind).alias(stage)))
    found = cut_lineage(policies.join(stages, stage, "left_semi"))
    whole = F.lit(True)
    for name in required:
        whole &= F.col(name).isNotNull()
    listed = found.withColumn("state", F.when(whole, "OK").otherwise("INCOMPLETE"))
    absent = stages.join(found.select(stage).distinct(), stage, "left_anti").withColumn("state", F.lit("MISSING"))
    return listed.unionByName(absent, allowMissingColumns=True)


def column_listing(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Type and nullability of each required column beside its readiness; null for a missing one."""
    have = {f.name: f for f in df.schema}
    rows = [(n, have[n].dataType.simpleString() if n in have else None, have[n].nullable if n in have else None, "OK" if n in have else "MISSING") for n in required]
    return df.sparkSession.createDataFrame(rows, "name STRING, data_type STRING, nullable BOOLEAN, state STRING")


def require_same_count(left: DataFrame, right: DataFrame, what: str) -> None:
    counts = left.agg(F.count("*").alias("n")).unionAll(right.agg(F.count("*").alias("n"))).collect()
    if counts[0][0] != counts[1][0]:
        raise ValueError(f"{what}: {counts[0][0]} rows against {counts[1][0]}")


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
