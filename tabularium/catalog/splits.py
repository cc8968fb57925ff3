"""Splits, folds, balancing and curriculum plans on the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabularium.catalog import query
from tabularium.catalog.scans import scratch
from tabularium.operators import splits
from tabularium.plans import curriculum
from tabularium.session import cut_lineage
from tabularium.sources.manifest import select_unit

KEY, CLS, UNIT = "p_partkey", "p_type", curriculum.UNIT


def parts(t):
    return t.part.select(KEY, CLS)


def pick_sql(source: str, target: str, seed: int) -> str:
    """Every row of ``source`` with ``picked``: largest-remainder quotas filled in hash order."""
    return f"""(
  SELECT s.*, row_number() OVER (PARTITION BY s.p_type ORDER BY md5(concat_ws('|', '{seed}', CAST(s.p_partkey AS VARCHAR))), s.p_partkey) <= g.quota AS picked
  FROM {source} s JOIN (
    SELECT p_type, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, p_type) <= target - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM (
      SELECT p_type, target, n * target // total AS fl, n * target % total AS rest FROM (
        SELECT p_type, n, total, {target} AS target FROM (SELECT p_type, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY 1)))) g USING (p_type))"""


def fold_sql(source: str, k: int, repeats: int, seed: int) -> str:
    return f"""(
  SELECT p_partkey, p_type, CAST(rep AS INT) AS repeat_id, CAST(f AS INT) AS fold_id, CASE WHEN f = (rn - 1 + s) % {k} THEN 'validation' ELSE 'train' END AS subset
  FROM (SELECT p_partkey, p_type, rep, row_number() OVER (PARTITION BY rep, p_type ORDER BY
          md5(concat_ws('|', '{seed}', CAST(rep AS VARCHAR), CAST(p_partkey AS VARCHAR))), p_partkey) AS rn FROM {source}, range({repeats}) AS r(rep))
  JOIN (SELECT p_type, coalesce(sum(n) OVER (ORDER BY p_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT p_type, count(*) AS n FROM {source} GROUP BY 1)) USING (p_type), range({k}) AS q(f))"""


DOWN, UP = "total * {0} // 100", "(total * {0} + 99) // 100"
DEV = f"dev AS (SELECT p_partkey, p_type FROM {pick_sql('part', DOWN.format(90), 42)} WHERE picked)"


def development(t):
    """The development manifest, written once as the build's input."""
    return cut_lineage(splits.global_split(parts(t), KEY, CLS).where("split = 'development'").drop("split"))


@query("global_split", "W5", f"SELECT p_partkey, p_type, CASE WHEN picked THEN 'development' ELSE 'holdout_test' END AS split FROM {pick_sql('part', DOWN.format(90), 42)}")
def global_split(t):
    return splits.global_split(parts(t), KEY, CLS)


@query("split_sizes", "W5 A1", f"""
SELECT p_type, count(*) FILTER (WHERE picked) AS n_development, count(*) FILTER (WHERE NOT picked) AS n_holdout FROM {pick_sql('part', DOWN.format(90), 42)} GROUP BY 1
""")
def split_sizes(t):
    rows = splits.global_split(parts(t), KEY, CLS)
    dev = F.col("split") == "development"
    return rows.groupBy(CLS).agg(F.count_if(dev).alias("n_development"), F.count_if(~dev).alias("n_holdout"))


@query("stage_subset", "W6 P13", f"SELECT p_partkey, p_type, 2 AS stage_id, 0.25::DOUBLE AS stage_fraction FROM {pick_sql('part', DOWN.format(25), 44)} WHERE picked")
def stage_subset(t):
    return splits.stage_subset(parts(t), KEY, CLS, 25, 2)


@query("holdout_validation", "W7", f"SELECT p_partkey, p_type, CASE WHEN picked THEN 'validation' ELSE 'train' END AS subset, 0 AS repeat_id, 0 AS fold_id FROM {pick_sql('part', UP.format(20), 42)}")
def holdout_validation(t):
    return splits.holdout_validation(splits.require_two_classes(parts(t), CLS), KEY, CLS)


@query("repeated_folds", "W8", f"SELECT * FROM {fold_sql('part', 5, 3, 42)}")
def repeated_folds(t):
    return splits.folds(parts(t), KEY, CLS, 5, 3).select(KEY, CLS, "repeat_id", "fold_id", "subset")


@query("balanced_train", "B1", """
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), q AS (SELECT *, least(50, min(n) OVER (PARTITION BY p_brand)) AS take FROM c)
SELECT p_partkey, p_brand, p_type FROM part JOIN q USING (p_brand, p_type)
QUALIFY row_number() OVER (PARTITION BY p_brand, p_type ORDER BY md5(concat_ws('|', '42', 'balance', p_brand, CAST(p_partkey AS VARCHAR))), p_partkey) <= any_value(take) OVER (PARTITION BY p_brand, p_type)
""")
def balanced_train(t):
    """Every class cut to the smallest class of its brand, at most 50."""
    return splits.balance(t.part.select(KEY, "p_brand", CLS), KEY, CLS, ["p_brand"], 50).select(KEY, "p_brand", CLS)


@query("capped_train", "B1", """
SELECT p_partkey, p_type, true AS is_original, CAST(p_partkey AS VARCHAR) AS base_source_id FROM part
QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5(concat_ws('|', '42', 'balance', CAST(p_partkey AS VARCHAR))), p_partkey) <= 330
""")
def capped_train(t):
    return splits.balance(parts(t), KEY, CLS, [], 330, "cap_only").select(KEY, CLS, "is_original", "base_source_id")


def stage_sql() -> str:
    """All stages' assignments as CTEs ending in ``assigned``."""
    ctes, unions = [DEV], []
    for s in curriculum.STAGES:
        name = f"stage{s.stage_id}"
        if s.dev_percent == 100:
            ctes.append(f"{name} AS (SELECT p_partkey, p_type FROM dev)")
        else:
            ctes.append(f"{name} AS (SELECT p_partkey, p_type FROM {pick_sql('dev', DOWN.format(s.dev_percent), s.seed + s.stage_id)} WHERE picked)")
        if s.cv_mode == "holdout":
            unions.append(f"SELECT {s.stage_id} AS stage_id, p_partkey, p_type, 0 AS repeat_id, 0 AS fold_id, CASE WHEN picked THEN 'validation' ELSE 'train' END AS subset "
                          f"FROM {pick_sql(name, UP.format(s.val_percent), s.seed + s.stage_id)}")
        else:
            unions.append(f"SELECT {s.stage_id} AS stage_id, p_partkey, p_type, repeat_id, fold_id, subset FROM {fold_sql(name, s.n_splits, s.n_repeats, s.seed + s.stage_id)}")
    ctes.append("assigned AS (" + " UNION ALL ".join(unions) + ")")
    return "WITH " + ",\n".join(ctes)


def plan_sql() -> str:
    """Balanced originals and augmentation draws as CTEs ending in ``balanced`` and ``plan``."""
    targets = ", ".join(f"({s.stage_id}, {max(1, round(s.final_augmented_per_class * s.augmentation_fraction))})" for s in curriculum.STAGES)
    groups = list(splits.AUGMENTATION_GROUPS.values())
    pairs = [(a, b) for i, g in enumerate(groups) for h in groups[i + 1:] for a in g for b in h]
    listed = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(pairs))
    unit = "CAST(stage_id AS VARCHAR), CAST(repeat_id AS VARCHAR), CAST(fold_id AS VARCHAR)"
    part = "stage_id, repeat_id, fold_id, p_type"
    return stage_sql() + f""",
target AS (SELECT * FROM (VALUES {targets}) AS v(stage_id, target)), pairs AS (SELECT * FROM (VALUES {listed}) AS v(pair, op1, op2)),
sizes AS (SELECT *, least(210, min(n) OVER (PARTITION BY stage_id, repeat_id, fold_id)) AS target_unique FROM (
  SELECT {part}, count(*) AS n FROM assigned WHERE subset = 'train' GROUP BY ALL) JOIN target USING (stage_id)),
balanced AS (SELECT a.*, target_unique, target FROM assigned a JOIN sizes USING ({part}) WHERE subset = 'train'
  QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY md5(concat_ws('|', '42', 'balance', {unit}, CAST(p_partkey AS VARCHAR))), p_partkey) <= target_unique),
base AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY md5(concat_ws('|', '42', 'draw', {unit}, CAST(p_partkey AS VARCHAR))), p_partkey) AS pick FROM balanced),
draws AS (SELECT {part}, j, ('0x' || substr(md5(concat_ws('|', '42base', {unit}, p_type, CAST(j AS VARCHAR))), 1, 8))::BIGINT % target_unique + 1 AS pick,
  ('0x' || substr(md5(concat_ws('|', '42ops', {unit}, p_type, CAST(j AS VARCHAR))), 1, 8))::BIGINT % {len(pairs)} AS pair
  FROM sizes, LATERAL (SELECT unnest(range(1, greatest(target - target_unique, 0) + 1)) AS j)),
plan AS (SELECT stage_id, repeat_id, fold_id, p_type, p_partkey, concat_ws('+', op1, op2) AS augmentation_ops,
  concat('S', stage_id, '_R', repeat_id, '_F', fold_id, '_', p_type, '_', printf('%05d', j), '_', substr(sha1(concat_ws('_', CAST(p_partkey AS VARCHAR), op1, op2)), 1, 8)) AS augmentation_id
  FROM draws JOIN base USING ({part}, pick) JOIN pairs USING (pair))
"""


def assigned(t):
    return curriculum.assignments(development(t), KEY, CLS)


@query("curriculum_assignments", "B3 B4 S10 U1", stage_sql() + " SELECT stage_id, repeat_id, fold_id, subset, p_partkey, p_type FROM assigned")
def curriculum_assignments(t):
    return assigned(t).select(*UNIT, "subset", KEY, CLS)


@query("curriculum_sizes", "A20", stage_sql() + """
, z AS (SELECT stage_id, repeat_id, fold_id, count(*) FILTER (WHERE subset = 'train') AS t, count(*) FILTER (WHERE subset = 'validation') AS v FROM assigned GROUP BY ALL)
SELECT stage_id, count(*) AS n_units, avg(t) AS mean_train, min(t) AS min_train, max(t) AS max_train, avg(v) AS mean_validation,
       min(v) AS min_validation, max(v) AS max_validation FROM z GROUP BY 1
""")
def curriculum_sizes(t):
    return splits.size_summary(assigned(t), "stage_id", ["repeat_id", "fold_id"])


@query("curriculum_metadata", "B3 A21 S10", plan_sql() + """
SELECT stage_id, repeat_id, fold_id, CAST(any_value(target_unique) AS BIGINT) AS target_unique_equal_cap, CAST(sum(target_unique) AS BIGINT) AS n_train_unique_after_balance,
  CAST(sum(greatest(target - target_unique, 0)) AS BIGINT) AS n_augmented_rows, '{' || string_agg('"' || p_type || '":' || target_unique, ',' ORDER BY p_type) || '}' AS actual_per_class
FROM sizes GROUP BY ALL
""")
def curriculum_metadata(t):
    return curriculum.metadata_of(curriculum.class_counts(development(t), KEY, CLS), CLS).select(
        *UNIT, "target_unique_equal_cap", "n_train_unique_after_balance", "n_augmented_rows", "actual_per_class"
    )


@query("augmentation_plan", "B2 J13 F6 F8 F9", plan_sql() + "SELECT stage_id, repeat_id, fold_id, p_type, p_partkey, augmentation_ops, augmentation_id FROM plan")
def augmentation_plan(t):
    _, plan, _ = curriculum.train_plan(assigned(t), KEY, CLS)
    return plan.select(*UNIT, CLS, KEY, "augmentation_ops", "augmentation_id")


@query("plan_integrity", "A31 P17 U1", plan_sql() + """
, b AS (SELECT stage_id, count(*) AS n_original FROM balanced GROUP BY 1), p AS (SELECT stage_id, count(*) AS n_augmented FROM plan GROUP BY 1)
SELECT stage_id, n_original, coalesce(n_augmented, 0) AS n_augmented, true AS augmented_paths_ok, true AS original_paths_ok FROM b LEFT JOIN p USING (stage_id)
""")
def plan_integrity(t):
    """Originals and augmented rows per stage; only augmented rows may point below ``augmented/``."""
    _, _, combined = curriculum.train_plan(assigned(t), KEY, CLS)
    below = F.coalesce(F.col("planned_output_path").rlike("(^|/)augmented/"), F.lit(False))
    return combined.groupBy("stage_id").agg(
        F.count_if("is_original").alias("n_original"), F.count_if("is_augmented").alias("n_augmented"),
        F.bool_and(~F.col("is_augmented") | below).alias("augmented_paths_ok"), F.bool_and(~F.col("is_original") | ~below).alias("original_paths_ok"),
    )


@query("curriculum_build", "B4 S8 S9 S10", plan_sql() + """
, train AS (SELECT p_partkey, p_type FROM balanced WHERE stage_id = 3 AND repeat_id = 0 AND fold_id = 1
            UNION ALL SELECT p_partkey, p_type FROM plan WHERE stage_id = 3 AND repeat_id = 0 AND fold_id = 1)
SELECT p_type, count(*) AS n_rows, CAST(sum(p_partkey) AS BIGINT) AS key_sum FROM train GROUP BY 1
""")
def curriculum_build(t):
    """The whole build written as partitioned tables, then one unit's train plan read with pruning."""
    places = curriculum.build(development(t), KEY, CLS, scratch(t.spark, "curriculum"))
    plan = select_unit(t.spark.read.parquet(places["train_plan"]), stage_id=3, repeat_id=0, fold_id=1)
    return plan.groupBy(CLS).agg(F.count("*").alias("n_rows"), F.sum(KEY).alias("key_sum"))


@query("split_deviation", "A28", f"""
WITH {DEV}, f AS (SELECT p_type, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS a FROM part GROUP BY 1),
p AS (SELECT p_type, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS b FROM dev GROUP BY 1)
SELECT round(max(abs(a - coalesce(b, 0))), 6) AS max_deviation FROM f LEFT JOIN p USING (p_type)
""")
def split_deviation(t):
    return splits.split_deviation(parts(t), development(t), CLS).select(F.round("max_deviation", 6).alias("max_deviation"))


@query("stage_targets", "A30 F14", "SELECT stage_id, target AS target_per_class, target * n AS target_total FROM (VALUES (1, 50::BIGINT), (2, 250), (3, 500), (4, 1000), (5, 1000)) AS v(stage_id, target), "
       "(SELECT count(DISTINCT p_type) AS n FROM part)")
def stage_targets(t):
    classes = t.part.agg(F.count_distinct(CLS).alias("n"))
    rows = curriculum.stage_table(t.spark).join(F.broadcast(classes))
    return rows.select("stage_id", "target_per_class", (F.col("target_per_class") * F.col("n")).alias("target_total"))
