"""Exact and near-duplicate marking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabularium.operators.skew import join_unique, small_table
from tabularium.session import cut_lineage


def is_error_hash(hashed: str) -> Column:
    return F.col(hashed).startswith("ERROR::")


def mark_exact(df: DataFrame, key: str, hashed: str, order: Sequence[str]) -> DataFrame:
    """``is_duplicate`` and ``duplicate_of``: the first row of a hash, in ``order``, is kept.

    The first row is a map-side combined minimum, so a hash shared by a third of the table is one
    small row per partition before any shuffle; ``join_unique`` then brings it back by broadcast.
    """
    usable = df.where(~is_error_hash(hashed) & F.col(hashed).isNotNull())
    position = F.struct(*[F.col(c) for c in order], F.col(key))
    firsts = usable.groupBy(hashed).agg(F.min(position)[key].alias("_first"), F.count("*").alias("_copies"))
    marked = join_unique(usable, firsts, [hashed], "_copies")
    marked = (
        marked.withColumn("is_duplicate", F.col(key) != F.col("_first"))
        .withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("_first")))
        .select(*df.columns, "is_duplicate", "duplicate_of")
    )
    errors = df.where(is_error_hash(hashed) | F.col(hashed).isNull())
    errors = errors.select(
        *df.columns, F.lit(False).alias("is_duplicate"),
        F.lit(None).cast(df.schema[key].dataType).alias("duplicate_of"),
    )
    return marked.unionByName(errors)


def first_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``, as a combined minimum instead of a ranking window."""
    rest = [c for c in df.columns if c not in order]
    row = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(F.col(key).alias("_k")).agg(row).select(*[F.col("_row")[c].alias(c) for c in df.columns])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(
    hashes: DataFrame, key: str, bits: str, threshold: int, blocks: int | None = None, bucket_rows: int = 20_000
) -> DataFrame:
    """All pairs of distinct 64-bit hashes at Hamming distance <= ``threshold``: (a, b, distance), a < b.

    The hash is cut into ``blocks`` pieces. A pair within the threshold differs in at most
    ``threshold`` pieces, so it agrees on some choice of ``blocks - threshold`` of them; each choice is
    a table of equi-join keys, and a pair is reported only by the first choice it agrees on. Buckets
    above ``bucket_rows`` are divided into a triangle of smaller joins.
    """
    blocks = blocks or threshold + 3
    if blocks <= threshold:
        raise ValueError("blocks must exceed the threshold")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    choices = []
    for chosen in combinations(range(blocks), blocks - threshold):
        mask = reduce(lambda x, y: x | y, [masks[i] for i in chosen])
        choices.append(mask)
    probes = F.array(*[
        F.struct(F.lit(i).alias("_choice"), F.col("_bits").bitwiseAND(F.lit(m)).alias("_part"))
        for i, m in enumerate(choices)
    ])
    rows = (
        hashes.select(F.col(key).alias("_key"), F.col(bits).alias("_bits"))
        .select("_key", "_bits", F.explode(probes).alias("_p"))
        .select("_key", "_bits", "_p._choice", "_p._part")
    )
    sizes = rows.groupBy("_choice", "_part").agg(F.count("*").alias("_n")).where("_n > 1")
    crowded = sizes.where(F.col("_n") > bucket_rows).select("_choice", "_part", F.ceil(F.col("_n") / bucket_rows).cast("int").alias("_slices"))
    rows = rows.join(small_table(crowded)[0], ["_choice", "_part"], "left").withColumn(
        "_slices", F.coalesce("_slices", F.lit(1))
    )
    slice_ = F.pmod(F.xxhash64("_key"), F.col("_slices")).cast("int")
    rows = rows.withColumn("_slice", slice_)
    left = rows.withColumn("_other", F.explode(F.sequence(F.col("_slice"), F.col("_slices") - 1)))
    right = rows.withColumn("_mine", F.explode(F.sequence(F.lit(0), F.col("_slice"))))
    left = left.select("_choice", "_part", F.col("_slice").alias("_s"), F.col("_other").alias("_t"),
                       F.col("_key").alias("x"), F.col("_bits").alias("xb"))
    right = right.select("_choice", "_part", F.col("_mine").alias("_s"), F.col("_slice").alias("_t"),
                         F.col("_key").alias("y"), F.col("_bits").alias("yb"))
    first_choice = F.coalesce(*[
        F.when(F.col("xb").bitwiseAND(F.lit(m)) == F.col("yb").bitwiseAND(F.lit(m)), F.lit(i))
        for i, m in enumerate(choices)
    ])
    once = (F.col("_s") < F.col("_t")) | (F.col("x") < F.col("y"))
    return (
        left.join(right, ["_choice", "_part", "_s", "_t"])
        .where(once & (hamming(F.col("xb"), F.col("yb")) <= threshold) & (first_choice == F.col("_choice")))
        .select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
            hamming(F.col("xb"), F.col("yb")).cast("int").alias("distance"),
        )
    )


FEW_EDGES = 2_000_000  # undecided pairs that one task settles in order
ROUNDS = 3  # rounds of local minima before their progress is looked at


def _in_order(edges: DataFrame) -> DataFrame:
    """Ends that are dropped, by walking pairs in the order of their late end; a partition holds whole components and only what it has dropped."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone: set[int] = set()
        for batch in batches:
            out = []
            for early, late in zip(batch.column("early").to_pylist(), batch.column("late").to_pylist(), strict=True):
                if early not in gone and late not in gone:
                    gone.add(late)
                    out.append(late)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["late"])

    return edges.sortWithinPartitions("late_pos", "late").select("early", "late").mapInArrow(walk, "late long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of the part that pairs (early, late) connect, by least labels and shortcuts, which double their reach."""
    both = edges.select(F.col("early").alias("node"), F.col("late").alias("other")).unionByName(edges.select(F.col("late").alias("node"), F.col("early").alias("other")))
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("now"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("now"), F.col("component").alias("then"))
        after = cut_lineage(step.join(jump, "now").select("node", F.least("now", "then").alias("component"), "was"))
        labels = after.drop("was")
        if not after.where("component <> was").limit(1).count():
            return labels


def dropped(edges: DataFrame, few: int = FEW_EDGES, rounds: int = ROUNDS) -> DataFrame:
    """Late ends of pairs (early, late, late_pos) whose early end, or another's, is retained: the first-in-order independent set's complement.

    While there are more than ``few`` undecided pairs, rounds settle all local minima at once: an early end that is late in no
    undecided pair is retained, and what it touches is dropped. Where that does not bring them down, components of few pairs are
    settled in order inside tasks, and only larger ones go on. What is left when few pairs are undecided is settled in one task.
    """
    parts, n = [], edges.count()
    while n > few:
        before = n
        for _ in range(rounds):
            kept = edges.join(edges.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
            gone = cut_lineage(kept.select("late").distinct())
            parts.append(gone)
            edges = cut_lineage(edges.join(gone, "late", "left_anti").join(gone.withColumnRenamed("late", "early"), "early", "left_anti"))
        n = edges.count()
        if few < n and 2 * n > before:
            placed = edges.join(components(edges).withColumnRenamed("node", "early"), "early")
            sizes = placed.groupBy("component").agg(F.count("*").alias("_n"))
            large = cut_lineage(sizes.where(F.col("_n") > few).select("component"))
            parts.append(cut_lineage(_in_order(placed.join(large, "component", "left_anti").repartition("component"))))
            edges = cut_lineage(placed.join(large, "component", "left_semi").drop("component"))
            n = edges.count()
    if n:
        parts.append(cut_lineage(_in_order(edges.coalesce(1))))
    return reduce(DataFrame.unionByName, parts) if parts else edges.select("late")


def mark_near(df: DataFrame, key: str, bits: str, order: Sequence[str], threshold: int, blocks: int | None = None, few: int = FEW_EDGES) -> DataFrame:
    """Greedy near-duplicate marking: a row duplicates the first earlier *retained* row within the threshold.

    Rows of one hash behave alike, so pairs are sought between distinct hashes only.
    """
    position = F.struct(*[F.col(c) for c in order], F.col(key))
    heads = cut_lineage(
        df.groupBy(bits).agg(F.min(position).alias("_pos"), F.count("*").alias("_copies"))
    )
    pairs = near_pairs(heads, bits, bits, threshold, blocks)
    pos = heads.select(F.col(bits).alias("_h"), F.col("_pos"))
    first = F.col("_pa") < F.col("_pb")
    edges = cut_lineage(
        pairs.join(pos.select(F.col("_h").alias("a"), F.col("_pos").alias("_pa")), "a")
        .join(pos.select(F.col("_h").alias("b"), F.col("_pos").alias("_pb")), "b")
        .select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.least("_pa", "_pb").alias("early_pos"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"), F.greatest("_pa", "_pb").alias("late_pos"),
        )
    )
    gone = dropped(edges.select("early", "late", "late_pos"), few)
    retained = edges.join(gone.withColumnRenamed("late", "early"), "early", "left_anti")
    by = retained.groupBy(F.col("late").alias(bits)).agg(F.min("early_pos")[key].alias("_target"))
    heads = heads.join(by, bits, "left").withColumn("_rep", F.coalesce("_target", F.col("_pos")[key]))
    marked = join_unique(df, heads.select(bits, "_rep", "_copies"), [bits], "_copies")
    return (
        marked.withColumn("is_duplicate", F.col(key) != F.col("_rep"))
        .withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("_rep")))
        .drop("_rep", "_copies")
    )


def two_pass(df: DataFrame, key: str, order: Sequence[str], first_hash: Column, normalise, second_hash: Column) -> DataFrame:
    """Hash, keep firsts, normalise, hash again, keep firsts. Nothing is deleted from storage.

    Each pass marks (key, order, hash) rows only; the wide rows are met again by a semi join on the key.
    """

    def keep(rows: DataFrame, hashed: Column) -> DataFrame:
        slim = cut_lineage(rows.select(key, *order, hashed.alias("_hash")))
        firsts = mark_exact(slim, key, "_hash", order).where("not is_duplicate").select(key)
        return rows.join(firsts, key, "left_semi")

    return keep(normalise(keep(df, first_hash)), second_hash)
