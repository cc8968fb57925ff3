"""Building blocks that keep hot groups out of any single task.

Every per-group operator of the package is written on top of these:

* ``small_table``      broadcast only after counting, plain join beyond the bound;
* ``join_unique``      equi-join against unique keys with the heaviest keys taken out of the shuffle;
* ``numbered``         dense row numbers inside a group, sorted bucket by bucket;
* ``take_smallest``    n rows per group by a hash order, shuffling only the boundary bucket;
* ``mark_smallest``    the same as a flag on every row;
* ``with_next``, ``with_earlier_min``  ordered look-ups, sorted bucket by bucket;
* ``value_ranks``      ranks and prefix counts of distinct values, cut into ranges;
* ``grouped_quantiles``  exact interpolated quantiles, by radix selection for large groups.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql import Window as W

from tabularium.operators import radix

SMALL_ROWS = 200_000
SMALL_BYTES = 64 << 20
HOT_KEYS = 1_000
GROUP_ROWS = 4_000_000
QUANTILE_VALUES = 1_000_000


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate ``df`` once if it has at most ``max_rows`` rows and ``SMALL_BYTES``, and mark it for broadcast.

    A larger frame comes back untouched, so that the join that follows is a shuffle join. Where rows hold
    arrays, a few of them tell how many may be fetched.
    """
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.BinaryType)) for f in df.schema):
        few = df.limit(64).toArrow()
        max_rows = min(max_rows, int(SMALL_BYTES // max(1, few.nbytes // max(1, few.num_rows))))
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > SMALL_BYTES:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema)), True


def join_unique(
    left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, how: str = "inner"
) -> DataFrame:
    """Join rows to a frame that is unique on ``keys`` and carries the key's row count in ``weight``.

    The ``HOT_KEYS`` heaviest keys are joined by broadcast (that many rows at most); every other key
    then holds less than 1/``HOT_KEYS`` of the rows and goes through an ordinary shuffle join.
    """
    keys = list(keys)
    order = [F.col(weight).desc(), *[F.col(k).asc_nulls_last() for k in keys]]
    hot = right.where(F.col(weight) > 1).orderBy(*order).limit(HOT_KEYS)
    hot_keys = F.broadcast(hot.select(*keys))
    heavy = left.join(F.broadcast(hot), keys, "inner")
    light = left.join(hot_keys, keys, "left_anti").join(right, keys, how)
    return heavy.unionByName(light)


def match(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null group matches a null group, so that no row is lost to its group."""
    by = list(by)
    if not by:
        return left.crossJoin(right) if how != "left" else left.join(right, F.lit(True), "left")
    other = right.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return left.join(other, same, how).drop(*[f"__{c}" for c in by])


def hash_bucket(hashed: Column, digits: int = 3) -> Column:
    """Leading hex digits of a hash: an order-preserving bucket of near-equal sizes."""
    return F.substring(hashed, 1, digits)


def numbered(
    df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """Row number from 1 inside each ``by`` group, in ``order``.

    ``bucket`` must be non-decreasing along ``order``. Only one bucket is ever sorted in one task;
    bucket sizes turn into offsets on an aggregate of (groups x buckets) rows.
    """
    by = list(by)
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets, _ = small_table(
        sizes.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .transform(match, offsets, [*by, "_bucket"])
        .withColumn(name, (F.col("_inside") + F.col("_offset")).cast("bigint"))
        .drop("_bucket", "_inside", "_offset")
    )


def _boundary(
    df: DataFrame, by: Sequence[str], quotas: DataFrame, quota: str, hashed: Column, digits: int
) -> tuple[DataFrame, DataFrame]:
    """Rows with their hash bucket, and per group the bucket in which the quota is reached."""
    df = df.withColumn("_hash", hashed).withColumn("_bucket", hash_bucket(F.col("_hash"), digits))
    sizes = df.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .transform(match, quotas.select(*by, F.col(quota).alias("_quota")), by)
        .where("_before < _quota")
        .groupBy(*by)
        .agg(F.max("_bucket").alias("_cut"), F.min(F.col("_quota") - F.col("_before")).alias("_rest"))
    )
    return df, small_table(cuts)[0]


def take_smallest(
    df: DataFrame, by: Sequence[str], quotas: DataFrame, quota: str, hashed: Column, ties: Sequence[Column], digits: int = 3
) -> DataFrame:
    """The ``quota`` rows with the smallest hash in each group.

    A histogram over leading hash digits finds the bucket in which the quota is reached: rows of
    earlier buckets pass without a shuffle, and only the boundary bucket is ranked.
    """
    by = list(by)
    df, cuts = _boundary(df, by, quotas, quota, hashed, digits)
    kept = match(df, cuts, by)
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_hash", *ties))
    edge = kept.where("_bucket = _cut").withColumn("_rank", rank).where("_rank <= _rest").drop("_rank")
    return kept.where("_bucket < _cut").unionByName(edge).drop("_hash", "_bucket", "_cut", "_rest")


def last_taken(df: DataFrame, by: Sequence[str], quotas: DataFrame, quota: str, hashed: Column, key: str, digits: int = 3) -> DataFrame:
    """The last (hash, key) that ``take_smallest`` would take in each group, as ``_last``."""
    by = list(by)
    df, cuts = _boundary(df, by, quotas, quota, hashed, digits)
    edge = match(df.select(*by, "_hash", "_bucket", F.col(key).alias("_key")), cuts, by).where("_bucket = _cut")
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_hash", "_key"))
    return edge.withColumn("_rank", rank).where("_rank <= _rest").groupBy(*by).agg(F.max(F.struct("_hash", "_key")).alias("_last"))


def mark_smallest(
    df: DataFrame, by: Sequence[str], quotas: DataFrame, quota: str, hashed: Column, ties: Sequence[Column],
    name: str, digits: int = 4,
) -> DataFrame:
    """Every row, with ``name`` true for the rows ``take_smallest`` would take; same cost."""
    by = list(by)
    df, cuts = _boundary(df, by, quotas, quota, hashed, digits)
    all_rows = match(df, cuts, by, "left")
    clear = all_rows.where("_cut is null or _bucket <> _cut").withColumn(
        name, F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False))
    )
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_hash", *ties))
    edge = all_rows.where("_bucket = _cut").withColumn(name, rank <= F.col("_rest"))
    return clear.unionByName(edge).drop("_hash", "_bucket", "_cut", "_rest")


def with_next(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], value: str, name: str) -> DataFrame:
    """The following row's ``value`` inside a group, sorted bucket by bucket.

    ``bucket`` must be non-decreasing along ``order``; the step over a bucket's end comes from the
    next non-empty bucket's first row.
    """
    by = list(by)
    df = df.withColumn("_bucket", bucket)
    first = F.min(F.struct(*order, F.col(value).alias("_first")))["_first"]
    heads = df.groupBy(*by, "_bucket").agg(first.alias("_head"))
    following = F.lead("_head").over(W.partitionBy(*by).orderBy("_bucket"))
    heads = heads.select(*by, "_bucket", following.alias("_head"))
    inside = F.lead(value).over(W.partitionBy(*by, "_bucket").orderBy(*order))
    return (
        match(df.withColumn("_inside", inside), heads, [*by, "_bucket"])
        .withColumn(name, F.coalesce("_inside", "_head")).drop("_bucket", "_inside", "_head")
    )


def with_earlier_min(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Smallest ``value`` strictly before each row of a group, sorted bucket by bucket."""
    by = list(by)
    df = df.withColumn("_bucket", bucket)
    lows = df.groupBy(*by, "_bucket").agg(F.min(value).alias("_low"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    lows = lows.select(*by, "_bucket", F.min("_low").over(before).alias("_low"))
    inside = F.min(value).over(
        W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        match(df.withColumn("_inside", inside), lows, [*by, "_bucket"])
        .withColumn(name, F.least("_inside", "_low")).drop("_bucket", "_inside", "_low")
    )


def range_bucket(value: Column, splits: Column, levels: int) -> Column:
    """Number of split points at or below ``value``, by binary search in a sorted array."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda pos, step: F.when(
            F.coalesce(F.try_element_at(splits, pos + step) <= value, F.lit(False)), pos + step
        ).otherwise(pos),
    )


def value_ranks(
    counts: DataFrame, by: Sequence[str], value: str, weight: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Add ``below`` (rows with a smaller value), ``place`` (dense rank) and ``total`` to value counts.

    ``counts`` has one row per (``by``, value). Groups with many distinct values are cut into value
    ranges taken from a sketch, so that no task sorts more than about ``group_rows`` of them.
    """
    by = list(by)
    sizes, _ = small_table(counts.groupBy(*by).agg(F.count("*").alias("_d"), F.sum(weight).alias("total")))
    size = sizes.agg(F.max("_d")).first()[0] or 0
    counts = match(counts, sizes.drop("_d"), by)
    if size <= group_rows:
        whole = W.partitionBy(*by).orderBy(value)
        earlier = whole.rowsBetween(W.unboundedPreceding, -1)
        return counts.withColumns({
            "below": F.coalesce(F.sum(weight).over(earlier), F.lit(0)).cast("bigint"),
            "place": F.row_number().over(whole).cast("bigint"),
        })
    parts = 2 * (size // group_rows + 1)
    probs = [i / parts for i in range(1, parts)]
    splits = counts.groupBy(*by).agg(F.array_distinct(F.percentile_approx(value, probs, 20 * parts)).alias("_splits"))
    counts = (
        match(counts, small_table(splits)[0], by)
        .withColumn("_range", range_bucket(F.col(value), F.col("_splits"), parts.bit_length()))
        .drop("_splits")
    )
    ranges = counts.groupBy(*by, "_range").agg(F.sum(weight).alias("_w"), F.count("*").alias("_d"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets, _ = small_table(
        ranges.select(
            *by, "_range",
            F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w0"),
            F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"),
        )
    )
    inside = W.partitionBy(*by, "_range").orderBy(value)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    return (
        counts.withColumn("_wi", F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
        .withColumn("_di", F.row_number().over(inside))
        .transform(match, offsets, [*by, "_range"])
        .withColumn("below", (F.col("_wi") + F.col("_w0")).cast("bigint"))
        .withColumn("place", (F.col("_di") + F.col("_d0")).cast("bigint"))
        .drop("_range", "_wi", "_di", "_w0", "_d0")
    )


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    group_rows: int = QUANTILE_VALUES,
    biggest: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles: one row per group, one ``array<double>`` column per input column.

    Groups of at most ``group_rows`` values over all columns use the built-in ``percentile``, whose
    buffer holds every distinct value of a group and is then bounded. Larger groups go through radix
    selection, whose shuffles do not grow with rows; it leaves out NaN and infinite values. A caller that
    knows the ``biggest`` group's row count saves the job that counts it.
    """
    by, columns, probs = list(by), list(columns), [float(p) for p in probs]
    if biggest is None:
        biggest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if biggest * len(columns) <= group_rows:
        return df.groupBy(*by).agg(
            *[F.percentile(F.col(c).cast("double"), probs).alias(c) for c in columns]
        )
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    large = sizes.where(F.col("_n") * len(columns) > group_rows).select(*by)
    few = df if not by else match(df, sizes.where(F.col("_n") * len(columns) <= group_rows).drop("_n").withColumn("_few", F.lit(True)), by).drop("_few")
    out = few.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), probs).alias(c) for c in columns]) if by else None
    step = max(1, radix.MOST_TARGETS // (2 * len(columns) * len(probs)))  # groups of one selection; there is a million of rows or more in each
    held: list = []
    for row in large.toLocalIterator() if by else [()]:
        held.append(tuple(row))
        if len(held) == step:
            part, held = _selected(df, by, columns, probs, held), []
            out = part if out is None else out.unionByName(part)
    if held:
        part = _selected(df, by, columns, probs, held)
        out = part if out is None else out.unionByName(part)
    return out


def _selected(df: DataFrame, by: list[str], columns: list[str], probs: list[float], groups: list[tuple]) -> DataFrame:
    """Quantiles of the listed groups by radix selection."""
    schema = T.StructType([f for c in by for f in df.schema if f.name == c])
    kinds = T.StructType([*schema.fields, T.StructField("_g", T.IntegerType())])
    codes = df.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], kinds)
    plain = df.select(*by, *columns)
    source = match(plain, small_table(codes)[0], by) if by else plain.withColumn("_g", F.lit(0))
    values, counts = radix.order_statistics(source, columns, len(groups), radix.quantile_ranks(probs), 2 * len(probs))
    found = radix.interpolated(values, counts, probs)
    rows = [(*g, *[found[i, j].tolist() if counts[i, j] else None for j in range(len(columns))]) for i, g in enumerate(groups)]
    return df.sparkSession.createDataFrame(rows, T.StructType([*schema.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in columns]]))
