"""Exact nearest neighbours inside each class, block against block.

Every row keeps its distances to a few pivots of its class. Rows are sorted by their nearest pivots and the distance to the nearest, so
rings of like rows lie together, and cut into blocks. A block's rows first meet each other, which bounds how far each row's k-th
neighbour can be. By the triangle inequality the ranges of pivot distances bound from below how near a row can be to a block; only
rows that the bound lets through are sent there. A task compares bounded numbers of rows and sends k candidates per row, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from tabularium.operators.arrow import classes_of, rows_of
from tabularium.operators.blocks import ordered
from tabularium.operators.matrix import square_sum
from tabularium.operators.skew import match, small_table, take_smallest
from tabularium.session import cut_lineage

SLICE_ROWS = 4_096
PIVOTS = 16
ASKING = 8  # blocks that share a copy of the block they ask; their rows meet it in one task
CELLS = 4_000_000  # numbers of a matrix in a task
VECTOR = pa.list_(pa.float64())
EXACT = 200_000  # pairs whose distances are taken from the differences at once


def _vectors(table: pa.Table, x: str) -> np.ndarray:
    rows = table.column(x).combine_chunks()
    return rows_of(table, x, len(rows[0]) if len(rows) else 0)


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]):
    """Cogroups of two frames that may descend from the same columns."""
    return left.groupBy(*by).cogroup(right.select(*[F.col(c).alias(c) for c in right.columns]).groupBy(*by))


def _nearest(p: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in ``q`` and distance of the ``k`` nearest of each row, ties by place; without ``bound``, ``q`` is ``p`` and a row skips itself.

    A matrix product finds who may be among them, with a margin for its rounding, and differences give their distances.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    margin = 1e-10 * (pp.max(initial=0.0) + qq.max(initial=0.0))
    most = min(k, len(q) - (bound is None))
    step = max(1, CELLS // max(1, len(q)))
    for at in range(0, len(p) if most > 0 else 0, step):
        near = pp[at : at + step, None] + qq[None, :] - 2 * (p[at : at + step] @ q.T)
        if bound is None:
            near[np.arange(len(near)), at + np.arange(len(near))] = np.inf
        limit = np.partition(near, most - 1, axis=1)[:, most - 1] + 2 * margin
        if bound is not None:
            limit = np.minimum(limit, (bound[at : at + step] * (1 + 1e-9)) ** 2 + 2 * margin)
        row, col = np.nonzero(near <= limit[:, None])
        dist = np.concatenate([np.sqrt(((p[at + row[i : i + EXACT]] - q[col[i : i + EXACT]]) ** 2).sum(-1)) for i in range(0, len(row), EXACT)] or [np.zeros(0)])
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((at + row[kept], col[kept], dist[kept]))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True))


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """All distances, by a matrix product; pairs so close that its rounding would show are taken from the differences."""
    centre = q.mean(0)
    a, b = p - centre, q - centre
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    square = a @ (-2 * b.T)
    square += aa[:, None]
    square += bb
    least = 1e-5 * (aa.max(initial=0.0) + bb.max(initial=0.0))
    if not square.min(initial=np.inf) > least:
        row, col = np.nonzero(~(square > least))  # also what is no number
        for i in range(0, len(row), EXACT):
            of = row[i : i + EXACT], col[i : i + EXACT]
            square[of] = ((p[of[0]] - q[of[1]]) ** 2).sum(-1)
    return np.sqrt(square, out=square)


def _placed(df: DataFrame, key: str, cls: str, x: str) -> DataFrame:
    """(c, a, x). Rows whose vector is null, or holds a null or no finite number, are left out."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.select(F.col(cls).alias("c"), F.col(key).alias("a"), F.col(x).cast("array<double>").alias("x")).where(finite)


def _rings(rows: DataFrame, slice_rows: int) -> DataFrame:
    """The rows with ``to``, their distances to the pivots, and their block."""
    sizes = rows.groupBy("c").agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / (8 * slice_rows)).cast("int"))
    sizes, _ = small_table(sizes)
    drawn = F.md5(F.concat_ws("|", F.lit("pivot"), F.col("a").cast("string")))
    pivots = take_smallest(rows, ["c"], sizes.select("c", F.lit(PIVOTS).alias("_most")), "_most", drawn, [F.col("a")])
    part = F.pmod(F.xxhash64("a"), F.col("_parts")).cast("int").alias("part")
    mine = match(rows, sizes, ["c"]).select("c", part, "a", "x")
    marks = match(pivots.select("c", "a", "x"), sizes, ["c"]).select("c", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "a", "x")
    schema = rows.schema.simpleString()[len("struct<"):-1] + ",`to` array<double>,ring int,d double"

    def place(one: pa.Table, two: pa.Table) -> pa.Table:
        p, q = _vectors(one, "x"), _vectors(two.sort_by("a"), "x")
        to = np.sqrt(np.stack([((p - mark) ** 2).sum(1) for mark in q], 1)) if len(p) else np.zeros((0, len(q)))
        order = np.argsort(to, axis=1, kind="stable")[:, :3]
        ring = sum((order[:, i] * (PIVOTS + 1) ** (2 - i) for i in range(order.shape[1])), np.zeros(len(p), np.int64))
        lists = pa.ListArray.from_arrays(np.arange(0, to.size + 1, max(1, len(q)), dtype=np.int32)[: len(p) + 1], to.ravel())
        columns = [one.column("c"), one.column("a"), one.column("x").cast(VECTOR), lists, pa.array(ring, pa.int32()), pa.array(to.min(1, initial=np.inf))]
        return pa.Table.from_arrays(columns, ["c", "a", "x", "to", "ring", "d"])

    placed = _beside(mine, marks, ["c", "part"]).applyInArrow(place, schema)
    bits = max(0, int(math.log2(slice_rows)))
    return ordered(placed, "c", ["ring", "d", "a"]).select("c", "a", "x", "to", F.shiftright("at", bits).alias("block"))


def _own(rings: DataFrame, k: int) -> DataFrame:
    """Rows after they have met their own block, with the bound on their k-th distance. ``found`` holds a row's candidates, nearest first;
    ``n``, ``reach``, ``low`` and ``high`` the block's size, largest bound and ranges of pivot distances, once a block."""
    kind, group = rings.schema["a"].dataType.simpleString(), rings.schema["c"].dataType.simpleString()
    shape = f"c {group}, block long, a {kind}, x array<double>, to array<double>, bound double, found array<struct<b:{kind},distance:double>>, n long, reach double, low array<double>, high array<double>"

    def own(table: pa.Table) -> pa.Table:
        table = table.sort_by("a")
        p, to = _vectors(table, "x"), _vectors(table, "to")
        row, col, dist = _nearest(p, p, k)
        cuts = np.searchsorted(row, np.arange(len(p) + 1))
        full = np.diff(cuts) >= k
        bound = np.full(len(p), np.inf)
        bound[full] = dist[cuts[1:][full] - 1]
        found = pa.StructArray.from_arrays([table.column("a").combine_chunks().take(pa.array(col)), pa.array(dist)], ["b", "distance"])
        once = [None] * (len(p) - 1)
        columns = [
            table.column("c"), table.column("block"), table.column("a"), table.column("x").cast(VECTOR), table.column("to").cast(VECTOR), pa.array(bound),
            pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found), pa.array([len(p), *once], pa.int64()), pa.array([bound.max(), *once], pa.float64()),
            pa.array([to.min(0), *once], VECTOR), pa.array([to.max(0), *once], VECTOR),
        ]
        return pa.Table.from_arrays(columns, ["c", "block", "a", "x", "to", "bound", "found", "n", "reach", "low", "high"])

    return rings.groupBy("c", "block").applyInArrow(own, shape)


def _asks(met: DataFrame) -> DataFrame:
    """The rows sent to each other block."""
    kind, group = met.schema["a"].dataType.simpleString(), met.schema["c"].dataType.simpleString()
    boxes = met.where("n IS NOT NULL").select("c", "block", "reach", "low", "high")
    stripes, _ = small_table(boxes.groupBy("c").agg(F.ceil(F.count("*") / 1_024).cast("int").alias("_stripes")))
    boxes = match(boxes, stripes, ["c"])
    mine = boxes.withColumn("stripe", F.pmod(F.xxhash64("block"), F.col("_stripes")).cast("int")).drop("_stripes")
    theirs = boxes.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("_stripes") - 1))).drop("_stripes")

    def near_blocks(one: pa.Table, two: pa.Table) -> pa.Table:
        low, high, reach = _vectors(one, "low"), _vectors(one, "high"), one.column("reach").to_numpy()
        there, above = _vectors(two, "low"), _vectors(two, "high")
        names, others = one.column("block").to_numpy(), two.column("block").to_numpy()
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, CELLS // max(1, len(others)))
        for at in range(0, len(names), step):
            part = slice(at, at + step)
            gap = np.zeros((len(names[part]), len(others)))
            for i in range(low.shape[1]):
                np.maximum(gap, there[None, :, i] - high[part, None, i], out=gap)
                np.maximum(gap, low[part, None, i] - above[None, :, i], out=gap)
            row, col = np.nonzero((gap <= reach[part, None] * (1 + 1e-9) + 1e-9) & (names[part, None] != others[None, :]))
            left.append(at + row)
            right.append(col)
        row, col = pa.array(np.concatenate(left)), pa.array(np.concatenate(right))
        columns = [one.column("c").take(row), one.column("block").take(row), *[two.column(c).take(col) for c in ("block", "low", "high")]]
        return pa.Table.from_arrays(columns, ["c", "block", "other", "low", "high"])

    meets = cut_lineage(
        _beside(mine, theirs, ["c", "stripe"]).applyInArrow(near_blocks, f"c {group}, block long, other long, low array<double>, high array<double>")
    )
    shares = meets.groupBy("c", "other").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("_shares"))
    dealt = match(meets, shares, ["c", "other"]).withColumn("share", F.pmod(F.xxhash64("block"), F.col("_shares")).cast("int"))

    def ask(one: pa.Table, two: pa.Table) -> pa.Table:
        to, bound, low, high = _vectors(one, "to"), one.column("bound").to_numpy(), _vectors(two, "low"), _vectors(two, "high")
        row = [np.flatnonzero(np.maximum(a - to, to - b).max(1, initial=0.0) <= bound * (1 + 1e-9) + 1e-9) for a, b in zip(low, high, strict=True)]
        col = pa.array(np.repeat(np.arange(len(low)), [len(r) for r in row]))
        row = pa.array(np.concatenate([np.zeros(0, np.int64), *row]))
        columns = [*[two.column(c).take(col) for c in ("c", "other", "share", "_shares")], *[one.column(c).take(row) for c in ("a", "x", "bound")]]
        return pa.Table.from_arrays(columns, ["c", "block", "share", "shares", "a", "x", "bound"])

    asking = _beside(met.select("c", "block", "a", "x", "to", "bound"), dealt, ["c", "block"])
    return asking.applyInArrow(ask, f"c {group}, block long, share int, shares int, a {kind}, x array<double>, bound double")


def neighbours(df: DataFrame, key: str, cls: str, x: str, k: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(class, a, b, distance, place): the ``k`` nearest rows b of every row a, ties by key."""
    rows = _placed(df, key, cls, x)
    if (rows.groupBy("c").count().agg(F.max("count")).first()[0] or 0) <= slice_rows:  # each class is a block, and there is no other to ask
        met = _own(rows.withColumns({"to": F.array(F.lit(0.0)), "block": F.lit(0).cast("long")}), k)
        found = met.select(F.col("c").alias(cls), "a", F.posexplode("found").alias("at", "f"))
        return found.select(cls, "a", "f.b", "f.distance", (F.col("at") + 1).alias("place"))
    met = cut_lineage(_own(_rings(rows, slice_rows), k))
    asks = cut_lineage(_asks(met))
    kind, group = met.schema["a"].dataType.simpleString(), met.schema["c"].dataType.simpleString()
    asked = asks.select("c", "block", "share").distinct()
    there = match(met.select("c", "block", "a", "x"), asked, ["c", "block"])

    def answer(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.sort_by("a")
        row, col, dist = _nearest(_vectors(one, "x"), _vectors(two, "x"), k, one.column("bound").to_numpy()) if one.num_rows and two.num_rows else (np.zeros(0, np.int64),) * 3
        columns = [one.column("c").take(pa.array(row)), one.column("a").take(pa.array(row)), two.column("a").take(pa.array(col)), pa.array(dist, pa.float64())]
        return pa.Table.from_arrays(columns, ["c", "a", "b", "distance"])

    far = _beside(asks, there, ["c", "block", "share"]).applyInArrow(answer, f"c {group}, a {kind}, b {kind}, distance double")
    found = met.select("c", "a", F.explode("found").alias("f")).select("c", "a", "f.b", "f.distance").unionByName(far)
    place = F.row_number().over(W.partitionBy("a").orderBy("distance", "b"))
    return found.withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("c", cls)


def comparisons(df: DataFrame, key: str, cls: str, x: str, k: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(class, compared, pairs): how many ordered pairs ``neighbours`` compares, and how many there are."""
    met = cut_lineage(_own(_rings(_placed(df, key, cls, x), slice_rows), k))
    asks = _asks(met)
    sizes = met.where("n IS NOT NULL").select("c", "block", "n")
    sent = match(asks.groupBy("c", "block").agg(F.count("*").alias("_asks")), sizes, ["c", "block"]).select("c", (F.col("_asks") * F.col("n")).alias("done"), F.lit(0).cast("long").alias("n"))
    own = sizes.select("c", (F.col("n") * (F.col("n") - 1)).alias("done"), "n")
    total = own.unionByName(sent).groupBy("c").agg(F.sum("done").alias("compared"), F.sum("n").alias("n"))
    return total.select(F.col("c").alias(cls), "compared", (F.col("n") * (F.col("n") - 1)).alias("pairs"))


def local_outlier_factor(df: DataFrame, key: str, cls: str, x: str, k_max: int = 20, min_rows: int = 5) -> DataFrame:
    """(key, class, score): ratio of the neighbours' density to the row's own; 0 in classes below ``min_rows``.

    k is min(k_max, max(2, n - 1)) per class, capped at the n - 1 rows that exist.
    """
    sizes, _ = small_table(df.groupBy(cls).agg(F.count("*").alias("_n")))
    edges = cut_lineage(neighbours(df, key, cls, x, k_max))
    reach = edges.groupBy(F.col("a").alias("b")).agg(F.max("distance").alias("_kd"))
    density = edges.join(reach, "b").groupBy("a").agg(
        (1 / (F.avg(F.greatest("distance", "_kd")) + 1e-10)).alias("_density")
    )
    ratio = (
        edges.join(density.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.avg("_density").alias("_around"))
        .join(density, "a").select(F.col("a").alias(key), (F.col("_around") / F.col("_density")).alias("_lof"))
    )
    # written once: a sum's last digit depends on row order, and a quantile cut must see the same scores
    ratio = cut_lineage(ratio)
    rows = match(df.select(key, cls), sizes, [cls]).join(ratio, key, "left")
    score = F.when(F.col("_n") < min_rows, 0.0).otherwise(F.coalesce("_lof", F.lit(0.0)))
    return rows.select(key, cls, score.alias("score"))


def silhouette(df: DataFrame, key: str, cls: str, x: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exact Euclidean silhouette of every row.

    A mean of distances does not decompose, so every pair is computed, as in the definition. Slices of all rows are numbered round a
    circle; each meets those up to half the circle ahead, so each unordered pair of rows is computed once, and both rows' sums are
    sent. ``silhouette_squared`` is the linear-cost form.
    """
    sizes, _ = small_table(df.groupBy(cls).agg(F.count("*").alias("_n")))
    count = max(1, math.ceil(df.count() / slice_rows))
    base = df.select(F.col(key).alias("a"), F.col(cls).alias("c"), F.col(x).cast("array<double>").alias("x"), F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("s"))
    base = cut_lineage(base)
    half = count // 2  # with an even number of slices the opposite one is met from the lower half only
    steps = F.sequence(F.lit(0), F.lit(half) if count % 2 else F.when(F.col("s") < half, half).otherwise(max(0, half - 1)))
    ahead = base.withColumn("step", F.explode(steps))
    behind = base.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(half)))).withColumn("s", F.pmod(F.col("s") - F.col("step"), F.lit(count)).cast("int"))
    if count % 2 == 0:
        behind = behind.where(F.col("step").eqNullSafe(0) | (F.col("step") < half) | (F.col("s") < half))
    kind, group = base.schema["a"].dataType.simpleString(), base.schema["c"].dataType.simpleString()

    def meeting(one: pa.Table, two: pa.Table) -> pa.Table:
        same = bool(one.num_rows) and one.column("step")[0].as_py() == 0
        totals = []
        if one.num_rows and two.num_rows:
            p, q = _vectors(one, "x"), _vectors(two, "x")
            (mine, names), (theirs, others) = classes_of(one, "c"), classes_of(two, "c")
            member, other = np.eye(len(names))[mine], np.eye(len(others))[theirs]
            to_them, to_us = np.zeros((len(p), len(others))), np.zeros((len(q), len(names)))
            step = max(1, CELLS // 16 // max(1, len(q)))  # stays in a core's cache
            for at in range(0, len(p), step):
                d = _distances(p[at : at + step], q)
                to_them[at : at + step] = d @ other
                to_us += d.T @ member[at : at + step]
            totals = [(one, mine, names, to_them, others)] if same else [(one, mine, names, to_them, others), (two, theirs, others, to_us, names)]
        parts = []
        for table, own, known, sums, classes in totals:
            row, col = np.divmod(np.arange(sums.size), len(classes))
            columns = [table.column("a").take(pa.array(row)), pa.array(known, one.schema.field("c").type).take(pa.array(own[row])), pa.array(classes, one.schema.field("c").type).take(pa.array(col)), pa.array(sums.ravel())]
            parts.append(pa.Table.from_arrays(columns, ["a", "c", "oc", "total"]))
        empty = pa.schema([one.schema.field("a"), one.schema.field("c"), one.schema.field("c").with_name("oc"), ("total", pa.float64())]).empty_table()
        return pa.concat_tables(parts) if parts else empty

    sums = _beside(ahead, behind, ["s", "step"]).applyInArrow(meeting, f"a {kind}, c {group}, oc {group}, total DOUBLE").groupBy("a", "c", "oc").agg(F.sum("total").alias("total"))
    return _from_sums(sums, sizes.select(F.col(cls).alias("oc"), F.col("_n").alias("n")), key, cls)


def _from_sums(sums: DataFrame, sizes: DataFrame, key: str, cls: str) -> DataFrame:
    """Silhouette from each row's summed distance to each class; rows alone in their class get 0."""
    joined = match(sums, sizes, ["oc"])
    own = F.col("c").eqNullSafe(F.col("oc"))
    per = joined.groupBy("a", "c").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("inner"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("outer"),
    )
    value = (F.col("outer") - F.col("inner")) / F.greatest("inner", "outer")
    return per.select(F.col("a").alias(key), F.col("c").alias(cls), F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def silhouette_squared(df: DataFrame, key: str, cls: str, feats: Sequence[str]) -> DataFrame:
    """Silhouette on squared Euclidean distance: linear cost through class sums and squared norms."""
    from tabularium.operators.matrix import dot, vector

    norm = square_sum(vector(feats))
    per = df.groupBy(cls).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(f).cast("double")) for f in feats]).alias("sx"),
                              F.sum(norm).alias("sq"))
    per, _ = small_table(per.select(F.col(cls).alias("oc"), "n", "sx", "sq"))
    listed = per.agg(F.collect_list(F.struct("oc", "n", "sx", "sq")).alias("_all"))
    rows = df.select(F.col(key).alias("a"), F.col(cls).alias("c"), vector(feats).alias("_x")).join(F.broadcast(listed))
    rows = rows.withColumn("_xx", square_sum(F.col("_x")))
    means = F.transform("_all", lambda o: F.struct(
        F.col("c").eqNullSafe(o["oc"]).alias("own"), o["n"].alias("n"),
        (o["n"] * F.col("_xx") - 2 * dot(F.col("_x"), o["sx"]) + o["sq"]).alias("t"),
    ))
    rows = rows.select("a", "c", means.alias("_m"))
    inner = F.element_at(F.filter("_m", lambda m: m["own"]), 1)
    inner = F.when(inner["n"] > 1, inner["t"] / (inner["n"] - 1))
    outer = F.array_min(F.transform(F.filter("_m", lambda m: ~m["own"]), lambda m: m["t"] / m["n"]))
    rows = rows.withColumn("_in", inner).withColumn("_out", outer)
    value = (F.col("_out") - F.col("_in")) / F.greatest("_in", "_out")
    return rows.select(F.col("a").alias(key), F.col("c").alias(cls), F.coalesce(value, F.lit(0.0)).alias("silhouette"))
