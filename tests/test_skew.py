"""The building blocks against brute force, with a hot group and every large-input path forced."""

import hashlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabularium.operators import dedup, knn, skew, stats


@pytest.fixture(scope="module")
def rows(spark):
    """600 rows; one class holds a third, one class is null, one value is very frequent."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": range(600)})
    pdf["cls"] = ["hot" if i % 3 == 0 else None if i % 50 == 1 else f"c{i % 7}" for i in range(600)]
    pdf["v"] = np.where(pdf["id"] % 4 == 0, 5.0, np.round(rng.lognormal(1, 2, 600), 3))
    return pdf, spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "id BIGINT, cls STRING, v DOUBLE")


def md5(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def by_class(pdf):
    return {(None if pd.isna(k) else k): g for k, g in pdf.groupby("cls", dropna=False)}


def test_numbered(rows):
    pdf, df = rows
    h = F.md5(F.col("id").cast("string"))
    got = skew.numbered(df, ["cls"], F.substring(h, 1, 1), [h, F.col("id")], "n").toPandas()
    assert len(got) == 600
    for cls, g in by_class(pdf).items():
        want = {i: n + 1 for n, i in enumerate(sorted(g["id"], key=md5))}
        part = got[got["cls"].isna()] if cls is None else got[got["cls"] == cls]
        assert dict(zip(part["id"], part["n"])) == want


@pytest.mark.parametrize("digits", [1, 4])
def test_take_and_mark_smallest(spark, rows, digits):
    pdf, df = rows
    quotas = df.groupBy("cls").agg((F.count("*") / 3).cast("bigint").alias("q"))
    h = F.md5(F.col("id").cast("string"))
    want = {i for g in by_class(pdf).values() for i in sorted(g["id"], key=md5)[: len(g) // 3]}
    taken = skew.take_smallest(df, ["cls"], quotas, "q", h, [F.col("id")], digits)
    assert {r["id"] for r in taken.collect()} == want
    marked = skew.mark_smallest(df, ["cls"], quotas, "q", h, [F.col("id")], "yes", digits).collect()
    assert len(marked) == 600 and {r["id"] for r in marked if r["yes"]} == want


@pytest.mark.parametrize("group_rows", [10, 10_000])
def test_value_ranks(rows, group_rows):
    pdf, df = rows
    counts = df.groupBy("cls", "v").agg(F.count("*").alias("c"))
    got = skew.value_ranks(counts, ["cls"], "v", "c", group_rows).collect()
    groups = by_class(pdf)
    assert len(got) == sum(g["v"].nunique() for g in groups.values())
    for r in got:
        g = groups[r["cls"]]["v"]
        assert r["below"] == (g < r["v"]).sum() and r["place"] == g[g <= r["v"]].nunique()


@pytest.mark.parametrize("group_rows", [20, 10_000])
def test_grouped_quantiles(rows, group_rows):
    pdf, df = rows
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = skew.grouped_quantiles(df.withColumn("w", -F.col("v")), ["cls"], ["v", "w"], probs, group_rows).collect()
    groups = by_class(pdf)
    assert len(got) == len(groups)
    for r in got:
        np.testing.assert_allclose(r["v"], np.quantile(groups[r["cls"]]["v"], probs), rtol=1e-12)
        np.testing.assert_allclose(r["w"], np.quantile(-groups[r["cls"]]["v"], probs), rtol=1e-12)


def test_next_and_earlier_min(rows):
    pdf, df = rows
    bucket = F.floor(F.col("id") / 40)
    nxt = {r["id"]: r["n"] for r in skew.with_next(df, ["cls"], bucket, ["id"], "v", "n").collect()}
    low = {r["id"]: r["m"] for r in skew.with_earlier_min(df, ["cls"], bucket, ["id"], "v", "m").collect()}
    assert len(nxt) == len(low) == 600
    for g in by_class(pdf).values():
        values = list(g.sort_values("id")["v"])
        for k, i in enumerate(sorted(g["id"])):
            assert nxt[i] == (values[k + 1] if k + 1 < len(values) else None)
            assert low[i] == (min(values[:k]) if k else None)


def test_join_unique_keeps_every_row(rows, monkeypatch):
    pdf, df = rows
    monkeypatch.setattr(skew, "HOT_KEYS", 2)
    right = df.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    got = skew.join_unique(df.where("cls is not null"), right, ["cls"], "n").toPandas()
    assert len(got) == pdf["cls"].notna().sum()
    np.testing.assert_allclose(got.groupby("cls")["s"].first(), pdf.groupby("cls")["v"].sum())


def test_small_table_bound(rows):
    _, df = rows
    assert skew.small_table(df, 600)[1] and not skew.small_table(df, 599)[1]
    assert skew.small_table(df, 10)[0].count() == 600


def test_near_pairs_with_divided_buckets(spark):
    rng = np.random.default_rng(1)
    # low-entropy hashes: most share whole blocks, so buckets are crowded
    values = np.unique(rng.integers(0, 1 << 14, 400) | (rng.integers(0, 2, 400) << 40))
    signed = [int(v) - (1 << 64) if v >= 1 << 63 else int(v) for v in values.tolist() + [(1 << 63) + 5, (1 << 63) + 7]]
    df = spark.createDataFrame([(v,) for v in signed], "bits BIGINT")
    want = {
        (min(a, b), max(a, b), ((a ^ b) & ((1 << 64) - 1)).bit_count())
        for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
    }
    for rows_per_bucket in (30, 20_000):
        got = [tuple(r) for r in dedup.near_pairs(df, "bits", "bits", 3, bucket_rows=rows_per_bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicate_chain(spark):
    """In a chain a-b-c the middle is a duplicate, so the end is kept."""
    df = spark.createDataFrame([(1, 0b0), (2, 0b111), (3, 0b111111), (4, 0b111), (5, 1 << 40)], "id BIGINT, bits BIGINT")
    got = {r["id"]: r["duplicate_of"] for r in dedup.mark_near(df, "id", "bits", [], 3).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 1, 5: 1}


def test_exact_duplicates_skip_errors(spark):
    rows = [(1, "b", "h"), (2, "a", "h"), (3, "a", "ERROR::x"), (4, "a", "ERROR::x"), (5, "c", None), (6, "a", "k")]
    df = spark.createDataFrame(rows, "id BIGINT, cls STRING, hash STRING")
    got = {r["id"]: (r["is_duplicate"], r["duplicate_of"]) for r in dedup.mark_exact(df, "id", "hash", ["cls"]).collect()}
    assert got == {1: (True, 2), 2: (False, None), 3: (False, None), 4: (False, None), 5: (False, None), 6: (False, None)}
    assert dedup.mark_exact(df.limit(0), "id", "hash", ["cls"]).columns == ["id", "cls", "hash", "is_duplicate", "duplicate_of"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    cls = np.array(["hot"] * 120 + ["b"] * 40 + ["one"])
    x = rng.normal(size=(161, 3)) + np.where(cls == "b", 4.0, 0.0)[:, None]
    x[:15] = x[0]
    rows = [(i, c, [float(v) for v in p]) for i, (c, p) in enumerate(zip(cls, x))]
    return cls, x, spark.createDataFrame(rows, "id BIGINT, cls STRING, x ARRAY<DOUBLE>")


@pytest.mark.parametrize("slice_rows", [9, 4096])
def test_neighbours(points, slice_rows):
    cls, x, df = points
    got = knn.neighbours(df, "id", "cls", "x", 5, slice_rows).toPandas()
    for i in range(len(x)):
        mates = [j for j in range(len(x)) if j != i and cls[j] == cls[i]]
        want = sorted((np.sqrt(((x[i] - x[j]) ** 2).sum()), j) for j in mates)[:5]
        part = got[got["a"] == i].sort_values("place")
        np.testing.assert_allclose(part["distance"], [d for d, _ in want], atol=1e-12)
        assert list(part["b"]) == [j for _, j in want]


def test_neighbours_compare_few_pairs_of_clustered_rows(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 16)) * 20
    x = centres[rng.integers(0, 40, 4_000)] + rng.normal(size=(4_000, 16)) * 0.3
    df = spark.createDataFrame([(i, "hot", [float(v) for v in p]) for i, p in enumerate(x)], "id BIGINT, cls STRING, x ARRAY<DOUBLE>")
    done = knn.comparisons(df, "id", "cls", "x", 5, 64).first()
    assert done["pairs"] == 4_000 * 3_999 and done["compared"] < done["pairs"] / 10
    got = knn.neighbours(df, "id", "cls", "x", 5, 64).groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("b")).toPandas()
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    assert len(got) == 4_000
    assert all(list(b) == sorted(np.argsort(d[a])[:5]) for a, b in zip(got["a"], got["b"], strict=True))


def test_neighbours_of_rows_without_vectors_and_of_equal_rows(spark):
    rows = [(1, None, [0.0, 1.0]), (2, None, [0.0, 2.0]), (3, "a", None), (4, "a", [float("nan"), 0.0]), (5, "a", [1.0, None]), (6, "a", [1.0, 1.0])]
    rows += [(i, "b", [3.0, 3.0]) for i in range(10, 40)]
    df = spark.createDataFrame(rows, "id BIGINT, cls STRING, x ARRAY<DOUBLE>")
    got = sorted((r["a"], r["place"], r["b"]) for r in knn.neighbours(df, "id", "cls", "x", 2, 4).collect())
    assert got[:2] == [(1, 1, 2), (2, 1, 1)]
    assert got[2:] == [(i, n, b) for i in range(10, 40) for n, b in enumerate([j for j in (10, 11, 12) if j != i][:2], 1)]
    assert knn.neighbours(df.limit(0), "id", "cls", "x", 2).columns == ["cls", "a", "b", "distance", "place"]
    assert knn.neighbours(df.limit(0), "id", "cls", "x", 2).count() == 0


@pytest.mark.parametrize("slice_rows", [25, 40, 81, 4096])
def test_silhouette(points, slice_rows):
    cls, x, df = points
    got = knn.silhouette(df, "id", "cls", "x", slice_rows).toPandas().set_index("id")["silhouette"]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(len(x)):
        own = cls == cls[i]
        outer = min(d[i, cls == c].mean() for c in set(cls) if c != cls[i])
        inner = d[i, own].sum() / (own.sum() - 1) if own.sum() > 1 else None
        want = 0.0 if inner is None else (outer - inner) / max(inner, outer)
        assert abs(got[i] - want) < 1e-9


def test_neighbour_information_blocks(rows):
    _, df = rows
    long = df.where("cls is not null").select("cls", F.lit("v").alias("feature"), F.col("v").alias("value"))
    values = [
        stats.neighbour_information(long, ["feature"], "cls", 3, block).first()["information"] for block in (7, 200_000)
    ]
    assert abs(values[0] - values[1]) < 1e-9


def test_distances_by_products_are_those_by_differences():
    rng = np.random.default_rng(3)
    q = np.concatenate([rng.normal(size=(200, 16)), rng.normal(size=(50, 16)) * 1e-9])
    p = np.concatenate([q[:20], q[:20] + 1e-7, q[-30:]])
    for shift in (0.0, 1e6):
        want = np.sqrt((((p + shift)[:, None] - (q + shift)[None]) ** 2).sum(-1))
        np.testing.assert_allclose(knn._distances(p + shift, q + shift), want, rtol=1e-9, atol=0)
    q[3], q[4, 2], p[0, 1] = np.nan, np.inf, -np.inf
    with np.errstate(invalid="ignore"):
        np.testing.assert_array_equal(knn._distances(p, q), np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)))


def test_distances_by_products_cost_less():
    rng = np.random.default_rng(4)
    q = rng.normal(size=(4096, 64))
    start = time.process_time()
    knn._distances(q[:512], q)
    fast = time.process_time() - start
    start = time.process_time()
    for at in range(0, 512, 8):
        np.sqrt(((q[at : at + 8, None, :] - q[None, :, :]) ** 2).sum(-1))
    assert fast < time.process_time() - start
