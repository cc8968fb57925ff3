"""Radix selection, masked samples and robust models against brute force."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabularium.functions.tails import chi2_quantile
from tabularium.operators import binned, matrix, outliers, radix, robust, selection, stats


def frame(rng, n=4000):
    return pd.DataFrame({
        "_g": rng.integers(-1, 3, n).astype(np.int32), "a": rng.normal(size=n), "b": rng.integers(-2, 3, n).astype(float),
        "c": np.where(rng.random(n) < 0.1, np.nan, rng.random(n) * 1e6), "d": np.where(rng.random(n) < 0.5, -0.0, 0.0), "e": np.full(n, np.nan),
    })


def test_bits_sort_like_numbers():
    x = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf])
    u = radix.sortable(x)
    assert (np.diff(u.astype(object)) >= 0).all() and u[4] == u[5]
    assert (radix.doubles(u) == x).all()


@pytest.mark.parametrize("few", [0, 40, 4_000_000])
def test_order_statistics_of_groups(spark, few):
    df = frame(np.random.default_rng(few))
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    values, counts = radix.order_statistics(spark.createDataFrame(df).repartition(5), list("abcde"), 4, radix.quantile_ranks(probs), 2 * len(probs), few=few)
    got = radix.interpolated(values, counts, probs)
    for g in range(4):
        for k, f in enumerate("abcde"):
            x = df[df._g == g][f].dropna().to_numpy()
            assert counts[g, k] == len(x)
            if len(x):
                np.testing.assert_allclose(got[g, k], np.quantile(x, probs), rtol=1e-12)
            else:
                assert np.isnan(values[g, k]).all()


@pytest.mark.parametrize("few", [0, 4_000_000])
def test_order_statistics_of_masks(spark, few):
    rng = np.random.default_rng(7)
    df = frame(rng)
    df["_g"] = rng.integers(0, 1 << 12, len(df))
    ranks = lambda n: np.array([0, n // 3, n - 1])
    values, counts = radix.order_statistics(spark.createDataFrame(df).repartition(3), list("abc"), 12, ranks, 3, mask=True, few=few)
    for g in range(12):
        for k, f in enumerate("abc"):
            x = np.sort(df[(df._g.to_numpy() >> g) & 1 == 1][f].dropna().to_numpy())
            assert counts[g, k] == len(x) and (values[g, k] == x[ranks(len(x))]).all()


def gain(cls, x, bins=10):
    order = np.sort(x)
    place = np.searchsorted(order, x, side="left") * bins // len(x)
    total = 0.0
    for c in set(cls):
        for b in set(place):
            n = ((cls == c) & (place == b)).sum()
            if n:
                total += n / len(x) * math.log(n * len(x) / ((cls == c).sum() * (place == b).sum()))
    return max(total, 0.0)


@pytest.mark.parametrize("n", [3, 9, 500])
def test_binned_information(spark, n):
    rng = np.random.default_rng(n)
    df = pd.DataFrame({"cls": rng.choice(["p", "q", None], n), "u": rng.normal(size=n), "v": rng.integers(0, 4, n).astype(float), "w": np.where(rng.random(n) < 0.3, np.inf, rng.random(n))})
    got = {r.feature: r.information for r in stats.binned_information(spark.createDataFrame(df, "cls string, u double, v double, w double").repartition(3), "cls", ["u", "v", "w"]).collect()}
    for f in ("u", "v", "w"):
        good = np.isfinite(df[f].to_numpy())
        if good.any():
            cls = np.array([c or "null" for c in df["cls"]])
            assert got[f] == pytest.approx(gain(cls[good], df[f].to_numpy()[good]), abs=1e-12)


def drawn(keys, cls, b, seed=42):
    per = min(np.bincount(cls)[np.unique(cls)])
    out = []
    for c in set(cls):
        of = [k for k, x in zip(keys, cls) if x == c]
        out += sorted(of, key=lambda k: (hashlib.md5(f"{seed}|{b}|{k}".encode()).hexdigest(), k))[:per]
    return set(out)


def test_masks_hold_the_resamples(spark):
    rng = np.random.default_rng(3)
    cls = np.append(rng.integers(0, 3, 400), np.zeros(300, int))  # one class holds most rows
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(700), "c": cls})).repartition(4)
    marked = selection.resample_masks(df, "k", "c", 5).collect()
    exploded = selection.resample(df, "k", "c", 5).collect()
    for b in range(5):
        want = drawn(range(700), cls, b)
        assert {r.k for r in marked if r._mask >> b & 1} == want == {r.k for r in exploded if r.bootstrap == b}


def test_equal_features_tie_in_every_resample(spark):
    """Two features with the same values in another order of rows and sign have equal scores, and share their ranks."""
    rng = np.random.default_rng(5)
    x, cls = rng.normal(size=300), rng.integers(0, 2, 300)
    df = pd.DataFrame({"k": np.arange(300), "c": cls, "p": x, "q": x * 4, "r": x * 0.125, "z": rng.normal(size=300)})
    rows = {r.feature: r for r in selection.balanced_ranking(spark.createDataFrame(df).repartition(7), "k", "c", ["p", "q", "r", "z"], n_bootstrap=4, binned=10).collect()}
    assert rows["p"].info_rank_mean == rows["q"].info_rank_mean == rows["r"].info_rank_mean
    assert rows["p"].anova_rank_mean == rows["q"].anova_rank_mean == rows["r"].anova_rank_mean


def test_more_resamples_than_bits(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(60), "c": np.arange(60) % 3}))
    rows = selection.resample(df, "k", "c", binned.MOST_SAMPLES + 3)
    assert rows.select("bootstrap").distinct().count() == binned.MOST_SAMPLES + 3
    assert {r.k for r in rows.where("bootstrap = 63").collect()} == drawn(range(60), np.arange(60) % 3, 63)


def clouds(rng, sizes, p=4, spoiled=0.1):
    rows = []
    for c, n in enumerate(sizes):
        mix = rng.normal(size=(p, p))
        data = rng.normal(size=(n, p)) @ mix + 5 * c
        bad = rng.random(n) < spoiled
        data[bad] += 40 * rng.normal(size=p)
        rows += [(int(i), f"c{c}", v.tolist(), bool(b)) for i, (v, b) in enumerate(zip(data, bad))]
    return rows


def determinant(data, support, starts, rng):
    """Least log determinant that many random starts and concentration steps reach."""
    best = np.inf
    for _ in range(starts):
        kept = data[rng.choice(len(data), data.shape[1] + 1, replace=False)]
        last = None
        for _ in range(60):
            mean, cov = kept.mean(0), np.cov(kept.T, bias=True)
            if np.linalg.matrix_rank(cov) < len(cov):
                cov = cov + 1e-6 * np.eye(len(cov))
            d = np.einsum("ij,jk,ik->i", data - mean, np.linalg.inv(cov), data - mean)
            kept = data[d <= np.quantile(d, support)]
            now = np.linalg.slogdet(np.cov(kept.T, bias=True))[1]
            if last is not None and abs(now - last) < 1e-10:
                break
            last = now
        best = min(best, now)
    return best


def brute_robust(data, support=0.75):
    center, rows = robust.fit_here(data, support, 60)
    return (((data - center) @ rows.T) ** 2).sum(1)


def test_robust_determinant_against_many_random_starts():
    rng = np.random.default_rng(9)
    for n in (60, 200):
        data = np.array([r[2] for r in clouds(rng, [n])])
        low, middle, high = np.quantile(data, [0.25, 0.5, 0.75], axis=0)
        scale = robust.scale_of(low, high)
        found = []
        for start in robust.first_models(middle, scale, [t.T @ t / n for t in robust.transforms((data - middle) / scale)]):
            kept = data[robust.distances(data, start) <= np.quantile(robust.distances(data, start), 0.5)]
            for _ in range(60):
                d = robust.distances(data, robust.fitted(kept))
                kept = data[d <= np.quantile(d, 0.75)]
            found.append(np.linalg.slogdet(np.cov(kept.T, bias=True))[1])
        assert min(found) <= determinant(data, 0.75, 200, rng) + 0.1  # neither search is exhaustive


@pytest.mark.parametrize("class_bytes", [64 << 20, 0])
def test_robust_distances_in_a_task_and_over_the_table(spark, class_bytes):
    rows = clouds(np.random.default_rng(4), [90, 300, 6])
    odd = [(900, "c0", None, False), (901, "c0", [1.0, 2.0, math.nan, 0.0], False), (902, "c1", [1.0, None, 0.0, 0.0], False), (903, "c1", [math.inf, 0.0, 0.0, 0.0], False)]
    df = spark.createDataFrame(rows + odd, "k long, cls string, x array<double>, bad boolean").repartition(5)
    got = {(r.cls, r.k): r for r in outliers.robust_mahalanobis(df, "cls", "x", 4, class_bytes=class_bytes).collect()}
    assert len(got) == len(rows) + 4
    assert all(got[r[1], r[0]].mahalanobis_score is None and not got[r[1], r[0]].flag_mahalanobis for r in odd)
    for c in ("c0", "c1"):
        mine = [r for r in rows if r[1] == c]
        want = brute_robust(np.array([r[2] for r in mine]))
        np.testing.assert_allclose([got[c, r[0]].mahalanobis_score for r in mine], want, rtol=1e-6)
        assert all(got[c, r[0]].flag_mahalanobis for r in mine if r[3])
        assert [got[c, r[0]].flag_mahalanobis for r in mine] == [bool(w >= chi2_quantile(0.975, 4)) for w in want]
    small = np.array([r[2] for r in rows if r[1] == "c2"])
    cov = np.linalg.pinv(np.cov(small.T, bias=True))
    want = np.einsum("ij,jk,ik->i", small - small.mean(0), cov, small - small.mean(0))
    np.testing.assert_allclose([got["c2", r[0]].mahalanobis_score for r in rows if r[1] == "c2"], want, rtol=1e-6)


def test_models_of_any_size_score_alike(spark, monkeypatch):
    rows = clouds(np.random.default_rng(6), [40, 50])
    df = spark.createDataFrame(rows, "k long, cls string, x array<double>, bad boolean")
    models = matrix.fit_models(matrix.moments(df, "cls", "x", 4), "cls", 4, lambda n, mean, cov: (mean, matrix.whitening(cov), 2.0))
    one = {(r.cls, r.k): r.s for r in matrix.score(df, models, "cls", "x", "s").collect()}
    monkeypatch.setattr(matrix, "SMALL_BYTES", 1)
    two = {(r.cls, r.k): r.s for r in matrix.score(df, models, "cls", "x", "s").collect()}
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)


def test_squares_add_up(spark):
    """The mean squared distance of a class is its dimension, and residuals of all components but the first ones add up to what those explain not."""
    rows = clouds(np.random.default_rng(8), [200, 80], p=5)
    df = spark.createDataFrame(rows, "k long, cls string, x array<double>, bad boolean")
    means = {r.cls: r.m for r in outliers.mahalanobis(df, "cls", "x", 5).groupBy("cls").agg(F.avg("mahalanobis_score").alias("m")).collect()}
    assert all(m == pytest.approx(5.0) for m in means.values())
    errors = outliers.pca_reconstruction(df, "cls", "x", 5).groupBy("cls").agg(F.avg("pca_reconstruction_error").alias("e")).collect()
    for r in errors:
        values = np.linalg.eigvalsh(np.cov(np.array([x[2] for x in rows if x[1] == r.cls]).T, bias=True))
        assert r.e == pytest.approx(values[: 5 - math.ceil(0.7 * 5)].sum() / 5)


def walked_depth(nodes, row):
    at = 0
    while nodes[at][0] >= 0:
        at = nodes[at][2] if row[nodes[at][0]] <= nodes[at][1] else nodes[at][3]
    return nodes[at][4]


def test_flattened_forests_walk_like_their_trees():
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 3))
    data[5] = data[6]
    trees = [outliers._grow(data[rng.choice(300, 64, replace=False)], rng) for _ in range(12)]
    flat = {k: np.array(v) for k, v in outliers.flattened(trees).items()}
    want = [sum(walked_depth(t, row) for t in trees) for row in data]
    np.testing.assert_allclose(outliers.path_lengths(data, flat), want)


@pytest.mark.parametrize("slice_rows", [50_000, 37])
def test_isolation_of_a_hot_class_in_slices(spark, slice_rows):
    """One class holds most rows; scores do not depend on slices, and odd vectors have none."""
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 9 == 0 else "big" if i % 9 else "x", (rng.normal(size=3) + (30 if i == 100 else 0)).tolist()) for i in range(600)]
    rows += [(1000 + i, "tiny", [0.0, 1.0, float(i)]) for i in range(4)] + [(2000, "big", None), (2001, "big", [math.inf, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, cls string, x array<double>").repartition(5)
    got = {r.k: r for r in outliers.isolation_forest(df, "k", "cls", "x", trees=40, subsample=64, slice_rows=slice_rows).collect()}
    assert len(got) == len(rows) and got[2000].isolation_forest_score is None and got[2001].isolation_forest_score is None
    assert all(got[1000 + i].isolation_forest_score == 0.0 and not got[1000 + i].flag_isolation_forest for i in range(4))
    scores = {k: r.isolation_forest_score for k, r in got.items() if k < 1000}
    assert max((k for k in scores if got[k].cls == "big"), key=scores.get) == 100 and got[100].flag_isolation_forest
    assert all(0 < s < 1 for s in scores.values())
    known = test_isolation_of_a_hot_class_in_slices.__dict__.setdefault("scores", scores)
    assert known == scores


def test_correlations_with_holes(spark):
    rng = np.random.default_rng(3)
    df = pd.DataFrame(rng.normal(size=(500, 4)) + 1e6, columns=list("abcd"))
    df["b"] = df["a"] * 2 + rng.normal(size=500)
    df["e"] = 3.0
    df.loc[::7, "c"] = np.nan
    df.loc[::11, "d"] = np.inf
    got = {(r.feature_a, r.feature_b): r.r for r in stats.correlations(spark.createDataFrame(df).repartition(4), list("abcde")).collect()}
    want = df.replace(np.inf, np.nan).corr()
    for a in "abcd":
        for b in "abcd":
            assert got[a, b] == pytest.approx(want.loc[a, b], abs=1e-9)
    assert len(got) == 25 and got["e", "e"] is None and got["a", "e"] is None


def test_neighbour_scores_in_tasks_equal_those_by_windows(spark):
    """Ties, a class of one row, a null class and missing values; the values of a feature are met once for all resamples."""
    rng = np.random.default_rng(12)
    rows = [(i, "abc"[i % 3] if i % 10 else None, float(rng.normal() + i % 3), float(rng.integers(0, 5)), None if i % 7 == 0 else float(rng.random())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, cls string, u double, v double, w double").repartition(3)
    alone = df.unionByName(spark.createDataFrame([(999, "z", 0.5, 1.0, 0.5)], df.schema))
    long = stats.unpivot(alone, ["cls"], ["u", "v", "w"])
    got, want = ({r["feature"]: r["information"] for r in stats.neighbour_information(long, ["feature"], "cls", task_rows=n).collect()} for n in (1000, 0))
    assert got.keys() == want.keys() == {"u", "v", "w"} and all(abs(got[f] - want[f]) < 1e-9 for f in got)
    ranked = selection.balanced_ranking(df, "id", "cls", ["u", "v", "w"], 5)
    wide = selection.balanced_ranking(df, "id", "cls", ["u", "v", "w"], 5, task_rows=0)
    pd.testing.assert_frame_equal(ranked.toPandas(), wide.toPandas(), rtol=1e-8)
    assert stats.fits_in_tasks(long, ["feature"]) and not stats.fits_in_tasks(long.withColumn("value", F.lit(float("nan"))), ["feature"])


def test_resamples_of_one_partition_are_drawn_on_all_cores(spark):
    df = spark.range(300).selectExpr("id", "id % 3 AS cls").coalesce(1)
    drawn = selection.resample(df, "id", "cls", 4)
    assert drawn.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert drawn.count() == 4 * 300


def test_memory_of_a_class_fitted_in_one_task():
    import tracemalloc

    data = np.random.default_rng(4).normal(size=(60_000, 32))
    data[:900] *= 7
    tracemalloc.start()
    centre, rows = robust.fit_here(data, 0.75, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * data.nbytes  # copies of the class are not held
    near = robust.distances(data, (centre, rows))
    assert np.percentile(near[:900], 5) > np.percentile(near[900:], 95)


def test_rows_that_ask_a_block_together_are_bounded():
    from tabularium.operators import knn

    assert knn.ASKING * knn.SLICE_ROWS * 64 * 8 <= 20 << 20  # bytes of vectors of 64 numbers
