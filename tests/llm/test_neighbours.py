import numpy as np
import pytest
from pyspark.sql import functions as F

from tabularium.llm import neighbours, queries
from tabularium.session import table


def brute(rows, k=20):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 8 and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, m = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    out = {}
    for i in sorted({i for i in ids if i % 20 == 0}):
        s = m @ m[np.flatnonzero(ids == i)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def gathered(df, name="vec_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r[name], r.score))
    for own in out.values():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda x: (-x[2], x[1])) or all(a[2] >= b[2] for a, b in zip(own, own[1:], strict=False))
    return out


def test_exact_where_all_lists_are_probed_and_no_test_rejects(spark):
    r = np.random.default_rng(0)
    rows = [(i, (r.normal(size=8) * r.uniform(0.1, 3)).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)]  # ties
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] + [1.0] * 7), (2080, [1.0] * 3), (None, [1.0] * 8), (2100, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = gathered(neighbours.search(df, F.col("id") % 20 == 0, list_rows=40, coverage=1.0, eps=1e6, block_rows=30, batch=7))
    want = brute(rows)
    assert got.keys() == want.keys()
    for q, own in want.items():
        assert [v for _, v, _ in got[q]] == [v for v, _ in own]
        assert np.allclose([s for _, _, s in got[q]], [s for _, s in own])


@pytest.mark.parametrize("rows", [[], [(20, [1.0] * 8)], [(1, [1.0] * 8), (2, [2.0] * 8)], [(20, [1.0] * 8), (21, [2.0] * 8), (40, [3.0] * 8)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = gathered(neighbours.search(df, F.col("id") % 20 == 0))
    assert {q: [v for _, v, _ in own] for q, own in got.items()} == ({20: [40, 21], 40: [21, 20]} if len(rows) == 3 else {})


@pytest.mark.parametrize("coverage", [0.5, 0.97])
def test_every_query_gets_its_full_number_beside_a_hot_group_of_copies(spark, coverage):
    r = np.random.default_rng(3)
    hot = r.normal(size=8)
    rows = [(i, (r.normal(size=8) * r.uniform(0.1, 3)).tolist()) for i in range(600)] + [(1000 + i, (2 * hot).tolist()) for i in range(300)]
    rows += [(5000 + 20 * i, (hot + r.normal(size=8) * 0.7).tolist()) for i in range(60)] + [(9000, [0.5] * 8)] * 5
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = gathered(neighbours.search(df, F.col("id") % 20 == 0, list_rows=20, coverage=coverage, block_rows=50, batch=16))
    assert got.keys() == {i for i, _ in rows if i % 20 == 0}
    assert {len(own) for own in got.values()} == {20}


def test_queries_left_short_get_the_exact_answer(spark):
    r = np.random.default_rng(6)
    rows = [(i, (r.normal(size=8) * r.uniform(0.1, 3)).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = gathered(neighbours.search(df, F.col("id") % 20 == 0, list_rows=4, coverage=0.0, block_rows=30, batch=7))  # one list a query
    want = brute(rows)
    assert got.keys() == want.keys()
    for q in (q for q in want if q < 1000):
        assert [v for _, v, _ in got[q]] == [v for v, _ in want[q]]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = gathered(queries.op6_neighbours(spark, folder))
    rows = sorted((r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect())
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        want = {int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q} if len(ids) <= 21 else set([int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:20])
        hits += len(want & {v for _, v, _ in got[int(q)]})
        total += len(want)
        for _, v, x in got[int(q)]:
            assert abs(s[np.flatnonzero(ids == v)[0]] - x) < 1e-12
    assert hits / total >= 0.9
    print("recall", hits / total)
