"""Greedy near-duplicates against a plain walk: long chains, stars, large components."""

import random

import pytest

from tabularium.operators import dedup


def walked(edges):
    gone = set()
    for late_pos, early, late in sorted((p, e, l) for e, l, p in edges):
        if early not in gone:
            gone.add(late)
    return gone


def graph(rng):
    """Chains, stars, cliques and random parts; a node's number is its position."""
    edges, base = set(), 0
    for size in (40, 25, 3, 2, 60):
        kind = rng.choice(["chain", "star", "clique", "random"])
        for i in range(size):
            if kind == "chain" and i:
                edges.add((base + i - 1, base + i))
            elif kind == "star" and i:
                edges.add((base, base + i))
            elif kind == "clique":
                edges |= {(base + j, base + i) for j in range(i)}
            elif kind == "random" and i:
                edges |= {(base + rng.randrange(i), base + i) for _ in range(2)}
        base += size
    return [(e, l, l) for e, l in edges]


@pytest.mark.parametrize("few", [80, 2_000_000])
def test_dropped_ends(spark, few):
    edges = graph(random.Random(1))
    df = spark.createDataFrame(edges, "early long, late long, late_pos long").repartition(3)
    got = [r.late for r in dedup.dropped(df, few, rounds=1).collect()]
    assert len(edges) > 120 and sorted(got) == sorted(walked(edges))


def test_components(spark):
    edges = graph(random.Random(5)) + [(1000 + i, 1001 + i, 0) for i in range(60)]
    df = spark.createDataFrame(edges, "early long, late long, late_pos long")
    near = {}
    for e, l, _ in edges:
        near.setdefault(e, set()).add(l)
        near.setdefault(l, set()).add(e)
    want = {}
    for node in sorted(near):
        if node not in want:
            todo = [node]
            while todo:
                n = todo.pop()
                if n not in want:
                    want[n] = node
                    todo += near[n]
    assert {r.node: r.component for r in dedup.components(df).collect()} == want


def test_a_chain_of_ten_thousand_links_takes_few_jobs(spark):
    n = 10_000
    df = spark.range(n).selectExpr("id AS early", "id + 1 AS late", "id + 1 AS late_pos")
    context = spark.sparkContext
    context.setJobGroup("chain", "chain")
    gone = dedup.dropped(df)
    got = {r.late for r in gone.collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("chain"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == set(range(1, n + 1, 2)) and jobs <= 20
