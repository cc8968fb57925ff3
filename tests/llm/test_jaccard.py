import random
import re

import numpy as np
import pytest

from tabularium.llm import jaccard, queries
from tabularium.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, num):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= num * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


def near_copies(seed, n):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(3000)}" for _ in range(r.choice([5, 8, 12, 20, 40, 90, 200, 400]))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randrange(0, 1 + len(w) // 20)):
            k = r.randrange(len(w))
            r.choice([lambda k=k: w.__setitem__(k, f"x{r.randrange(99)}"), lambda k=k: w.insert(k, "y"), lambda k=k: len(w) > 4 and w.pop(k)])()
        out.append((i * 13 % 2003, " ".join(w)))
    return out


@pytest.mark.parametrize(("size", "num"), [(4, 85), (5, 80), (1, 60)])
def test_against_brute_force(spark, size, num):
    rows = [*near_copies(size, 320), (9000, None), (9001, ""), (9002, "\n "), (9003, "Only THREE words"), (9004, "only three words")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component int").repartition(4)
    got = sorted(tuple(r) for r in jaccard.join_components(df, size, num).collect())
    assert got == brute(rows, size, num)


def test_linked_sets_share_enough_searching_keys():
    r = np.random.default_rng(3)
    for _ in range(400):
        n = int(r.integers(1, 120))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        cut = int(r.integers(0, 1 + n // 6))
        b = np.concatenate([a[cut:], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 6)), dtype=np.uint64) * np.uint64(2)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 85 * (len(a) + len(b) - common):
            continue
        doc, keys, search, need = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85, 100)
        sides = [{k: (bool(s), m) for k, s, m in sorted(zip(*(x[doc == d].tolist() for x in (keys, search, need)), strict=True))} for d in (0, 1)]
        shared = [min(sides[0][k][1], sides[1][k][1]) for k in sides[0].keys() & sides[1].keys() if sides[0][k][0] or sides[1][k][0]]
        assert shared and len(shared) >= min(shared)


def test_chain_repeated_rows_and_null_ids(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [(10 - i, " ".join(base[i * 6:] + [f"n{j}" for j in range(i * 6)])) for i in range(5)]
    rows = [*chain, chain[0], (None, chain[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join_components(df, 4, 85).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(d, c) for d, _, c in brute(chain, 4, 85)}
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_empty_table(spark):
    assert jaccard.join_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    got = sorted(tuple(r) for r in queries.op7_jaccard(spark, folder).collect())
    assert got == brute(rows, 4, 85)
    assert any(c != d for d, _, c in got)


def family(n, words, edits, seed=5):
    """Copies of one text with so many words of each replaced by words of its own: alike, and unlinked with enough edits."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{j}" for j in range(words)]
        for k in r.sample(range(words), edits(i)):
            w[k] = f"own{i}x{k}"
        out.append((i, " ".join(w)))
    return out


def test_alike_but_unlinked_documents_are_not_paired(spark, monkeypatch):
    rows = family(160, 300, lambda i: 7 + i % 4)
    verified, before = [], jaccard.linked
    monkeypatch.setattr(jaccard, "linked", lambda pairs, *rest: (verified.append(pairs.count()), before(pairs, *rest))[1])
    got = sorted(tuple(r) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85).collect())
    assert got == brute(rows, 4, 85)
    assert len({c for _, _, c in got}) == len(rows)
    assert sum(verified) < 2 * len(rows)


def test_family_round_the_threshold_and_a_long_text(spark):
    rows = family(90, 200, lambda i: i % 6)
    long = [f"v{i}" for i in range(30_000)]
    rows += [(500, " ".join(long)), (501, " ".join(long[1000:])), (502, " ".join(long[9000:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard.join_components(df, 4, 85).collect()) == brute(rows, 4, 85)


def test_an_id_with_two_texts_joins_their_classes(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    df = spark.createDataFrame([(7, a), (7, b), (3, b), (9, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.join_components(df, 4, 85).collect()} == {(7, 3), (3, 3), (9, 3)}


def test_shared_counts_and_part_counts():
    r = np.random.default_rng(1)
    for wide in (2, 3):
        x = r.integers(0, 1 << 8 * wide, 1000)
        assert (jaccard.unplaned(jaccard.planes(x, wide), wide) == x).all()
    a, b = (r.integers(0, 1 << 63, 700, dtype=np.uint64) for _ in range(2))
    b[:600] = a[:600]
    one, two = (jaccard.part_counts(np.sort(x), np.array([0, 700])).view(np.uint8).astype(int) for x in (a, b))
    step = (one - two) % 256
    assert 0 < np.minimum(step, 256 - step).sum() <= 200


def test_parities_bound_the_difference_from_below():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 40, 300, 3000)]
    sets.append(np.sort(np.concatenate([sets[3][30:], r.integers(0, 1 << 63, 20, dtype=np.uint64)])))
    first = np.append(0, np.cumsum([len(x) for x in sets]))
    odd = jaccard.parities(np.concatenate(sets), first)
    apart = [[int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) for b in odd] for a in odd]
    for a, row in zip(sets, apart, strict=True):
        for b, least in zip(sets, row, strict=True):
            assert least <= len(np.setxor1d(a, b)) and least % 2 == len(np.setxor1d(a, b)) % 2
    assert apart[3][5] > 40


def test_last_round_forms_a_pair_once_and_few_beyond_the_bound(spark, monkeypatch):
    rows = [(1000 + i, t) for i, t in family(120, 160, lambda i: 3 + i % 3, seed=11)]  # most differ by a little more than linked sets
    rows += [(d - 1000, t.replace("w", "v")) for d, t in rows[::2]]
    formed, before = [], jaccard.across

    def across(*args):
        pairs = before(*args)
        formed.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(jaccard, "across", across)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in jaccard.join_components(df, 4, 85).collect())
    assert got == brute(rows, 4, 85)
    sets = [(d, shingles(t, 4)) for d, t in rows]
    linked = sum(100 * len(s & t) >= 85 * len(s | t) for i, (_, s) in enumerate(sets) for _, t in sets[:i])
    assert formed and all(rows <= 1.05 * pairs + 2 and pairs <= linked for rows, pairs in formed)
