import hashlib
import random
import re

import pytest

from tabularium.llm import queries, substrings
from tabularium.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Per row: words, removed flags."""
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out.append((d, w, gone))
    return out


def expected(rows, window):
    return sorted((d, len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for d, w, g in brute(rows, window))


def texts(seed, n, vocabulary=40, passages=6):
    r = random.Random(seed)
    word = lambda: r.choice(["á", "Ab", "c", "dd", "e."]) + str(r.randrange(vocabulary))
    common = [[word() for _ in range(r.randrange(8, 40))] for _ in range(passages)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            parts += r.choice(common) if r.random() < 0.5 else [word() for _ in range(r.randrange(30))]
        out.append((i * 7 % 1000, r.choice([" ", "\n", "  ", "\t"]).join(parts)))
    return out


@pytest.mark.parametrize("window", [13, 3])
def test_against_brute_force(spark, window):
    rows = [*texts(1, 150), (5000, None), (5001, ""), (5002, " \n "), (5003, "one two"), (5004, texts(1, 150)[3][1]), (5004, texts(1, 150)[3][1]), (-1, texts(1, 150)[9][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int").repartition(5)
    got = substrings.find_repeats(df, window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == expected(rows, window)
    by_id = dict(rows)
    for r in got:
        own = WORD.findall(by_id[r.doc_id] or "")
        for f in r.factors:
            assert f.length >= window and f.reference < r.doc_id
            assert " ".join(own[f.start:f.start + window]) in " ".join(WORD.findall(by_id[f.reference]))


def test_removed_rows_keep_their_columns(spark):
    rows = texts(2, 80)
    df = spark.createDataFrame([(d, t, "x", d) for d, t in rows], "doc_id long, text string, lang string, block long")
    got = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert got and all(r.block == r.doc_id and r.lang == "x" for r in got.values())
    for d, w, gone in brute(rows, 13):
        left = [x for x, y in zip(w, gone, strict=True) if not y]
        if w and not left:
            assert d not in got
        else:
            assert WORD.findall(got[d].text) == left
            if not any(gone):
                assert got[d].text == dict(rows)[d]


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.find_repeats(df).collect() == [] and substrings.remove_repeats(df).collect() == []
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (3, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_removed) for r in substrings.find_repeats(df).collect()) == [(False, 0), (True, 20), (True, 20)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_substrings(spark, folder).collect())
    assert got == [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in expected(rows, 13)]
    assert any(r[2] for r in got)
