import itertools
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabularium.llm import language, queries
from tabularium.session import table


def test_forward_backward_against_all_labelings():
    r = np.random.default_rng(0)
    first = np.array([0, 1, 1, 6, 11])
    scores, move = r.normal(size=(11, 3)), r.normal(size=(3, 3))
    want = np.zeros((11, 3))
    for a, b in itertools.pairwise(first):
        total = 0
        for path in itertools.product(range(3), repeat=b - a):
            w = np.exp(sum(scores[a + i, y] for i, y in enumerate(path)) + sum(move[x, y] for x, y in itertools.pairwise(path)))
            # the first word follows any label alike
            w *= np.exp(move[:, path[0]]).sum() if path else 1
            total += w
            for i, y in enumerate(path):
                want[a + i, y] += w
        if b > a:
            want[a:b] /= total
    assert np.allclose(language.marginals(scores, first, move), want)


def test_long_chains_do_not_depend_on_segments(monkeypatch):
    r = np.random.default_rng(1)
    first = np.array([0, 700, 703, 1000])
    scores, move = r.normal(size=(1000, 4)), r.normal(size=(4, 4))
    whole = language.marginals(scores, first, move)
    monkeypatch.setattr(language, "SEGMENT", 7)
    assert np.allclose(language.marginals(scores, first, move), whole)


def test_transition_expectations_against_marginals():
    r = np.random.default_rng(2)
    chain = np.array([0, 5, 9])
    scores, move = r.normal(size=(9, 3)), r.normal(size=(3, 3))
    follow = np.array([1, 2, 3, 4, 6, 7, 8])
    joint = language.pairs(scores, chain, move, follow)
    assert np.allclose(joint.sum(axis=0), language.marginals(scores, chain, move)[follow].sum(axis=0))


@pytest.fixture(scope="module")
def field():
    rows = [("x", "the cat sat on the mat and that was the thing with them"), ("y", "der hund und die katze mit dem ball ist nicht gut")] * 10
    return language.fit(rows, epochs=15)


def test_edge_texts(spark, field):
    rows = [(1, "The thing that sat"), (2, "DER hund und die katze"), (3, None), (4, ""), (5, "123 -- !!"), (6, "…"), (6, "…")]
    df = spark.createDataFrame([(d, t, "zz") for d, t in rows], "doc_id long, text string, lang_pred string")
    out = sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(df, field).collect())
    assert [x[:2] for x in out] == [(1, "x"), (2, "y"), (3, "und"), (4, "und"), (5, "und"), (6, "und"), (6, "und")]
    assert all(0 <= s <= 1 for _, _, s in out) and all(s == 0 for _, n, s in out if n == "und")
    assert language.identify(df.limit(0), field).collect() == []
    assert [r.doc_id for r in language.keep_identified(df, field, 0.4).orderBy("doc_id").collect()] == [1, 2]


def test_emissions_do_not_depend_on_runs_of_words(field, monkeypatch):
    texts = pa.array(["the cat sat on the mat and der hund", None, "", "x" * 300_000, "katze 'it's' été nicht the"] * 3)
    want = field.predict(texts)
    monkeypatch.setattr(language, "WORDS", 3)
    got = field.predict(texts)
    assert got[0] == want[0] and (got[1] == want[1]).all()


def test_features_of_many_distinct_words_are_not_held_at_once(field):
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17_576)}wort" for i in range(200_000))
    column = pa.array([text])
    tracemalloc.start()
    field.predict(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20


def test_code_switch_lies_between(field):
    _, score = field.predict(pa.array(["the cat sat on the mat and der hund und die katze mit", "the cat sat on the mat"]))
    assert score[0] < 0.8 < score[1]


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    none = language.train(df)
    assert [(r.lang_pred, r.score) for r in language.identify(df, none).collect()] == [("und", 0.0)]


def test_query_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in table(spark, folder, "documents").collect()}
    out = queries.op8_language(spark, folder).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
