import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabularium.llm import queries, toxicity
from tabularium.session import table


@pytest.fixture(scope="module")
def model():
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("aeioubdgklmnprst"), 6))
    rows = []
    for i in range(240):
        w = [word() for _ in range(60)]
        if i % 2:
            for k in r.integers(0, 60, 3):
                w[k] = r.choice(["horridness", "wretched", "despicable"])
        rows.append((i % 2, " ".join(w)))
    return toxicity.fit(rows, 0.2)


def test_misspellings_share_their_grams(model):
    clean, toxic, odd = model.predict(pa.array(["monday tuna grip bonds" * 3, "monday wretched tuna", "monday wretchedd tuna horridnes"]))
    assert clean < 0.5 < toxic and odd > 0.5


def test_a_long_text_does_not_dilute(model):
    text = "monday tuna grip bonds " * 400
    plain, spoiled = model.predict(pa.array([text, text + "wretched " + text]))
    assert plain < 0.5 < spoiled


def test_edge_texts(spark, model):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !", "a"), (4, "wretched", "a"), (4, "wretched", "a")], "doc_id long, text string, score string")
    out = sorted((r.doc_id, r.score) for r in toxicity.score(df, model).collect())
    assert len(out) == 5 and out[0][1] == out[1][1] == out[2][1] < 0.5 < out[3][1] <= 1
    assert toxicity.score(df.limit(0), model).collect() == []


def test_one_kind_of_label_gives_the_base_rate(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    for rows in ([], [(1, 0)], [(1, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert all(r.score < 0.01 for r in toxicity.score(docs, toxicity.train(docs, labels)).collect())


def test_windows_cover_every_word():
    first = np.array([0, 0, 3, 60, 61])
    a, b, text = toxicity.windows(first, 10)
    covered = {i for x, y in zip(a, b, strict=True) for i in range(x, y)}
    assert covered == set(range(61)) and set(text) == {1, 2, 3}
    assert all(first[t] <= x < y <= first[t + 1] for x, y, t in zip(a, b, text, strict=True))


def test_query_held_out(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    out = queries.op9_toxicity(spark, folder).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == int(r.score >= 0.5) for r in out)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and truth.get(r.doc_id) is not None]
    hits = sum(p and t for p, t in held)
    assert hits / sum(t for _, t in held) > 0.75 and hits / max(1, sum(p for p, _ in held)) > 0.8
    scores = sorted((r.score, truth[r.doc_id]) for r in out if r.held_out and truth.get(r.doc_id) is not None)
    ones = sum(t for _, t in scores)
    above = sum(i for i, (_, t) in enumerate(scores) if t) - ones * (ones - 1) / 2
    assert above / (ones * (len(scores) - ones)) > 0.95  # area under the curve
