import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tabularium.llm import language
from tabularium.session import table
from tests.llm import test_jaccard, test_packing, test_secrets, test_substrings

FOLDER = "/root/testdata/sf0.001"


def redacted(text):
    spans = [s.split(":") for s in test_secrets.brute(text).split(",") if s]
    out, at = [], 0
    for _, a, b in spans:
        if int(a) >= at:
            out += [text[at:int(a)], "[SECRET]"]
        at = max(at, int(b))
    return "".join(out) + text[at:]


def test_stages_and_run_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    names = docs.columns
    field = language.train(docs, allowed=~language.held_out("doc_id", 4, 2))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows.update({70001: None, 70002: "12 34 !"})
    extra = spark.createDataFrame([(i, rows[i], "en", "s", 0) for i in (70001, 70002)], docs.schema)
    docs = docs.unionByName(extra)

    kept = corpus_pipeline.identify_language(spark, docs, FOLDER)
    assert kept.columns == names
    predicted = {i: p for i, p in zip(rows, zip(*field.predict(pa.array(list(rows.values()))), strict=True), strict=True)}
    rows = {i: t for i, t in rows.items() if predicted[i][0] != "und" and predicted[i][1] >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id: r.text for r in kept.collect()} == rows and len(rows) >= 198

    alone = corpus_pipeline.drop_near_duplicates(spark, kept, FOLDER)
    assert alone.columns == names
    heads = {d for d, _, c in test_jaccard.brute(list(rows.items()), 5, 80) if d == c}
    assert len(heads) < len(rows)
    rows = {i: t for i, t in rows.items() if i in heads}
    assert {r.doc_id: r.text for r in alone.collect()} == rows

    fresh = corpus_pipeline.drop_repeated_passages(spark, alone, FOLDER)
    assert fresh.columns == names
    want = {d: [x for x, y in zip(w, gone, strict=True) if not y] for d, w, gone in test_substrings.brute(list(rows.items()), 13)}
    got = {r.doc_id: r for r in fresh.collect()}
    assert {d: test_substrings.WORD.findall(r.text) for d, r in got.items()} == {d: w for d, w in want.items() if w}
    assert all(r.n_chars == len(r.text) for r in got.values())
    rows = {d: r.text for d, r in got.items()}

    safe = corpus_pipeline.redact_secrets(spark, fresh, FOLDER)
    assert safe.columns == names
    rows = {d: redacted(t) for d, t in rows.items()}
    assert {r.doc_id: r.text for r in safe.collect()} == rows and any("[SECRET]" in t for t in rows.values())

    test_packing.check(corpus_pipeline.pack_sequences(spark, safe, FOLDER).collect(), rows)


def test_repeated_rows_leave_one_of_each_set_of_shingles(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    rows = [(1, a), (1, a), (1, a.replace(" ", "  ")), (1, b), (2, a), (3, c), (None, c), (None, c), (None, a), (4, None), (4, None), (5, " "), (5, " ")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], table(spark, FOLDER, "documents").schema).repartition(5)
    out = corpus_pipeline.drop_near_duplicates(spark, df, FOLDER)
    assert out.columns == df.columns
    got = sorted([(r.doc_id, r.text) for r in out.collect()], key=str)
    assert got == sorted([(1, a.replace(" ", "  ")), (1, b), (3, c), (None, c), (None, a), (4, None), (5, " ")], key=str)


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(out) > 100 and all(len(r.ids) == 4 * r.length for r in out)
    assert np.frombuffer(out[0].ids, "<u4").max() < 50257 and zlib.crc32(out[0].ids)


def test_empty_table(spark):
    docs = table(spark, FOLDER, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.collect() == []
