import hashlib
import random
import re

import pytest

from tabularium.llm import middle, queries
from tabularium.session import table

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def brute(key, text, rate=100, suffix_first=50):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    units = LINES.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "\n", "\n\n\n", "one", "a\nb", "a\nb\n", "é\nüü\n\nзз", "x<P>y\nz", "<", "a<\nP>\n<S\n", "<M\n<\n<S", "line\r\nnext\x0bstill", "w" * 300_000 + "\n" + "v" * 200_001, "k\n" * 5000]


def test_rotation_in_place():
    for size in (0, 1, 2, 7, 64):
        for at in range(size + 1):
            body = bytearray(range(size))
            middle.rotate(body, 0, at, size)
            assert list(body) == [*range(at, size), *range(at)]


def test_every_pair_of_cuts(monkeypatch):
    monkeypatch.setattr(middle, "STEP", 3)
    text = "ab\n<\ncdé\nf".encode()
    for b in range(len(text) + 1):
        for a in range(b + 1):
            p, m, s = text[:a], text[a:b], text[b:]
            for form, want in (("psm", b"<P>" + p + b"<S>" + s + b"<M>" + m), ("spm", b"<S>" + s + b"<P>" + p + b"<M>" + m)):
                body = bytearray(text)
                middle.arrange(body, a, b, form)
                assert bytes(body) == want
                middle.rebuild(body, form)
                assert bytes(body) == text


@pytest.mark.parametrize(("rate", "suffix_first"), [(100, 50), (60, 30)])
def test_against_brute_force(spark, rate, suffix_first):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab\n<é>") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a\nb\nc", "x", 2), (4, "one", "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, n int")
    out = middle.restore(middle.transform(df, rate=rate, suffix_first=suffix_first)).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out), key=repr)
    assert got == sorted(((k, *brute(k, t, rate, suffix_first), t or "") for k, t, *_ in rows), key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert middle.restore(middle.transform(df)).collect() == []


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {r.doc_id: (*brute(r.doc_id, r.text)[:4], sha(brute(r.doc_id, r.text)[4]), sha(r.text or "")) for r in table(spark, folder, "documents").collect()}
    got = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in queries.op13_middle(spark, folder).collect()}
    assert got == want and {v[1] for v in got.values()} >= {"psm", "spm"}
