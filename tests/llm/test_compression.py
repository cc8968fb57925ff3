import random
import re

import pytest
import zstandard

from tabularium.llm import compression, queries
from tabularium.session import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, window=8):
    text = text or ""
    ws = WORD.findall(text)
    grams = [tuple(ws[i:i + window]) for i in range(len(ws) - window + 1)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + window)} if len(grams) < 400 else fast_cover(grams, window)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed, not failed and method(text.encode())


def fast_cover(grams, window):
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    return {p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + window)}


def fits(body, bands):
    ratio = len(zstandard.ZstdCompressor(level=3).compress(body)) / len(body)
    limit = None
    for size, low, high in bands:
        if len(body) >= size:
            limit = low, high
    return limit is None or limit[0] <= ratio <= limit[1]


def method(body):
    if not body:
        return True
    chunks = [body[i:i + 4096] for i in range(0, len(body), 4096)] if len(body) > 4096 else []
    chunks = [c for c in chunks if len(c) >= 1024]
    bad = sum(len(c) for c in chunks if not fits(c, compression.CHUNKS))
    return fits(body, compression.WHOLE) and bad <= 0.25 * sum(map(len, chunks))


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(n))


def prose(rng, n):
    syllables = ["tion", "an", "er", "the", "of", "ly", "in", "is", "re", "qu", "ou", "men", "st", "ble"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def made():
    rng = random.Random(2)
    base = "w1 w2 w3 w4 w5 w6 w7 w8"
    return [
        None, "", " \n\t ", "a", "x " * 19, "x " * 20, "\n".join(["same line here", " ", "same line here", "", "same line here "]), base + " y " + base, base + " " + base[:-1],
        "é ü # * <tag> | " * 9, "a b a b a b a b a b a b a b a b", prose(rng, 40), prose(rng, 900), prose(rng, 20_000), noise(rng, 100), prose(rng, 700) + noise(rng, 500),
        prose(rng, 3000) + " zz" * 9000, "word" * 400_000, prose(rng, 30) + "\r\n" + prose(rng, 30), "a\x0bb c\x00d",
    ]


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = made() + [" ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(80)] + ["\n".join(rng.choice(["p q", "p", "", " "]) for _ in range(12)) for _ in range(30)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 9), (None, texts[12], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) for r in compression.judge(df).collect()), key=repr)
    assert got == sorted(((k, *brute(t)) for k, t, _ in rows), key=repr)


def test_bands_reject_repeats_and_noise(spark):
    rng = random.Random(4)
    texts = [prose(rng, 60), prose(rng, 800), prose(rng, 9000), noise(rng, 60), "ab cd ef " * 900, prose(rng, 1500) + noise(rng, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in compression.judge(df, window=10_000).collect()}  # without the base rule on windows
    assert [out[i].kept for i in range(6)] == [True, True, True, False, False, False]
    assert out[5].bad_share > 0.25 and compression.WHOLE[3][1] < out[5].ratio < 0.9


def test_empty_table(spark):
    assert compression.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_against_brute_force(spark, folder):
    want = {r.doc_id: brute(r.text) for r in table(spark, folder, "documents").collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in queries.op12_compression(spark, folder).collect()}
    assert got == want


def test_texts_labelled_good_stay(spark):
    folder = "/root/testdata/sf0.1"
    kept = queries.op12_compression(spark, folder).join(table(spark, folder, "labels").filter("quality = 1"), "doc_id")
    r = kept.selectExpr("avg(CASE WHEN kept OR base_failed THEN 1 ELSE 0 END) AS a").first()
    assert r.a > 0.995
