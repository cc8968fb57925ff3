import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tabularium.llm import bytepair, queries
from tabularium.session import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [None, "", "a", " a b", "tab\there \n\n x", "é" * 700, "don't they'll I'VE 'll", "　 wide  space", "<|endoftext|>", "🙂 ok\r\n", "日本語 text " * 300,
         "w" * 3000, " " * 3000 + "x", "a1b2 " * 500, "we'll " * 900, ("lorem ipsum, " * 100 + "\n") * 4]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 256), (97, 20), (50, 3)])
def test_ids_as_by_the_library(spark, library, chunk, overlap):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(15, TEXTS[15], "again")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bytepair.encode(df, RANKS, PATTERN, chunk, overlap, decoded=True).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    for r in out:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_stitching_against_one_pass(library):
    c = bytepair.codec(RANKS, PATTERN)
    rng = np.random.default_rng(1)
    for _ in range(300):
        text = "".join(rng.choice(list("ab1 \n'.") + ["'ll", "'re", "  "], 200))
        chunks = [(s, c.ends(text[s:s + 25], s + 25 >= len(text))) for s in range(0, len(text), 20)]
        want = [m.end() for m in c.pattern.finditer(text)]
        assert c.stitch(text, chunks).tolist() == want


def test_decode_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None)], "doc_id long, text string")
    ids = bytepair.encode(df, RANKS, PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in bytepair.decode(ids, RANKS, PATTERN).collect()} == {1: b"hello", 2: b""}
    assert bytepair.encode(df.limit(0), RANKS, PATTERN).collect() == []


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    out = queries.op4_bytepair(spark, folder).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
