import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tabularium.llm import common, packing, queries
from tabularium.session import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", " a", "a ", "  a  b\n c 　d  e", "x\n\ny", "it's we'll 'RE " * 400, "z" * 5000, "word " * 9000, "<|endoftext|> ok", "a b c", "x \0y \0"] + [f"tok{i} " * i for i in range(300)]


def reference():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def check(pieces, texts, capacity=1024):
    """Every id once, sequences gapless and within the capacity; the padding."""
    encode, by_doc, by_sequence = reference(), defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(texts)
    for k, own in by_doc.items():
        ids, at = encode(texts[k]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            part = struct.pack(f"<{p.length}I", *ids[at:at + p.length])
            assert (p.ids_crc32 if "ids_crc32" in p else zlib.crc32(p.ids)) == zlib.crc32(part)
            at += p.length
        assert at == len(ids)
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(n for parts in by_sequence.values() for _, n in parts)


def test_pieces_of_awkward_texts(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int").repartition(3)
    assert check(packing.pack(df, PATH).collect(), dict(enumerate(TEXTS))) < 0.02


def test_other_stages_do_not_keep_the_memo(monkeypatch):
    held = packing._encoder.cache_info
    common.release()
    for stage, left in ((1, 1), (1, 1), (2, 0)):
        monkeypatch.setattr(common, "_stage", lambda stage=stage: stage)
        if stage == 1:
            common.kept_for_stage(packing._encoder.cache_clear)
            packing._encoder(PATH, False)(["a word"])
        common.release()
        assert held().currsize == left


def test_memo_of_a_stage_in_its_workers(spark):
    def count(batches):
        common.release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([packing._encoder.cache_info().currsize] * batch.num_rows, pa.int64())], ["n"])

    df = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    assert packing.pack(df, PATH).count() == 64
    assert {r.n for r in df.select("doc_id").mapInArrow(count, "n long").collect()} == {0}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two")] * 3, "doc_id long, text string")
    out = packing.pack(df, PATH).collect()
    assert sum(p.length for p in out) == 9 and {p.doc_tokens for p in out} == {3}
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_long_text_in_segments(spark):
    text = "alpha beta  gamma\n delta " * 60000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    check(packing.pack(df, PATH).collect(), {1: text})


def test_special_tokens_in_texts_as_the_plain_call_gives_them(spark, tmp_path):
    texts = [*TEXTS, "<|endoftext|>", "a <|endoftext|>b  <|endoftext|><|endoftext|> c", "word " * 300_000 + "x<|endoftext|> y", "<|endoftext|", "日本<|endoftext|>語"]
    plain = Tokenizer.from_file(PATH)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (packing.pack(df, PATH, special=True), corpus_pipeline.pack_sequences(spark, df, "")):
        own = defaultdict(list)
        for p in out.collect():
            own[p.doc_id].append(p)
        for i, ids in enumerate(want):
            assert b"".join(p.ids for p in sorted(own[i], key=lambda p: p.start)) == struct.pack(f"<{len(ids)}I", *ids)
            assert {p.doc_tokens for p in own[i]} == {len(ids)}
    for p in queries.op2_packing(spark, str(tmp_path)).collect():
        ids = want[p.doc_id][p.start:p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{p.length}I", *ids))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    assert check(queries.op2_packing(spark, folder).collect(), texts) < 0.01


def test_bins_of_one_class_hold_a_fixed_number():
    bins = packing.Bins(1024, 64, 0)
    for k in range(48):
        bins.add(k, bytes(4 * 63))
    bins.finish()
    assert [sum(1 for s, _, _ in bins.ready if s == n) for n in range(3)] == [16, 16, 16]
