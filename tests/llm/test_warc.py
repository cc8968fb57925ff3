import base64
import gzip
import hashlib
import io
import tempfile
import zlib

import pytest

from tabularium.llm import queries, warc
from tabularium.session import table


def brute(rows, least=0):
    first = {}
    for p, html in rows:
        if len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", p), p)
    out = []
    for p, html in rows:
        raw = (html or "").encode()
        to = first.get(html or "", p)
        out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to == p else "revisit", None if to == p else to))
    return sorted(out)


def fields(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.fixture
def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")


ROWS = [(1, "a" * 100), (2, "b\r\n\r\nc"), (3, "a" * 100), (4, None), (5, ""), (6, "é" * 200_000), (7, "b\r\n\r\nc"), (8, "x")]


@pytest.mark.parametrize("least", [0, 50])
def test_round_trip(spark, folder, least):
    df = spark.createDataFrame([(p, f"http://h/{p}\r\n ü", t, 1) for p, t in ROWS], "page_id long, url string, html string, payload int").repartition(3)
    marked = warc.with_revisits(df, least=least)
    archives = warc.normalise(warc.write_monoliths(marked, folder, file_bytes=1000), folder)
    index = warc.read_index(archives, folder)
    out = warc.read_records(index, folder)
    assert fields(out) == brute(ROWS, least)
    texts = dict(ROWS)
    for r in out.collect():
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == (texts[r.page_id] or "").encode())
    for r in index.collect():  # each record is a member of its own, and the file is one valid gzip file
        raw = open(r.path, "rb").read()
        one = zlib.decompressobj(31)
        assert one.decompress(raw[r.offset:r.offset + r.length]).startswith(b"WARC/1.1\r\n") and one.eof and not one.unused_data
        assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().count(b"WARC/1.1\r\n") >= 1


def test_nulls_repeats_and_empty_table(spark, folder):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "u", "x"), (2, "u", None)], "page_id long, url string, html string")
    out = warc.round_trip(df, folder).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in out) == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None)]
    assert warc.round_trip(df.limit(0), folder).collect() == []


def test_cut_archive_is_an_error():
    raw = warc.record(1, "u", b"payload", None, "d")
    press = zlib.compressobj(3, zlib.DEFLATED, 31)
    data = press.compress(raw + raw[:-5]) + press.flush()
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(data), zlib.decompressobj(31)))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in table(spark, folder, "pages").collect()]
    assert fields(queries.op10_warc(spark, folder)) == brute(rows)
