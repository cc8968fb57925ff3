"""Operator 10, WARC: archives written as one gzip stream each, normalised to one member per record, read by an offset index.

``write_monoliths`` gives files that are a single gzip stream from first to last record. ``normalise`` inflates such a
stream once, rewrites every record as a member of its own and writes a sidecar index (path, offset, length, record).
``read_records`` opens archives at the indexed offsets only. All three stream; a task holds one record.

Files go to a folder that driver and executors share, under names that no other attempt uses; only names that a finished
task reported are read, so a lost or repeated task leaves nothing behind but unused files.

Of pages with equal payloads of at least ``least`` bytes the smallest page_id is a response and the others revisit it. Null
payloads are empty, null addresses are left out, a null page_id is kept (and never revisited if another has the payload).
Repeated rows of the smallest page_id are all responses. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tabularium.llm.common import parts, staged

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (``refers_to`` given) holds no payload, but its digest and length."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    block = HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~._-')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_monoliths(df: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write rows (page_id, url, payload, refers_to); returns (path) of each archive, staged so that it is written once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        sink = None
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    name = f"{root}/{uuid.uuid4().hex}.mono.warc.gz"
                    sink, press, size = store.open_output_stream(name, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                raw = record(row["page_id"], row["url"], row["payload"] or b"", row["refers_to"], date)
                sink.write(press.compress(raw))
                size += len(raw)
                if size >= file_bytes:
                    sink.write(press.flush())
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pylist([{"path": name}])
        if sink is not None:
            sink.write(press.flush())
            sink.close()
            yield pa.RecordBatch.from_pylist([{"path": name}])

    rows = df.select("page_id", "url", "payload", "refers_to")
    return staged(rows.mapInArrow(work, "path string"))


def records_of(stream, inflate) -> Iterator[bytes]:
    """Whole records of an archive, inflated once and in order."""
    held = bytearray()
    need = 0
    while True:
        data = stream.read(READ_BYTES)
        held += inflate.decompress(data) if data else inflate.flush()
        while True:
            if not need:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                size = next(line for line in bytes(held[:at]).split(b"\r\n") if line.lower().startswith(b"content-length:"))
                need = at + 4 + int(size.partition(b":")[2]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
        if not data:
            break
    if held:
        raise ValueError("archive ends inside a record")


def normalise(paths: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Rewrite each archive as one member per record, with a sidecar index beside it; returns (path, sidecar), staged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                name = f"{root}/{uuid.uuid4().hex}"
                offset = 0
                with (store.open_input_stream(source, compression=None) as stream, store.open_output_stream(f"{name}.warc.gz", compression=None) as out,
                      store.open_output_stream(f"{name}.idx", compression=None) as index):
                    for raw in records_of(stream, zlib.decompressobj(31)):
                        press = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = press.compress(raw) + press.flush()
                        out.write(member)
                        index.write(f"{name}.warc.gz\t{offset}\t{len(member)}\t{parse(raw)[0]['WARC-Record-ID']}\n".encode())
                        offset += len(member)
                yield pa.RecordBatch.from_pylist([{"path": f"{name}.warc.gz", "sidecar": f"{name}.idx"}])

    n = max(parts(paths.sparkSession), paths.count())
    return staged(paths.repartition(n).mapInArrow(work, "path string, sidecar string"))


def read_index(archives: DataFrame, folder: str) -> DataFrame:
    """Rows (path, offset, length, record) of all sidecars of finished archives."""
    spark = archives.sparkSession
    if archives.isEmpty():
        return spark.createDataFrame([], "path string, offset long, length long, record string")
    rows = spark.read.option("pathGlobFilter", "*.idx").schema("path string, offset long, length long, record string").csv(folder, sep="\t", quote="")
    return rows.join(archives.select("path"), "path", "left_semi")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Page, type, referred page, digest and length of the payload (recomputed where the record holds it), and the payload."""

    def number(name: str | None) -> int | None:
        tail = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(tail) if tail else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        path, archive = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    if archive is not None:
                        archive.close()
                    path, archive = row["path"], store.open_input_file(row["path"])
                archive.seek(row["offset"])
                fields, payload = parse(zlib.decompress(archive.read(row["length"]), 31))
                whole = fields["WARC-Type"] == "response"
                out.append({
                    "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")),
                    "payload_digest": digest(payload) if whole else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                    "payload_bytes": len(payload) if whole else int(fields["WARC-Payload-Length"]), "payload": payload if whole else None,
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    return index.mapInArrow(work, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def with_revisits(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Rows (page_id, url, payload, refers_to). Only digests and ids meet in the grouping; one row per digest joins back."""
    pages = df.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    pages = pages.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = pages.filter(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"))
    joined = pages.join(first, "sha1", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))


def round_trip(df: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write, normalise and read back all pages; rows as in ``read_records``. ``folder`` is shared."""
    archives = normalise(write_monoliths(with_revisits(df, **columns), folder), folder)
    return read_records(read_index(archives, folder), folder)
