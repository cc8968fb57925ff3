"""Operator 4, byte-level BPE: overlapping chunks are split into pre-tokens in parallel, stitched where both sides agree
on a pre-token's end, and encoded; decoding joins the ids' bytes.

A match of the pattern depends only on where it starts and on what follows, so two neighbouring chunks that share one
end agree on all later ones. Ends close to a chunk's cut are not trusted. If an overlap holds no common end (a run longer than
the overlap), the text is split again from the last sure end until the next chunk's ends are met.

Texts of one chunk need no exchange. Null and empty texts have no ids and decode to nothing. Repeated rows each give a
row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tabularium.llm.common import slices
from tabularium.llm.units import UnitEncoder

UNSURE = 3  # a contraction of up to three characters may be cut at a chunk's end


class Codec:
    """Ranks and pattern of one vocabulary; ``limit`` bounds the memo of short units."""

    def __init__(self, path: str, pattern: str, limit: int = 200_000):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.single = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.units = UnitEncoder(lambda texts: [self.pieces(self.pattern.findall(t)) for t in texts], limit)

    def pieces(self, pieces: list[str]) -> bytes:
        single = self.single
        return np.array([i for p in pieces for i in single(p.encode())], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def ends(self, text: str, last: bool) -> np.ndarray:
        """Ends of the pre-tokens of a chunk that more text cannot move."""
        out = np.array([m.end() for m in self.pattern.finditer(text)], np.int64)
        return out if last else out[out <= len(text) - UNSURE]

    def stitch(self, text: str, chunks: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Ends over the whole text from (start, ends in the chunk) in order."""
        out = chunks[0][1]
        for start, ends in chunks[1:]:
            ends = ends + start
            common = np.intersect1d(out[out > start], ends)
            if not len(common) and len(ends):
                sure, more = set(ends.tolist()), []
                for m in self.pattern.finditer(text, int(out[-1]) if len(out) else 0):
                    more.append(m.end())
                    if m.end() in sure or m.end() > ends[-1]:
                        break
                out = np.append(out, np.array(more, np.int64))
                common = out[-1:] if more and more[-1] in sure else common
            if len(common):
                out = np.concatenate([out[out <= common[0]], ends[ends > common[0]]])
        if len(text) > (out[-1] if len(out) else 0):
            out = np.append(out, [m.end() for m in self.pattern.finditer(text, int(out[-1]) if len(out) else 0)]).astype(np.int64)
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, ranks: str, pattern: str, chunk: int = 32_768, overlap: int = 256, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of ``df``: key and ids (binary, little-endian, 32 bits each); with ``decoded`` also their bytes.

    ``ranks`` is the path of a rank file on every executor.
    """
    source = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kept = source.schema["key"].dataType.simpleString()
    schema = f"key {kept}, ids binary" + ", decoded binary" * decoded

    def result(keys: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        columns = [keys, pa.array(ids, pa.binary())]
        if decoded:
            decode = codec(ranks, pattern).decode
            columns.append(pa.array([decode(x) for x in ids], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"][:len(columns)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield result(part.column("key"), codec(ranks, pattern).units.encode(part.column("text").to_pylist()))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                value = batch.column("text")[row].as_py()
                starts = range(0, len(value), chunk)
                one = batch.slice(row, 1)
                columns = [pa.concat_arrays([one.column(c)] * len(starts)) for c in ("key", "uid")]
                columns += [pa.array(starts, pa.int64()), pa.array([value[s:s + chunk + overlap] for s in starts]), pa.array([len(value)] * len(starts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "uid", "start", "text", "size"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = zip(*(part.column(c).to_pylist() for c in ("text", "start", "size")), strict=True)
                ends = [codec(ranks, pattern).ends(t, s + len(t) >= n).astype("<i4").tobytes() for t, s, n in rows]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ends, pa.binary())], [*part.schema.names, "ends"])

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "text", "ends")), strict=True))
        copies = sum(r[0] == 0 for r in rows)  # rows with equal key and text
        rows = rows[::copies]
        value = "".join(t[:chunk] for _, t, _ in rows)
        c = codec(ranks, pattern)
        ends = c.stitch(value, [(s, np.frombuffer(e, "<i4").astype(np.int64)) for s, _, e in rows]).tolist()
        ids = c.pieces([value[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        keys = table.column("key").slice(0, 1).combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        return pa.Table.from_batches([result(pa.concat_arrays([keys] * copies), [ids] * copies)])

    length = F.char_length("text")
    own = source.filter(length <= chunk).mapInArrow(short, schema)
    cut = source.filter(length > chunk).withColumn("uid", F.sha2("text", 256)).mapInArrow(chunks, f"key {kept}, uid string, start long, text string, size long")
    dealt = cut.repartition("key", "uid", "start").mapInArrow(split, cut.schema.add("ends", "binary"))
    return own.unionByName(dealt.groupBy("key", "uid").applyInArrow(join, schema)).withColumnRenamed("key", key)


def decode(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and bytes of each row's ids; null ids give null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks, pattern)
        for batch in batches:
            out = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], ["key", "decoded"])

    source = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kept = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(work, f"key {kept}, decoded binary").withColumnRenamed("key", key)
