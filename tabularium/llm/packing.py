"""Operator 2, packing: harmonic classes, bins of a fixed number of pieces, filled by each task on its own.

A document's ids and an end id are cut into full sequences, then into halves, quarters ... of the capacity down to
``least``; what is left keeps its length. Class k holds lengths in (capacity / (k + 1), capacity / k] and its bins take
exactly k pieces, so a bin of equal parts has no padding and one of short rests loses at most a (k + 1)-th. Pieces of bins
that stay open when a task ends are chained, cut at the capacity, and the end of the chain is cut at powers of two, which
need no padding. Nothing is shuffled, and a task holds less than one bin of each class.

Null and empty texts are one piece, the end id. Repeated rows are packed as often as they occur; other columns are not
read. An empty table gives no rows. Which documents share a sequence follows the order of the input's partitions.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabularium.llm.common import kept_for_stage, slices
from tabularium.llm.units import Memo, UnitEncoder


_OTHER = regex.compile(r"[^\x00-\u024F]")  # beyond these, libraries may class characters by different tables


def _is_word(text: str) -> bool:
    """Latin letters, after a space or not: the pattern leaves them in one piece."""
    return text[1:].isalpha() and (text[0] == " " or text[0].isalpha()) and max(text) <= "\u024F"


@lru_cache(maxsize=2)
def _encoder(path: str, special: bool) -> Callable[[list[str]], list[bytes]]:
    """Ids by the tokenizers library. Texts that hold an added token's string go to it whole. Units of Latin letters are split by its pattern first, so that a word is encoded once
    whatever punctuation follows it; the pieces go to the library's model as it would see them, byte by byte as characters."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not special  # then their strings in a text are ordinary text
    with open(path, encoding="utf-8") as f:
        parsed = json.load(f)
    latin = parsed.get("pre_tokenizer") or {}
    added = [t for t in parsed.get("added_tokens") or [] if special or not t.get("special")]
    always = tokenizer.normalizer is not None and any(t.get("normalized") for t in added)  # may appear by normalising
    marks = [t["content"] for t in added]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow 255
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    split, model = regex.compile(public_tokenizers.PATTERN), tokenizer.model

    def by_library(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(units: UnitEncoder) -> Callable[[list[str]], list[bytes]]:
        def encode(texts: list[str]) -> list[bytes]:
            whole = [always or any(m in t for m in marks) for t in texts]
            marked = iter(by_library([t for t, w in zip(texts, whole, strict=True) if w]))
            rest = iter(units.encode([t for t, w in zip(texts, whole, strict=True) if not w]))
            return [next(marked if w else rest) for w in whole]

        return encode

    if latin.get("type") != "ByteLevel" or latin.get("add_prefix_space") or tokenizer.normalizer is not None:
        return apart(UnitEncoder(by_library))

    def of_piece(piece: str) -> bytes:
        return array("I", [t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(shown))]).tobytes()

    known = Memo(of_piece, 300_000).__getitem__

    def encode_all(texts: list[str]) -> list[bytes]:
        return [of_piece(t) if _is_word(t) else by_library([t])[0] if _OTHER.search(t) else b"".join(map(known, split.findall(t))) for t in texts]

    return apart(UnitEncoder(encode_all))


class Bins:
    """Open bins of one task. ``ready`` collects rows (sequence, offset, piece)."""

    def __init__(self, capacity: int, least: int, first: int):
        self.capacity, self.next = capacity, first
        self.sizes = []
        while capacity % 2 ** (len(self.sizes) + 1) == 0 and capacity >> (len(self.sizes) + 1) >= least:
            self.sizes.append(capacity >> (len(self.sizes) + 1))
        self.open: dict[int, list] = {}
        self.ready: list = []

    def add(self, key, ids: bytes) -> None:
        total, at = len(ids) // 4, 0

        def piece(length: int):
            nonlocal at
            out = (key, at, length, total, ids[4 * at:4 * (at + length)])
            at += length
            return out

        while total - at >= self.capacity:
            self.close([piece(self.capacity)])
        for size in self.sizes:
            if total - at >= size:
                self.place(piece(size))
        if total > at:
            self.place(piece(total - at))

    def place(self, piece) -> None:
        k = self.capacity // piece[2]
        members = self.open.setdefault(k, [])
        members.append(piece)
        if len(members) == k:
            self.close(self.open.pop(k))

    def close(self, members: list) -> None:
        offset = 0
        for p in members:
            self.ready.append((self.next, offset, p))
            offset += p[2]
        self.next += 1

    def finish(self) -> None:
        """Chain what is left; sequences are full, and then powers of two."""
        chain = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(p[2] for p in chain)
        while left:
            room = size = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= size
            members = []
            while room:
                key, start, length, total, ids = chain.pop(0)
                take = min(room, length)
                members.append((key, start, take, total, ids[:4 * take]))
                if take < length:
                    chain.insert(0, (key, start + take, length - take, total, ids[4 * take:]))
                room -= take
            self.close(members)


def pack(df: DataFrame, tokenizer: str, capacity: int = 1024, least: int = 64, end_id: int = 0, key: str = "doc_id", text: str = "text",
         special: bool = False) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens, sequence_id, offset and the ids (little-endian, 32 bits each).

    ``tokenizer`` is the path of a tokenizers file on every executor. The capacity is best a power of two. With
    ``special``, the string of a special token in a text becomes that token, as the library does by itself; else it is ordinary text.
    """
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_for_stage(_encoder.cache_clear)
        encode = _encoder(tokenizer, special)
        bins = Bins(capacity, least, TaskContext.get().partitionId() << 36)
        kind = None

        def rows() -> pa.RecordBatch:
            ready, bins.ready = bins.ready, []
            piece = [r[2] for r in ready]
            numbers = [np.array([x[k] for x in piece], np.int64) for k in (1, 2, 3)]
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in piece], kind), *map(pa.array, numbers), pa.array(np.array([r[0] for r in ready], np.int64)),
                 pa.array(np.array([r[1] for r in ready], np.int64)), pa.array([p[4] for p in piece], pa.binary())],
                ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in batches:
            kind = batch.schema.field("key").type
            for part in slices(batch):
                keys = part.column("key").to_pylist()
                for k, ids in zip(keys, encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    bins.add(k, ids + end)
                yield rows()
        bins.finish()
        if bins.ready:
            yield rows()

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kept = source.schema["key"].dataType.simpleString()
    schema = f"key {kept}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return source.mapInArrow(work, schema).withColumnRenamed("key", key)
