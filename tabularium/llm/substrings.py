"""Operator 3, substring dedup: windows of every document are looked up in blocks of references, smaller ids first.

Documents are dealt into blocks. Each block's word windows form the reference index, which lives in buckets by hash:
a bucket knows for every window the smallest document that holds it. In a document, neighbouring windows that name the same
smallest document are joined to one factor, and the words under factors (never shorter than the window) are duplicate spans. A factor is not
extended in its reference: no positions are kept, so its windows need not follow one another there. The removed words are the same.

Most windows occur once, so blocks first exchange anchors: the smallest hash among a window's short word runs, equal in equal
windows and chosen about once in five words. Only windows whose anchor another block has are sent. Windows, not documents,
are compared, each block sends a window once, and pairs of documents are never formed.

Windows are compared by one 63-bit hash, not by their bytes. Null ids stand after all
others, equal ids do not remove from each other. Null and empty texts have no words; a very long text is one row of its block. Other columns stay
beside their row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructType

from tabularium.llm import exchange
from tabularium.llm.common import block_count, block_of, grams, utf8, word_hashes, words

U = np.uint64
ANCHOR = 5
LAST = np.iinfo(np.int64).max


class Block:
    """Word windows of the documents of one block, ordered by id."""

    def __init__(self, table: pa.Table, key: str, text: str, window: int):
        ids = table.column(key).to_pylist()
        ids = np.array([LAST if i is None else i for i in ids], np.int64)
        order = np.argsort(ids, kind="stable")
        self.table, self.ids, self.window = table.take(pa.array(order)), ids[order], window
        self.data, self.offsets = utf8(self.table.column(text))
        self.starts, self.ends, self.first = words(self.data, self.offsets)
        h = word_hashes(self.data, self.starts, self.ends)
        self.at, keys = grams(h, self.first, window, 13)
        self.keys = keys & ~U(1)
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(self.first))[self.at] if len(self.at) else self.at
        short = min(ANCHOR, window)
        if len(self.at):
            runs = np.zeros(len(h), U)
            at, own = grams(h, self.first, short, 5)
            runs[at] = own
            # sliding minimum over the runs inside each window
            least = runs[self.at]
            for k in range(1, window - short + 1):
                np.minimum(least, runs[self.at + k], out=least)
            self.anchors = least | U(1)
        else:
            self.anchors = self.keys

    def local_least(self) -> np.ndarray:
        """Smallest id in the block that has each window."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        _, index, inverse = np.unique(self.keys, return_index=True, return_inverse=True)
        return self.ids[self.owner[index]][inverse]  # documents are in order of ids

    def references(self, known: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each window the smallest id of a document that has it, LAST if it is none below the window's own."""
        out = self.local_least()
        hit = exchange.among(self.keys, known)
        if hit.any():
            out[hit] = np.minimum(out[hit], least[np.searchsorted(known, self.keys[hit])])
        out[out >= self.ids[self.owner]] = LAST
        return out

    def factors(self, references: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, words and reference of each factor, in order."""
        hit = np.flatnonzero(references < LAST)
        if not len(hit):
            return hit, hit, hit
        at, ref = self.at[hit], references[hit]
        opens = np.append(True, (at[1:] != at[:-1] + 1) | (ref[1:] != ref[:-1]) | (self.owner[hit][1:] != self.owner[hit][:-1]))
        begin = np.flatnonzero(opens)
        stop = np.append(begin[1:], len(hit)) - 1
        return at[begin], at[stop] - at[begin] + self.window, ref[begin]

    def removed(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        cover = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
        return np.cumsum(cover)[:-1] > 0

    def kept_text(self, removed: np.ndarray, layout: bool) -> pa.Array:
        """Kept words joined by one space; with ``layout``, the text without removed words and the white space before them."""
        n = len(self.data)
        edge = np.zeros(n + 1, np.int64)
        if layout:
            before = np.append(0, self.ends[:-1])
            heads = self.first[:-1][np.diff(self.first) > 0]
            before[heads] = self.offsets[:-1][np.diff(self.first) > 0]
            np.add.at(edge, before[removed], 1)
            np.add.at(edge, self.ends[removed], -1)
            keep, data = np.cumsum(edge)[:-1] == 0, self.data
        else:
            stay = ~removed
            edge[self.starts[stay]] += 1
            np.add.at(edge, self.ends[stay], -1)
            keep = np.cumsum(edge)[:-1] > 0
            data = np.where(keep, self.data, np.uint8(0x20))
            number = np.cumsum(stay) - stay
            behind = stay & (number > np.repeat(np.append(number, stay.sum())[self.first[:-1]], np.diff(self.first)))
            keep[self.starts[behind] - 1] = True
        total = np.append(0, np.cumsum(keep))
        return pa.LargeStringArray.from_buffers(len(self.ids), pa.py_buffer(total[self.offsets].astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes())).cast(pa.string())


def _parsed(df: DataFrame, key: str, text: str, window: int, finish, schema) -> DataFrame:
    """Exchange anchors, then windows, then ``finish(block, references)`` on every block."""
    columns = [F.col(c) for c in df.columns if c != "block"] + ([F.col("block").alias("_block")] if "block" in df.columns else [])
    blocks = df.select(block_of(key, block_count(df, text)).alias("block"), *columns)
    n = exchange.buckets(df, text)
    grouped = blocks.groupBy("block")

    def anchors(table: pa.Table) -> pa.Table:
        return exchange.packed(table.column("block")[0].as_py(), np.unique(Block(table, key, text, window).anchors), None, n)

    def windows(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return exchange.ARROW.empty_table()
        b = Block(table, key, text, window)
        known, _ = exchange.listed(back)
        send = np.flatnonzero(exchange.among(b.anchors & ~U(1), known))
        keys, index = np.unique(b.keys[send], return_index=True)
        ids = b.ids[b.owner[send[index]]]
        order = np.argsort(index)  # runs of equal ids pack well
        return exchange.packed(table.column("block")[0].as_py(), keys[order], ids[order], n)

    def last(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty
        b = Block(table, key, text, window)
        return finish(b, b.references(*exchange.listed(back)))

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(schema).empty_table()
    shared = exchange.common_keys(grouped.applyInArrow(anchors, exchange.ROWS))
    sent = grouped.cogroup(shared.groupBy("block")).applyInArrow(windows, exchange.ROWS)
    found = exchange.smaller_owners(sent)
    return grouped.cogroup(found.groupBy("block")).applyInArrow(last, schema)


def find_repeats(df: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed, kept (the other words joined by one space), factors (start, length, reference)."""
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:long,length:long,reference:long>>")
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("reference", pa.int64())])

    def finish(b: Block, references: np.ndarray) -> pa.Table:
        start, length, ref = b.factors(references)
        removed = b.removed(start, length)
        n = len(b.ids)
        doc = np.repeat(np.arange(n), np.diff(b.first))
        counts = np.bincount(doc[removed], minlength=n) if len(doc) else np.zeros(n, np.int64)
        own = np.searchsorted(b.first, start, side="right") - 1 if len(start) else start
        own = doc[start] if len(start) else own
        flat = pa.StructArray.from_arrays([pa.array(start - b.first[own]), pa.array(length), pa.array(ref.astype(np.int64))], fields=list(item))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32)), flat)
        return pa.Table.from_arrays([
            b.table.column("doc_id"), pa.array(np.diff(b.first).astype(np.int64)), pa.array(counts.astype(np.int64)), b.kept_text(removed, False), lists,
        ], ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return _parsed(source, "doc_id", "text", window, finish, schema).withColumnRenamed("doc_id", key)


def remove_repeats(df: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``df``; texts lose duplicate spans, rows of which nothing is left go. Texts without any stay as they are."""
    if not isinstance(df.schema[key].dataType, LongType):
        raise TypeError("the key is a long")
    names, clean = df.columns, "_block" if "block" in df.columns else None

    def finish(b: Block, references: np.ndarray) -> pa.Table:
        start, length, _ = b.factors(references)
        removed = b.removed(start, length)
        n = len(b.ids)
        doc = np.repeat(np.arange(n), np.diff(b.first))
        counts = np.bincount(doc[removed], minlength=n) if len(doc) else np.zeros(n, np.int64)
        mended = b.kept_text(removed, True)
        old = b.table.column(text).combine_chunks() if isinstance(b.table.column(text), pa.ChunkedArray) else b.table.column(text)
        old = old.chunk(0) if isinstance(old, pa.ChunkedArray) else old
        value = pa.compute.if_else(pa.array(counts > 0), mended, old.cast(pa.string()))
        out = b.table.set_column(b.table.schema.get_field_index(text), text, value)
        out = out.rename_columns(["_" if c == "block" else "block" if c == clean else c for c in out.column_names])
        return out.select(names).filter(pa.array((counts == 0) | (counts < np.diff(b.first))))

    return _parsed(df, key, text, window, finish, df.schema)
