"""Operator 12, quality rules: Zstandard ratios of whole texts and of fixed chunks, held against bands by length.

A text or chunk whose compressed size is below its band repeats itself, above it there is no language in it. Short texts get
wider bands (a frame costs some bytes, and there is little to refer back to), the shortest none. A text fails by its whole ratio, or if
chunks that make up more than ``share`` of its chunked bytes lie outside theirs. Base rules on words come first.

A window of ``window`` words counts if its words occur twice or more in the text, overlapping or not; windows are told apart by 128 bits
of hashes, within one text. Null and empty texts have no words, fail the base rules and have a null ratio. Repeated rows give
repeated results; other columns are not read. Empty tables give no rows. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tabularium.llm.common import _BYTE, grams, runs_hash, slices, utf8, word_hashes, words

# Characters that count as symbols, and the base rules' limits.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words

# (bytes from, lowest ratio, highest ratio) by length, for whole texts and for chunks; shorter ones are not judged.
WHOLE = ((64, 0.45, 1.20), (256, 0.35, 0.90), (1024, 0.26, 0.75), (4096, 0.22, 0.70), (16384, 0.18, 0.70))
CHUNKS = ((1024, 0.22, 0.74), (4096, 0.22, 0.70))
CHUNK = 4096
LEVEL = 3
SHARE = 0.25

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def occurring(owner: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of hashed things in ascending places: which occur again in their text at all, and which have occurred before."""
    order = np.lexsort((second, first, owner))
    o, a, b = owner[order], first[order], second[order]
    same = np.zeros(len(o), bool)
    if len(o):
        same[1:] = (o[1:] == o[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    again, before = np.zeros(len(o), bool), np.zeros(len(o), bool)
    before[order] = same
    again[order] = same | np.append(same[1:], False)[: len(same)]
    return again, before


def repeated_words(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more."""
    at, one = grams(hashes, first, window, 12)
    _, two = grams(hashes, first, window, 1012)
    again, _ = occurring(np.searchsorted(first, at, side="right") - 1, one, two)
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[again], 1)
    np.add.at(edge, at[again] + window, -1)
    return sums(np.cumsum(edge)[:-1] > 0, first)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line; ``starts`` are those of words."""
    head = np.union1d(offsets[:-1], np.flatnonzero(data == 0x0A) + 1)
    head = head[head < len(data)]
    stop = np.append(head[1:], len(data))
    holds = np.searchsorted(starts, stop) > np.searchsorted(starts, head)
    head, stop = head[holds], stop[holds]
    stop = np.where(data[stop - 1] == 0x0A, stop - 1, stop) if len(stop) else stop
    values = _BYTE[data]
    owner = np.searchsorted(offsets, head, side="right") - 1
    _, before = occurring(owner, runs_hash(values, head, stop, 1), runs_hash(values, head, stop, 1001))
    return np.bincount(owner[before], minlength=len(offsets) - 1)


def outside(size: int, ratio: float, bands: tuple[tuple[int, float, float], ...]) -> bool:
    fit = [b for b in bands if size >= b[0]]
    return bool(fit) and not fit[-1][1] <= ratio <= fit[-1][2]


def verdict(body: bytes, packer: zstandard.ZstdCompressor) -> tuple[float | None, float, bool]:
    """Ratio of the whole text, share of chunked bytes outside their band, and whether the text passes."""
    if not body:
        return None, 0.0, True
    ratio = len(packer.compress(body)) / len(body)
    bad = total = 0
    if len(body) > CHUNK:  # a text of one chunk is that chunk
        for at in range(0, len(body), CHUNK):
            chunk = body[at:at + CHUNK]
            if len(chunk) >= CHUNKS[0][0]:
                total += len(chunk)
                bad += len(chunk) * outside(len(chunk), len(packer.compress(chunk)) / len(chunk), CHUNKS)
    share = bad / total if total else 0.0
    return ratio, share, not outside(len(body), ratio, WHOLE) and share <= SHARE


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 8) -> DataFrame:
    """One row per row: key, counts of the base rules, base_failed, ratio (null without text), bad_share (of chunked bytes) and kept."""
    names = ["key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "bad_share", "kept"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                starts, ends, first = words(data, offsets)
                n_words = np.diff(first)
                repeats = repeated_words(word_hashes(data, starts, ends), first, window)
                failed = (n_words < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n_words)
                raw = data.tobytes()
                judged = [verdict(raw[offsets[i]:offsets[i + 1]], packer) for i in range(part.num_rows)]
                passed = np.array([j[2] for j in judged], bool)
                counts = [n_words, sums(((data & 0xC0) != 0x80) & ~_SPACE[data], offsets), sums(_SYMBOL[data], offsets), repeated_lines(data, offsets, starts), repeats]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *[pa.array(c.astype(np.int64)) for c in counts], pa.array(failed), pa.array([j[0] for j in judged], pa.float64()),
                     pa.array([j[1] for j in judged], pa.float64()), pa.array(passed & ~failed)], names,
                )

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kept = source.schema["key"].dataType.simpleString()
    schema = f"key {kept}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_share double, kept boolean"
    return source.mapInArrow(work, schema).withColumnRenamed("key", key)
