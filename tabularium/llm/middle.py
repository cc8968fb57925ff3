"""Operator 13, fill-in-middle transformation: segments change places inside one buffer, by rotations of three reversals.

A text is cut into lines, two cuts are drawn from the SHA-256 of seed and key, and the sentinels are inserted at the cuts of a
bytearray. Turning ``<M>middle<S>suffix`` round gives suffix before middle; turning ``<P>prefix<S>suffix`` round as well puts
the suffix first. ``restore`` finds the sentinels in an output, turns the same stretches back and deletes the sentinels; it
needs nothing but output and form. Reversals move pieces of bounded size, so a long text needs no second copy of itself.

Null texts count as empty. Empty texts, texts that hold a sentinel, and those that ``rate`` leaves out are plain: they stay as they are. A
null key draws by the empty string. Repeated rows give repeated results; other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabularium.llm.common import slices, utf8

# The sentinels and their order in each form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FORMS = ("plain", "psm", "spm")
STEP = 1 << 16  # bytes that a reversal exchanges at once


def reverse(buffer: bytearray, start: int, stop: int) -> None:
    while stop - start > 1:
        step = min(STEP, (stop - start) // 2)
        left, right = buffer[start:start + step], buffer[stop - step:stop]
        left.reverse()
        right.reverse()
        buffer[start:start + step], buffer[stop - step:stop] = right, left
        start, stop = start + step, stop - step


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> None:
    """Exchange buffer[start:middle] and buffer[middle:stop] in place."""
    reverse(buffer, start, middle)
    reverse(buffer, middle, stop)
    reverse(buffer, start, stop)


def arrange(buffer: bytearray, a: int, b: int, form: str) -> None:
    """Turn a text into its output in place; prefix ends at byte a, middle at byte b."""
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    a, b = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)  # where <M> and <S> stand
    rotate(buffer, a, b, len(buffer))
    if form == "spm":
        rotate(buffer, 0, a, a + len(buffer) - b)


def rebuild(buffer: bytearray, form: str) -> None:
    """Turn an output back into its text in place."""
    if form == "plain":
        return
    end = buffer.index(MIDDLE)  # the middle comes last in both forms
    if form == "spm":
        rotate(buffer, 0, buffer.index(PREFIX), end)
    at = buffer.index(SUFFIX)
    rotate(buffer, at, end, len(buffer))
    b = len(buffer) - (end - at)  # where <S> stands now
    del buffer[b:b + len(SUFFIX)]
    del buffer[at:at + len(MIDDLE)]
    del buffer[:len(PREFIX)]


def draws(key: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit integers, the leading groups of the hex SHA-256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of lines (``\\n`` included) in the slice, the first of each text, and how many each text has."""
    ends = np.flatnonzero(data == 0x0A) + 1
    open_end = offsets[1:][np.diff(offsets) > 0]
    ends = np.union1d(ends, open_end)  # the last line may lack its \n
    first = np.searchsorted(ends, offsets, side="right")
    return ends, first[:-1], np.diff(first)


def transform(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, suffix_first: int = 50) -> DataFrame:
    """One row per row: key, n (lines), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` and ``suffix_first`` are percentages of texts that are transformed, and of those, that put the suffix first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                ends, first, n = lines_of(data, offsets)
                h = [part.column(f"h{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3, 4)]
                cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
                grown = np.append(0, ends)
                # byte at which so many lines end, counted from the start of the text
                at = [np.where(c > 0, grown[first + c] - offsets[:-1], 0) for c in cuts]
                raw = data.tobytes()
                forms, outputs, sizes = [], [], []
                for i in range(part.num_rows):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    body = bytearray(raw[lo:hi])
                    if lo == hi or h[2][i] % 100 >= rate or any(s in body for s in (PREFIX, SUFFIX, MIDDLE)):
                        forms.append("plain")
                        sizes.append((None, None))
                        outputs.append(body.decode())
                        continue
                    form = "spm" if h[3][i] % 100 < suffix_first else "psm"
                    a, b = int(at[0][i]), int(at[1][i])
                    points = (data[lo:lo + b] & 0xC0) != 0x80
                    before = int(np.count_nonzero(points[:a]))
                    sizes.append((before, int(np.count_nonzero(points)) - before))
                    arrange(body, a, b, form)
                    forms.append(form)
                    outputs.append(body.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(n.astype(np.int64)), pa.array(forms, pa.string()), pa.array([s[0] for s in sizes], pa.int64()),
                     pa.array([s[1] for s in sizes], pa.int64()), pa.array(outputs, pa.string())],
                    ["key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *draws(key, seed))
    kept = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(work, f"key {kept}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("key", key)


def restore(df: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """The rows with a column more: the exact text, rebuilt from output and form. A null output gives null."""
    columns = [c for c in df.columns if c != name]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, output):
                texts = []
                for value, kind in zip(part.column(output), part.column(form).to_pylist(), strict=True):
                    if (body := value.as_py()) is not None:
                        buffer = bytearray(body.encode())
                        rebuild(buffer, kind or "plain")
                        body = buffer.decode()
                    texts.append(body)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, name])

    source = df.select(*columns)
    return source.mapInArrow(work, source.withColumn(name, F.lit(None).cast("string")).schema)
