"""Operator 9, toxicity: words as bags of character n-gram embeddings, averaged into a linear softmax, trained jointly.

A word is the mean of the embeddings of its n-grams and of itself, a window of words the mean of its words, and a softmax over two
classes reads the window; so a misspelling that was never seen shares most of its vector with what was. A text scores as its
most toxic window (windows overlap by half), whatever its length. Training reads whole texts first and then, in
each, the window that scores highest. Both labels weigh
alike in training; half of the log odds of their shares in all labelled rows is then added, which keeps rare positives in reach.

The fit uses at most ``per_label`` rows of each label, one stretch of at most ``stretch`` words at a random place of each;
scoring reads whole texts. Texts without words, null and empty ones score as the base rate alone says. Rows keep their number; other
columns are not read; an empty table gives no rows; without labels of both kinds every score is the base rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabularium.llm.common import _BYTE, mix, runs_hash, slices
from tabularium.llm.language import below, distinct_words, letter_runs, lowered, rates, stretches, subwords

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
U = np.uint64


def bags(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of every n-gram of the words, and of the words themselves."""
    owner, hashes = subwords(data, starts, ends, SIZES)
    whole = runs_hash(_BYTE[data], starts, ends, 500)
    return np.append(owner, np.arange(len(starts))), (mix(np.append(hashes, whole)) % U(BUCKETS)).astype(np.int64)


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of windows of ``size`` words, half overlapping; a shorter text is one window, an empty one none."""
    counts = np.diff(first)
    step = max(1, size // 2)
    number = np.where(counts > 0, np.maximum(1, -(-(counts - size) // step) + 1), 0)
    text = np.repeat(np.arange(len(counts)), number)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    start = first[:-1][text] + rank * step
    return start, np.minimum(start + size, first[1:][text]), text


@dataclass(frozen=True)
class Model:
    """What the embeddings and the softmax say of each bucket (the difference of both classes' logits), and the bias."""

    scores: np.ndarray
    bias: float
    window: int

    def predict(self, column: pa.Array) -> np.ndarray:
        data, offsets = lowered(column)
        starts, ends, first = letter_runs(data, offsets)
        logit = np.full(len(column), self.bias)
        if len(starts):
            index, inverse = distinct_words(data, starts, ends)
            owner, bucket = bags(data, starts[index], ends[index])
            word = np.bincount(owner, self.scores[bucket], len(index)) / np.bincount(owner, minlength=len(index))
            total = np.append(0, np.cumsum(word[inverse]))
            a, b, text = windows(first, self.window)
            mean = (total[b] - total[a]) / (b - a)
            begin = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
            logit[text[begin]] += np.maximum.reduceat(mean, begin)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(rows: list[tuple[int, str]], rate: float, window: int = 4, width: int = 12, whole_epochs: int = 6, epochs: int = 50, step: float = 0.5, decay: float = 1e-3, seed: int = 11) -> Model:
    """Embeddings, softmax and biases by adaptive gradients. ``rows``: (label, stretch); ``rate``: share of label 1 in all rows."""
    prior = 0.5 * float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    truth = np.array([y for y, _ in rows], float)
    if len(set(truth.tolist())) < 2:
        return Model(np.zeros(BUCKETS), prior, window)
    rng = np.random.default_rng(seed)
    data, offsets = lowered(pa.array([t for _, t in rows], pa.large_string()))
    starts, ends, first = letter_runs(data, offsets)
    if not len(starts):
        return Model(np.zeros(BUCKETS), prior, window)
    index, inverse = distinct_words(data, starts, ends)
    owner, bucket = bags(data, starts[index], ends[index])
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    size = np.bincount(owner, minlength=len(index))
    begin = np.cumsum(size) - size

    embed = rng.uniform(-1, 1, (BUCKETS, width)) / width
    soft = rng.normal(0, 0.5, (width, 2))
    bias = np.zeros(2)
    squares = [np.full(x.shape, 1e-8) for x in (embed, soft, bias)]
    whole = first[:-1], first[1:], np.arange(len(rows))
    parts = windows(first, window)
    weight = np.where(truth > 0, 0.5 / truth.mean(), 0.5 / (1 - truth.mean())) / len(rows)
    for epoch in range(whole_epochs + epochs):
        a, b, text = parts if epoch >= whole_epochs else whole
        some = b > a
        a, b, text = a[some], b[some], text[some]
        per_bucket = embed @ (soft[:, 1] - soft[:, 0])
        word = np.add.reduceat(per_bucket[bucket], begin) / size
        total = np.append(0, np.cumsum(word[inverse]))
        mean = (total[b] - total[a]) / (b - a)
        best = np.lexsort((-mean, text))  # the highest window of each text
        best = best[np.append(True, text[best][1:] != text[best][:-1])]
        logit = mean[best] + bias[1] - bias[0]
        y = truth[text[best]]
        error = (1 / (1 + np.exp(-logit)) - y) * weight[text[best]]

        length = (b - a)[best]
        at = np.repeat(a[best], length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        pull = np.bincount(inverse[at], np.repeat(error / length, length), len(index))  # on each distinct word
        used = np.flatnonzero(pull)
        spread = np.repeat(pull[used] / size[used], size[used])
        feature = np.repeat(begin[used], size[used]) + np.arange(len(spread)) - np.repeat(np.cumsum(size[used]) - size[used], size[used])
        per = np.bincount(bucket[feature], spread, BUCKETS)  # on each bucket's embedding, along the softmax
        toward = per @ embed
        grads = [np.outer(per, soft[:, 1] - soft[:, 0]) + decay * embed / BUCKETS, np.column_stack([-toward, toward]), np.array([-error.sum(), error.sum()])]
        for x, g, s in zip((embed, soft, bias), grads, squares, strict=True):
            s += g ** 2
            x -= step * g / np.sqrt(s)
    return Model(embed @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0]) + prior, window)


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", allowed: Column | None = None, per_label: int = 1500, stretch: int = 600) -> Model:
    """Fit on a bounded sample of the labelled rows that ``allowed`` (over the key) admits."""
    marks = labels.filter(F.lit(True) if allowed is None else allowed).select(F.col(key).alias("k"), F.col(label).cast("int").alias("mark")).filter("mark IN (0, 1)").dropDuplicates()
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    if not counts:
        return fit([], 0)
    chosen = marks.filter(below(F.xxhash64("k"), rates(counts, per_label)[F.col("mark")]))  # about 1.2 * per_label rows of each label
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL")
    rows = docs.join(F.broadcast(chosen), F.col("key") == F.col("k")).select(F.col("mark").cast("string").alias("label"), "text", F.xxhash64("key", "text").alias("h"))
    return fit([(int(y), t) for y, t in stretches(rows, per_label, stretch)], counts.get(1, 0) / sum(counts.values()))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and score of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(model.predict(part.column("text")))], ["key", "score"])

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(work, f"key {source.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)
