"""Operator 8, language identification: a linear-chain conditional random field labels every word of a text.

A word's score for each language sums weights of its affixes, its byte n-grams and the word itself (lexicon), all hashed;
learned transitions link neighbouring words, and forward-backward gives each word's distribution. A text's language is the
one with the largest share of letters, and the score is that share, so code-switched texts get a mixture.

Texts are labelled as wholes, so training joins stretches of differently labelled texts: every word has its text's label, and
the joints teach the transitions. The fit uses at most ``per_label`` rows of each label, one stretch of ``stretch`` words at a random
place of each; prediction reads whole texts.

Null texts and texts without a letter are ``und`` with score 0, as is everything if no row is labelled. Rows keep their
number; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tabularium.llm.common import SLICE_BYTES, _BYTE, mix, runs_hash, slices, utf8

BUCKETS = 1 << 16
AFFIX = 4
WORDS = 8192  # distinct words whose features are held at once
SEGMENT = 256  # words that forward-backward treats side by side
HERE = SLICE_BYTES // 2  # text worked on at once: every distinct word brings dozens of features
_LETTER = np.zeros(256, bool)  # after lower-casing; parts of longer characters count as letters
_LETTER[[*range(ord("a"), ord("z") + 1), ord("'"), *range(0x80, 0x100)]] = True
U = np.uint64


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pc.utf8_lower(column))


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters, never across texts): starts, ends, first word of each text."""
    solid = np.append(_LETTER[data], False)
    begins = np.zeros(len(solid), bool)
    begins[offsets] = True
    before = np.append(False, solid[:-1])
    starts = np.flatnonzero(solid & (~before | begins))
    stops = np.flatnonzero(before & (~solid | begins))
    return starts, stops, np.searchsorted(starts, offsets)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words with a mark at either side: word number and hash of each."""
    lengths = ends - starts + 2
    first = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(starts)), lengths)
    inside = np.arange(total) - first[owner] - 1
    marked = np.full(total, U(0x5A5A5A5A5A5A5A5B))
    body = (inside >= 0) & (inside < (ends - starts)[owner])
    marked[body] = _BYTE[data[(starts[owner] + inside)[body]]]
    owners, hashes = [], []
    for n in sizes:
        at = np.flatnonzero(inside + 1 + n <= lengths[owner])
        owners.append(owner[at])
        hashes.append(runs_hash(marked, at, at + n, n))
    return np.concatenate(owners), np.concatenate(hashes)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of every feature: n-grams, affixes, the word."""
    values = _BYTE[data]
    owner, hashes = subwords(data, starts, ends, (2, 3))
    number = np.arange(len(starts))
    owners, all_hashes = [owner], [hashes]
    for n in range(1, AFFIX + 1):
        fit = np.flatnonzero(ends - starts >= n)
        owners += [fit, fit]
        all_hashes += [runs_hash(values, starts[fit], starts[fit] + n, 100 + n), runs_hash(values, ends[fit] - n, ends[fit], 200 + n)]
    owners.append(number)
    all_hashes.append(runs_hash(values, starts, ends, 300))
    return np.concatenate(owners), (mix(np.concatenate(all_hashes)) % U(BUCKETS)).astype(np.int64)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one occurrence of each distinct word, and each word's number among them."""
    _, index, inverse = np.unique(runs_hash(_BYTE[data], starts, ends), return_index=True, return_inverse=True)
    return index, inverse


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes end to end, their starts and ends there."""
    lengths = ends - starts
    stops = np.cumsum(lengths)
    begins = stops - lengths
    return data[np.arange(int(lengths.sum())) + np.repeat(starts - begins, lengths)], begins, stops


def summed(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], n) for k in range(values.shape[1])], axis=1)


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Distribution of every word's label. Chains (words first[i]:first[i + 1]) are cut into segments: their transfer matrices
    link the segments' ends, then all segments run forward and backward side by side."""
    n, labels = scores.shape
    if not n:
        return np.zeros((0, labels))
    move = np.exp(transitions - transitions.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    sizes = np.diff(first)
    pieces = -(-sizes // SEGMENT)
    chain = np.repeat(np.arange(len(sizes)), pieces)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[:-1][chain] + rank * SEGMENT
    size = np.minimum(SEGMENT, first[1:][chain] - start)
    order = np.argsort(-size, kind="stable")
    alive = [int((size > t).sum()) for t in range(int(size.max()))]
    begin, length = start[order], size[order]

    product = np.tile(np.eye(labels), (len(order), 1, 1))
    if pieces.max() > 1:
        for t, k in enumerate(alive):
            step = (product[:k] @ move) * local[begin[:k] + t][:, None, :]
            product[:k] = step / step.max(axis=(1, 2), keepdims=True)
    link = np.empty_like(product)
    link[order] = product

    entry = np.full((len(chain), labels), 1 / labels)
    leave = np.full((len(chain), labels), 1 / labels)
    head = np.cumsum(pieces) - pieces
    for r in range(1, int(pieces.max())):
        has = np.flatnonzero(pieces > r)
        at = head[has] + r
        v = np.einsum("gi,gij->gj", entry[at - 1], link[at - 1])
        entry[at] = v / v.sum(axis=1, keepdims=True)
        at = head[has] + pieces[has] - 1 - r
        v = np.einsum("gij,gj->gi", link[at + 1], leave[at + 1])
        leave[at] = v / v.sum(axis=1, keepdims=True)

    forward = np.empty((n, labels))
    state = entry[order]
    for t, k in enumerate(alive):
        v = (state[:k] @ move) * local[begin[:k] + t]
        state[:k] = v / v.sum(axis=1, keepdims=True)
        forward[begin[:k] + t] = state[:k]
    backward = np.empty((n, labels))
    state = leave[order]
    back = np.arange(len(order))
    for t in range(len(alive)):  # from each segment's own end
        k = alive[t]
        at = begin[back[:k]] + length[:k] - 1 - t
        backward[at] = state[:k]
        v = (state[:k] * local[at]) @ move.T
        state[:k] = v / v.sum(axis=1, keepdims=True)
    forward *= backward
    forward /= forward.sum(axis=1, keepdims=True)
    return forward


@dataclass(frozen=True)
class Field:
    """Labels, weights[bucket, label] and transitions[label, next label]."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        index, inverse = distinct_words(data, starts, ends)
        sums = np.empty((len(index), len(self.labels)))
        for low in range(0, len(index), WORDS):
            some = index[low:low + WORDS]
            owner, bucket = features(*gathered(data, starts[some], ends[some]))
            sums[low:low + WORDS] = summed(owner, self.weights[bucket], len(some))
        return sums[inverse]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = lowered(column)
        starts, ends, first = letter_runs(data, offsets)
        n = len(column)
        chosen, score = np.full(n, -1), np.zeros(n)
        if len(self.labels) and len(starts):
            probable = marginals(self.emissions(data, starts, ends), first, self.transitions)
            owner = np.repeat(np.arange(n), np.diff(first))
            share = summed(owner, probable * (ends - starts)[:, None], n)
            full = share.sum(axis=1)
            some = full > 0
            chosen[some] = share[some].argmax(axis=1)
            score[some] = np.clip(share[some].max(axis=1) / full[some], 0, 1)
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        chosen[~letters] = -1
        score[chosen < 0] = 0
        return [self.labels[c] if c >= 0 else "und" for c in chosen], score


def fit(rows: list[tuple[str, str]], epochs: int = 25, rate: float = 0.3, decay: float = 1e-4, length: int = 96, seed: int = 7) -> Field:
    """Maximum likelihood by adaptive gradients. ``rows``: (label, stretch of text)."""
    labels = sorted({label for label, _ in rows})
    k = len(labels)
    data, offsets = lowered(pa.array([t for _, t in rows], pa.large_string()))
    starts, ends, first = letter_runs(data, offsets)
    rng = np.random.default_rng(seed)
    code = {label: i for i, label in enumerate(labels)}
    parts = []  # stretches of 8 to 32 words in random order make the chains
    for i, (label, _) in enumerate(rows):
        at = int(first[i])
        while at < first[i + 1]:
            stop = min(int(first[i + 1]), at + int(rng.integers(8, 33)))
            parts.append((np.arange(at, stop), code[label]))
            at = stop
    if not parts or k == 0:
        return Field(labels if len(starts) else [], np.zeros((BUCKETS, k)), np.zeros((k, k)))
    rng.shuffle(parts)
    word = np.concatenate([p[0] for p in parts])
    truth = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
    chain = np.append(np.arange(0, len(word), length), len(word))
    index, inverse = distinct_words(data, starts, ends)
    owner, bucket = features(data, starts[index], ends[index])
    which = inverse[word]

    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    squares, squares_t = np.full((BUCKETS, k), 1e-8), np.full((k, k), 1e-8)
    inside = np.ones(len(word), bool)
    inside[chain[:-1]] = False
    follow = np.flatnonzero(inside)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[follow - 1], truth[follow]), 1)
    for _ in range(epochs):
        scores = summed(owner, weights[bucket], len(index))[which]
        probable = marginals(scores, chain, transitions)
        error = probable.copy()
        error[np.arange(len(word)), truth] -= 1
        by_word = summed(which, error, len(index))
        grad = summed(bucket, by_word[owner], BUCKETS) / len(word) + decay * weights / len(word)
        squares += grad ** 2
        weights -= rate * grad / np.sqrt(squares)
        # neighbours' joint distribution, from both sides' marginals tied by the transition
        joint = pairs(scores, chain, transitions, follow)
        grad_t = (joint - seen) / len(word)
        squares_t += grad_t ** 2
        transitions = transitions - rate * grad_t / np.sqrt(squares_t)
    return Field(labels, weights.astype(np.float32), transitions)


def pairs(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Expected number of each transition inside the chains, all no longer than one segment."""
    n, k = scores.shape
    move = np.exp(transitions - transitions.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    begin, size = first[:-1], np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    alive = [int((size > t).sum()) for t in range(int(size.max()))]
    forward, backward = np.empty((n, k)), np.empty((n, k))
    state = np.full((len(begin), k), 1 / k)
    for t, a in enumerate(alive):
        v = (state[:a] @ move) * local[begin[:a] + t]
        state[:a] = v / v.sum(axis=1, keepdims=True)
        forward[begin[:a] + t] = state[:a]
    state = np.full((len(begin), k), 1 / k)
    for t, a in enumerate(alive):
        at = begin[:a] + size[:a] - 1 - t
        backward[at] = state[:a]
        v = (state[:a] * local[at]) @ move.T
        state[:a] = v / v.sum(axis=1, keepdims=True)
    joint = forward[follow - 1][:, :, None] * move[None] * (local[follow] * backward[follow])[:, None, :]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def rates(counts: dict, per_label: int) -> Column:
    """Map of each label to the share of its rows to look at, a fifth more than are wanted."""
    return F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(min(1.0, 1.2 * per_label / n)))])


def below(hashed: Column, share: Column) -> Column:
    return F.pmod(hashed, F.lit(1_000_003)) / 1_000_003 < share


def stretches(df: DataFrame, per_label: int, stretch: int) -> list[tuple[str, str]]:
    """Of rows (label, text, h), one stretch of words at a place that h picks; at most ``per_label`` of each label, by h."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True):
                split = value.split()
                start = (h >> 20) % max(1, len(split) - stretch + 1)
                texts.append(" ".join(split[start:start + stretch]))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(texts, pa.string()), batch.column("h")], ["label", "text", "h"])

    got = df.select("label", "text", "h").mapInArrow(take, "label string, text string, h long").collect()
    out, taken = [], {}
    for r in sorted(got, key=lambda r: (r["label"], r["h"], r["text"])):
        taken[r["label"]] = taken.get(r["label"], 0) + 1
        if taken[r["label"]] <= per_label:
            out.append((r["label"], r["text"]))
    return out


def sample_rows(df: DataFrame, key: str, label: str, text: str, allowed: Column, per_label: int, stretch: int) -> list[tuple[str, str]]:
    """At most ``per_label`` stretches of each label, chosen by a hash of key and text."""
    labelled = df.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h"), allowed.alias("ok"))
    labelled = labelled.filter("ok AND label IS NOT NULL AND text IS NOT NULL")
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    return stretches(labelled.filter(below(F.col("h"), rates(counts, per_label)[F.col("label")])), per_label, stretch) if counts else []


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls into the fold; a null key never does."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", allowed: Column | None = None, per_label: int = 600, stretch: int = 120) -> Field:
    """Fit on a bounded sample of the labelled rows that ``allowed`` admits."""
    return fit(sample_rows(df, key, label, text, F.lit(True) if allowed is None else allowed, per_label, stretch))


def identify(df: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=HERE):
                names, score = field.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(names, pa.string()), pa.array(score)], ["key", "lang_pred", "score"])

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kept = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(work, f"key {kept}, lang_pred string, score double").withColumnRenamed("key", key)


def keep_identified(df: DataFrame, field: Field, least: float, text: str = "text") -> DataFrame:
    """The rows, all columns, whose text has a language with at least that score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, HERE):
                names, score = field.predict(part.column(text))
                yield part.filter(pa.array([n != "und" and s >= least for n, s in zip(names, score, strict=True)]))

    return df.mapInArrow(work, df.schema)
