"""Operator 7, n-gram Jaccard join by universe partition and the pigeonhole principle.

Documents with the same set of shingles form a class, and classes are joined. One pass counts, for each set, the shingles that
other rows have too: a set linked to any other shares ``num / den`` of its own, so most documents are alone and go no further.
Of the rest only shared shingles are kept; what follows works on these, and sets that link still do so by their shared shingles.

Sizes are cut into bands such that linked sizes lie
in one band or in neighbouring ones; two neighbouring bands make a group, in which linked sets differ by at most H shingles. The
universe of shingles is hashed into H + 1 segments. Each segment gets an allocation: 1 looks for an equal segment, 2 also for
one that differs by one shingle, 0 skips it. While allocations sum to H + 1, linked sets meet in a segment. Empty segments, the
costly ones since unrelated sets share them, get 0 as far as spare segments or segments of two shingles that take 2 instead allow; for those, segments of
three shingles are indexed with each single deletion.

A few segments more than H + 1 make linked sets meet in several, and fewer common keys than that rule a pair out.

Keys first go round as bare hashes, so that only documents that share enough of them are gathered with their sets. Two sets differ at
least by the shingles that either has alone, and by the differences of how many shared ones they have in each of 16 parts of the universe;
pairs that this puts too far apart are never formed. What is left is verified on the sets, in rounds: first each document meets, of the
smallest ids in its keys, the one with most common keys; then documents outside the largest component of a key meet that component's
smallest id, again and again while this joins enough; at last all pairs across components that share a key. There a finer bound counts
the parts, of 512, in which the numbers of shared shingles differ in parity, and a pair is formed under one of its keys where both sets
tell which, not under each. Pairs are not expanded inside a component, and no link between components is lost.

Shingles are compared by 64-bit hashes. Null and empty texts, and texts of white space, have no shingles and are alone, as are null
ids (component null). Rows of one id count as one document and get the same component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tabularium.llm import exchange
from tabularium.llm.common import BLOCK_BYTES, block_of, grams, mix, parts, release, runs_hash, slices, staged, utf8, word_hashes, words

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
SPARE = 4  # segments beyond H + 1, with an eighth of H; at most half of H
TOGETHER = 256  # sets compared with one leader in a task
BROADCAST_ROWS = 200_000  # rows of three numbers: under 10 MB
FEW_IDS = 500_000  # ids that are broadcast, 4 MB
SLICE_ROWS = 1 << 16  # rows of a slice, so that 16 bits number them
PARTS = 16  # parts of the universe in which shared shingles are counted, modulo 256
BITS = 512  # parts of the universe in which they are counted modulo 2, for the last round
LEAST_KEYS = 8  # searching keys of a set that tell where a pair is formed, if two sets have one of them in common
SKETCH_ROWS = 50_000  # rows of 150 bytes that are broadcast, 8 MB
QS = [f"q{k}" for k in range(BITS // 64)]
HEAD_ROUNDS = 4  # rounds in which documents meet one other at most, before all pairs


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    at, keys = grams(h, first, size, 70 + size)
    doc = np.repeat(np.arange(len(column)), np.diff(first))
    counts = np.diff(first)
    few = np.flatnonzero((counts > 0) & (counts < size))
    owner = np.concatenate([doc[at] if len(at) else at, few])
    keys = np.concatenate([keys, runs_hash(h, first[few], first[few + 1], 70 + size)]) if len(h) else keys
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    keep = np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    owner, keys = owner[keep], keys[keep]
    return keys, np.searchsorted(owner, np.arange(len(column) + 1))


def band_starts(most: int, num: int, den: int) -> np.ndarray:
    """First size of each band, past ``most``: a set linked to one of band k lies in k - 1, k or k + 1."""
    out = [1, 2]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, den * (out[-1] - 1) // num + 1))
    last = max(out[-1] + 1, den * (out[-1] - 1) // num + 1)
    return np.array([*out, last, max(last + 1, den * (last - 1) // num + 1)])


def signatures(tokens: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, key, whether it searches (else it is only found), and how many keys a linked set has in common with it at least,
    for sets tokens[first[i]:first[i + 1]]."""
    sizes = np.diff(first)
    docs = np.flatnonzero(sizes)
    if not len(docs):
        return docs, np.zeros(0, U), np.zeros(0, bool), docs
    limits = band_starts(int(sizes.max()), num, den)
    band = np.searchsorted(limits, sizes[docs], side="right") - 1
    owner = np.repeat(np.arange(len(docs)), sizes[docs])
    tokens = tokens[first[docs[0]]:]
    value = mix(tokens + U(0x2545F4914F6CDD1D))
    out: list[tuple[np.ndarray, ...]] = []
    for step in (0, 1):
        group = band + step  # covers bands group - 1 and group
        apart = (den - num) * 2 * (limits[group + 1] - 1) // (den + num)
        spare = np.minimum(SPARE + apart // 8, apart // 2)
        segments = apart + 1 + spare
        base = np.cumsum(segments) - segments
        total = int(segments.sum())
        own = np.repeat(np.arange(len(docs)), segments)
        number = np.arange(total) - base[own]
        segment = base[owner] + (((tokens >> U(32)) * segments[owner].astype(U)) >> U(32)).astype(np.int64)
        filled = np.bincount(segment, minlength=total)
        sums = np.zeros(total, U)
        begin = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
        sums[segment[begin]] = np.add.reduceat(value, begin)
        tag = mix(group.astype(U) * U(0x9E3779B97F4A7C15) + U(7))[own] + number.astype(U) * U(0xC2B2AE3D27D4EB4F)
        # allocation: trade empty segments for segments of two, within the part of the universe that has deletions
        special = number < np.maximum(1, segments // 4)[own]
        two, empty = (filled == 2) & special, filled == 0
        empties = np.bincount(own[empty], minlength=len(docs))
        free = np.minimum(empties, spare)  # skipped for fewer common keys
        trade = np.minimum(np.bincount(own[two], minlength=len(docs)), empties - free)
        need = (spare - free + 2) // 2

        def ranked(mask: np.ndarray, most: np.ndarray, own=own) -> np.ndarray:
            """The first ``most`` masked segments of each document."""
            at = np.flatnonzero(mask)
            rank = np.arange(len(at)) - np.searchsorted(own[at], own[at])
            return at[rank < most[own[at]]]

        search = np.ones(total, bool)
        search[ranked(empty, free + trade)] = False
        doubled = ranked(two, trade)
        out.append((own, mix(tag + sums), search, need[own]))
        out.append((own[doubled], mix(tag[doubled] + sums[doubled] + U(0xD1)), np.ones(len(doubled), bool), need[own[doubled]]))
        three = special & (filled == 3)
        part = three[segment]
        out.append((owner[part], mix(tag[segment[part]] + sums[segment[part]] - value[part] + U(0xD1)), np.zeros(int(part.sum()), bool), need[owner[part]]))
        is_double = np.zeros(total, bool)
        is_double[doubled] = True
        part = is_double[segment]
        out.append((owner[part], mix(tag[segment[part]] + sums[segment[part]] - value[part]), np.ones(int(part.sum()), bool), need[owner[part]]))
    which, keys, search, need = (np.concatenate(x) for x in zip(*out, strict=True))
    return docs[which], keys & ~U(1), search, need


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (id, component) after the edges (a, b) have joined components; each keeps its smallest id.

    Components hook on to their smallest neighbour and pointers are halved, all in Spark; staged after each round.
    """
    while True:
        a = labels.select(F.col("id").alias("a"), F.col("component").alias("x"))
        b = labels.select(F.col("id").alias("b"), F.col("component").alias("y"))
        edges = staged(edges.join(a, "a").join(b, "b").filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return labels
        parent = staged(edges.groupBy(F.col("a").alias("up")).agg(F.min("b").alias("p")))
        while True:
            above = parent.select(F.col("up").alias("p"), F.col("p").alias("q"))
            parent = staged(parent.join(above, "p", "left").select("up", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            moved = parent.filter("moved").isEmpty()
            parent = parent.select("up", "p")
            if moved:
                break
        labels = staged(labels.join(parent, labels["component"] == parent["up"], "left").select("id", F.coalesce("p", "component").alias("component")))


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity. A leader's partners are compared in groups of bounded size."""
    few = pairs.count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    share = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("shares"))
    dealt = pairs.join(share, "a").withColumn("share", F.pmod(F.xxhash64("b"), F.col("shares")))
    members = sets.join(small(dealt.select("a", "b", "share")), sets["id"] == F.col("b")).select("a", "share", "b", "n", "tokens")
    leaders = sets.join(small(dealt.select("a", "share").distinct()), sets["id"] == F.col("a")).select("a", "share", F.lit(None).cast("long").alias("b"), "n", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        ids, sizes, raw = (table.column(c).to_pylist() for c in ("b", "n", "tokens"))
        arrays = [np.frombuffer(r, U) for r in raw]
        heads = [(n, t) for i, n, t in zip(ids, sizes, arrays, strict=True) if i is None]
        good = set()
        for i, n, t in zip(ids, sizes, arrays, strict=True):
            if i is not None and i not in good:
                for m, h in heads:  # one, unless an id has several texts
                    common = len(np.intersect1d(h, t, assume_unique=True)) if den * min(m, n) >= num * max(m, n) else 0
                    if common and den * common >= num * (m + n - common):
                        good.add(i)
        return pa.Table.from_arrays([pa.array([table.column("a")[0].as_py()] * len(good), pa.int64()), pa.array(sorted(good), pa.int64())], ["a", "b"])

    return members.unionByName(leaders).groupBy("a", "share").applyInArrow(compare, "a long, b long")


def planes(values: np.ndarray, width: int) -> bytes:
    """The lowest bytes of all values, then the next ...; planes of zeros compress to nothing."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T.tobytes()


def unplaned(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u4").ravel()


def shared_counts(df: DataFrame, size: int) -> DataFrame:
    """Per row: doc_id, n_shingles, two hashes that tell its set, and how many of its shingles other rows have too, or a few more.

    Shingles go to buckets as three bytes of a hash, with the row's place in its slice; chance makes some of them equal.
    """
    n = exchange.buckets(df, "text")
    row = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("ids", pa.list_(pa.int64()))])
    ROW = "bucket long, slice long, keys binary, owners binary, ids array<long>"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                for part in slices(batch.slice(low, SLICE_ROWS)):
                    tokens, first = shingle_sets(part.column("text"), size)
                    info = [np.diff(first).astype(np.int64)]
                    for salt in (0x1234567, 0x7654321):
                        total = np.append(np.zeros(1, U), np.cumsum(mix(tokens + U(salt))))
                        info.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                    key = mix(tokens + U(0x3C6EF372FE94F82B))
                    place = ((key >> U(32)) % U(n)).astype(np.int64)
                    order = np.argsort(place, kind="stable")  # owners ascend in each bucket
                    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[order]
                    key, place = key[order], place[order]
                    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(key)] if len(key) else [0]
                    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([-1 - number % n, *(int(place[a]) for a, _ in spans)], pa.int64()), pa.array([number] * (1 + len(spans)), pa.int64()),
                        pa.array([np.concatenate(info).tobytes(), *(planes(key[a:b] & U(0xFFFFFF), 3) for a, b in spans)], pa.binary()),
                        pa.array([None, *(planes(np.diff(owner[a:b], prepend=0), 2) for a, b in spans)], pa.binary()),
                        pa.array([part.column("doc_id").to_pylist(), *[None] * len(spans)], pa.list_(pa.int64())),
                    ], schema=row)
                    number += 1

    def meet(table: pa.Table) -> pa.Table:
        release()
        if table.column("bucket")[0].as_py() < 0:
            return table
        raw = table.column("keys").to_pylist()
        keys = np.concatenate([unplaned(r, 3) for r in raw])
        times = np.bincount(keys, minlength=1 << 24)
        cuts = np.append(0, np.cumsum([len(r) // 3 for r in raw]))
        shared = times[keys] > 1
        out = []
        for a, b, r in zip(cuts[:-1], cuts[1:], table.column("owners").to_pylist(), strict=True):
            out.append(planes(np.diff(np.cumsum(unplaned(r, 2), dtype=np.int64)[shared[a:b]], prepend=0), 2))
        kept = [i for i, o in enumerate(out) if o]
        chosen = table.take(pa.array(kept, pa.int64()))
        return pa.Table.from_arrays([chosen.column("bucket"), chosen.column("slice"), pa.nulls(len(kept), pa.binary()), pa.array([out[i] for i in kept], pa.binary()), chosen.column("ids")], schema=row)

    def count(table: pa.Table) -> pa.Table:
        ids = next(i for i in table.column("ids").to_pylist() if i is not None)
        info = next(np.frombuffer(k, np.int64).reshape(3, -1) for k in table.column("keys").to_pylist() if k is not None)
        total = np.zeros(len(ids), np.int64)
        for r in table.column("owners").to_pylist():
            if r is not None:
                total += np.bincount(np.cumsum(unplaned(r, 2), dtype=np.int64), minlength=len(ids))
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, info), pa.array(total)], ["doc_id", "n_shingles", "h1", "h2", "shared"])

    met = df.mapInArrow(send, ROW).groupBy("bucket").applyInArrow(meet, ROW)
    return met.groupBy("slice").applyInArrow(count, "doc_id long, n_shingles long, h1 long, h2 long, shared long")


def chosen_sets(docs: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """Rows (id, n, tokens): the sets of all rows with a chosen id, equal ones of an id once if they meet in a slice."""
    small = F.broadcast(reps) if reps.count() <= FEW_IDS else reps  # then the texts need not be shuffled

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, first = shingle_sets(part.column("text"), size)
                rows = {}
                for i, k in enumerate(part.column("doc_id").to_pylist()):
                    if first[i + 1] > first[i]:
                        rows[k, tokens[first[i]:first[i + 1]].tobytes()] = None
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([len(t) // 8 for _, t in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], ["id", "n", "tokens"])

    return docs.join(small.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(work, "id long, n long, tokens binary")


def _sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    raw = table.column("tokens").to_pylist()
    return np.frombuffer(b"".join(raw), U), np.append(0, np.cumsum([len(r) // 8 for r in raw])).astype(np.int64)


def _repeated(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys that several rows of this block have, ascending."""
    pair = np.unique(np.stack([keys, doc.astype(U)]), axis=1) if len(keys) else np.zeros((2, 0), U)
    return np.unique(pair[0][1:][pair[0][1:] == pair[0][:-1]]) if pair.shape[1] else pair[0]


def _met(df: DataFrame, keys_of, finish, schema: str) -> DataFrame:
    """Blocks of rows (id, n, tokens) exchange the keys that ``keys_of(tokens, first)`` gives and end with those that other rows have too."""
    total = df.agg(F.sum(F.octet_length("tokens")).alias("b")).first()["b"] or 0
    count = max(2 * parts(df.sparkSession), -(-total // BLOCK_BYTES))
    n = max(parts(df.sparkSession), -(-total // (2 * BLOCK_BYTES)))
    blocks = df.withColumn("block", block_of("id", count))

    def send(table: pa.Table) -> pa.Table:
        release()
        _, keys, search = keys_of(*_sets_of(table))[:3]
        distinct, inverse = np.unique(keys, return_inverse=True)
        flag = np.bincount(inverse, search, len(distinct)) > 0 if len(keys) else np.zeros(0, bool)
        return exchange.packed(table.column("block")[0].as_py(), distinct | flag.astype(U), None, n)

    def gather(table: pa.Table, right: pa.Table) -> pa.Table:
        if not table.num_rows:
            return finish(table, np.zeros(0, U), np.zeros(1, np.int64), None)
        release()
        known = np.sort(np.frombuffer(b"".join(right.column("keys").to_pylist()), U))
        tokens, first = _sets_of(table)
        doc, keys, *more = keys_of(tokens, first)
        hit = exchange.among(keys, known) | exchange.among(keys, _repeated(keys, doc))
        return finish(table, tokens, first, [x[hit] for x in (doc, keys, *more)])

    grouped = blocks.groupBy("block")
    back = exchange.common_keys(grouped.applyInArrow(send, exchange.ROWS))
    return grouped.cogroup(back.groupBy("block")).applyInArrow(gather, schema)


def reduced(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (id, n, tokens) of which only shingles that other rows have too are left, and enough of them."""

    def keys_of(tokens: np.ndarray, first: np.ndarray):
        return np.repeat(np.arange(len(first) - 1), np.diff(first)), tokens & ~exchange.ONE, np.ones(len(tokens), bool), tokens

    def finish(table: pa.Table, tokens: np.ndarray, first: np.ndarray, hit) -> pa.Table:
        if hit is None:
            return table.select(["id", "n", "tokens"])
        doc, _, _, left = hit
        cuts = np.searchsorted(doc, np.arange(len(first)))
        keep = np.flatnonzero(den * np.diff(cuts) >= num * np.diff(first))
        kept = table.take(pa.array(keep))
        return pa.Table.from_arrays([kept.column("id"), kept.column("n"), pa.array([left[cuts[i]:cuts[i + 1]].tobytes() for i in keep], pa.binary())], ["id", "n", "tokens"])

    return _met(sets, keys_of, finish, "id long, n long, tokens binary")


def part_counts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many shingles of each set lie in each part of the universe, modulo 256: eight parts a column."""
    rows = len(first) - 1
    at = np.repeat(np.arange(rows), np.diff(first)) * PARTS + (mix(tokens + U(0x51ED270B)) % U(PARTS)).astype(np.int64)
    return np.bincount(at, minlength=rows * PARTS).astype(np.uint8).reshape(rows, PARTS).view("<i8")


def parities(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each set has an odd number of shingles in each of 512 parts of the universe: 64 parts a column."""
    rows = len(first) - 1
    place = (mix(tokens + U(0x1B873593)) % U(BITS)).astype(np.int64)
    out = np.zeros((rows, BITS // 64), "<i8")
    for low in range(0, rows, 4096):
        high = min(rows, low + 4096)
        at = np.repeat(np.arange(high - low), np.diff(first[low:high + 1])) * BITS + place[first[low]:first[high]]
        odd = (np.bincount(at, minlength=(high - low) * BITS) & 1).astype(np.uint8)
        out[low:high] = np.packbits(odd.reshape(high - low, BITS), axis=1).view("<i8")
    return out


def candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (id, n, tokens, s, p0, p1, keys, needs, q0 ... q7, least_keys) of sets that share enough keys; a key's lowest bit tells that it searches."""
    sketch = [(c, pa.int64()) for c in QS]
    empty = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("s", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64()), ("keys", pa.list_(pa.int64())), ("needs", pa.list_(pa.int32())), *sketch, ("least_keys", pa.list_(pa.int64()))]).empty_table()

    def finish(table: pa.Table, tokens: np.ndarray, first: np.ndarray, hit) -> pa.Table:
        if hit is None:
            return empty
        doc, keys, search, need = hit
        order = np.lexsort((keys, need, doc))
        doc, keys, search, need = doc[order], keys[order], search[order], need[order]
        if len(doc):  # one row a key, searching if any is; then enough keys of the same need
            change = np.append(True, (doc[1:] != doc[:-1]) | (need[1:] != need[:-1]) | (keys[1:] != keys[:-1]))
            search = np.logical_or.reduceat(search, np.flatnonzero(change))
            doc, keys, need = doc[change], keys[change], need[change]
            group = np.cumsum(np.append(True, (doc[1:] != doc[:-1]) | (need[1:] != need[:-1]))) - 1
            enough = np.bincount(group)[group] >= need
            doc, keys, search, need = doc[enough], keys[enough], search[enough], need[enough]
        cuts = np.searchsorted(doc, np.arange(len(first)))
        flagged = (keys | search.astype(U)).view(np.int64)
        at = np.flatnonzero(np.diff(cuts))
        kept, lanes, odd = table.take(pa.array(at)), part_counts(tokens, first)[at], parities(tokens, first)[at]
        order = np.lexsort((keys, doc))
        order = order[search[order]]
        low = np.searchsorted(doc[order], np.arange(len(first)))
        high, least = np.minimum(low[:-1] + LEAST_KEYS, low[1:]), keys[order].view(np.int64)
        return pa.Table.from_arrays([
            kept.column("id"), kept.column("n"), kept.column("tokens"), pa.array(np.diff(first)[at]), pa.array(lanes[:, 0]), pa.array(lanes[:, 1]),
            pa.array([flagged[cuts[i]:cuts[i + 1]] for i in at], pa.list_(pa.int64())), pa.array([need[cuts[i]:cuts[i + 1]].astype(np.int32) for i in at], pa.list_(pa.int32())),
            *(pa.array(odd[:, k]) for k in range(len(QS))), pa.array([least[low[i]:high[i]] for i in at], pa.list_(pa.int64())),
        ], schema=empty.schema)

    schema = f"id long, n long, tokens binary, s long, p0 long, p1 long, keys array<long>, needs array<int>, {', '.join(f'{c} long' for c in QS)}, least_keys array<long>"
    return _met(sets, lambda tokens, first: signatures(tokens, first, num, den), finish, schema)


def near(num: int, den: int) -> Column:
    """False only if the sets of a row and of the row ``head`` beside it differ by more shingles than linked sets do."""
    n, s = F.col("n") + F.col("head.n"), F.least("s", "head.s")
    apart = n - F.col("s") - F.col("head.s")
    for c in ("p0", "p1"):
        for k in range(0, 64, 8):
            step = F.pmod(F.shiftrightunsigned(c, k).bitwiseAND(255) - F.shiftrightunsigned(f"head.{c}", k).bitwiseAND(255), F.lit(256))
            apart = apart + F.least(step, 256 - step)
    return ((den + num) * s >= num * n) & ((den + num) * apart <= (den - num) * n)


def nearer(num: int, den: int) -> Column:
    """As ``near``, by parities: sets that differ in the parity of a part differ there by one shingle at least."""
    n, s = F.col("n") + F.col("head.n"), F.least("s", "head.s")
    apart = n - F.col("s") - F.col("head.s")
    for c in QS:
        apart = apart + F.bit_count(F.col(c).bitwiseXOR(F.col(f"head.{c}")))
    return ((den + num) * s >= num * n) & ((den + num) * apart <= (den - num) * n)


def across(met: DataFrame, sketches: DataFrame, own: list[str], num: int, den: int) -> DataFrame:
    """Pairs (a < b) of documents that share a key but no component, and whose sets may link.

    ``met`` has rows of keys with their component and the ``head`` of their key's largest component. Sets with a common key among
    their least searching ones, as nearly all linked sets have, form their pair under the smallest of those, others under each key.
    """
    met = met.join(F.broadcast(sketches) if sketches.count() <= SKETCH_ROWS else sketches, ["id", *own])
    beside = [*own, *QS, "least_keys", "search", "component"]
    outside = met.filter("component <> head.component").select("key", F.struct("id", *beside).alias("head"))
    others = met.select("key", "id", *beside, F.col("head.component").alias("main"))
    apart = (F.col("component") != F.col("head.component")) & ((F.col("component") == F.col("main")) | (F.col("id") > F.col("head.id")))
    both = F.array_intersect("least_keys", "head.least_keys")
    once = (F.size(both) == 0) | (F.col("key") == F.array_min(both))
    met = others.join(outside, "key").filter(apart & (F.col("search") | F.col("head.search")) & nearer(num, den) & once)
    return met.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"))


def join_components(df: DataFrame, size: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest id reachable by links den * common >= num * union)."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(shared_counts(docs, size))
    whole = ["n_shingles", "h1", "h2"]
    filled = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = staged(filled.groupBy(*whole).agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared")))
    alive = groups.filter(den * F.col("shared") >= num * F.col("n_shingles")).select("rep").distinct()
    found = staged(candidates(staged(reduced(staged(chosen_sets(docs, alive, size)), num, den)), num, den))
    sets, own = found.select("id", "n", "tokens"), ["n", "s", "p0", "p1"]
    keys = found.select("id", *own, F.explode(F.arrays_zip("keys", "needs")).alias("k"))
    keys = keys.select("id", *own, F.col("k.keys").bitwiseAND(F.lit(-2)).alias("key"), (F.col("k.keys").bitwiseAND(F.lit(1)) == 1).alias("search"), F.col("k.needs").alias("need"))

    # ids with several sets join their classes
    several = staged(filled.groupBy("doc_id").agg(F.min(F.struct(*whole)).alias("x"), F.max(F.struct(*whole)).alias("y")).filter("x <> y").select("doc_id"))
    labels = alive.select(F.col("rep").alias("id"))
    if several.isEmpty():
        labels = staged(labels.select("id", F.col("id").alias("component")))
    else:
        of_id = filled.join(several, "doc_id").join(groups, whole).select("doc_id", "rep")
        edges = staged(of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct())
        labels = labels.unionByName(edges.select(F.col("a").alias("id"))).unionByName(edges.select(F.col("b").alias("id"))).distinct()
        labels = merged(staged(labels.select("id", F.col("id").alias("component"))), edges)

    as_head = F.struct("id", *own, "search", "need", "component").alias("head")

    def common(met: DataFrame) -> DataFrame:
        met = met.filter((F.col("search") | F.col("head.search")) & near(num, den)).groupBy(F.col("head.id").alias("a"), F.col("id").alias("b"))
        return met.agg(F.count("*").alias("count"), F.min(F.least("need", "head.need")).alias("least")).filter(F.col("count") >= F.col("least"))

    left, rounds = keys, 0
    while True:
        now = left.join(F.broadcast(labels) if labels.count() <= BROADCAST_ROWS else labels, "id")
        if rounds:  # the largest component of a key, and its smallest id
            spans = now.groupBy("key", "component").agg(F.count("*").alias("count"), F.min(as_head).alias("head")).groupBy("key")
            spans = spans.agg(F.max_by("head", F.struct("count", -F.col("component"))).alias("head"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
        else:
            spans = now.groupBy("key").agg(F.min(as_head).alias("head"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").drop("least", "most")
        met = staged(now.join(spans, "key"))
        if met.isEmpty():
            break
        last = rounds == HEAD_ROUNDS
        if last:
            pairs = across(met, found.select("id", *own, *QS, "least_keys"), own, num, den).distinct()
        else:
            pairs = common(met.filter("component <> head.component")).groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a"))
        pairs = staged(pairs.select("a", "b"))
        links = pairs if pairs.isEmpty() else staged(linked(pairs, sets, num, den))
        if not links.isEmpty():
            labels = merged(labels, links)
        if last:
            break
        left, rounds = met.drop("component", "head"), HEAD_ROUNDS if links.isEmpty() else rounds + 1

    of_class = groups.join(labels, groups["rep"] == labels["id"], "left").select(*whole, F.coalesce("component", "rep").alias("component"))
    out = rows.drop("shared").join(of_class, whole, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", "component"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"))
