"""Operator 6, approximate nearest neighbours: an adaptive dimension scan inside inverted lists.

Vectors get one more coordinate that makes all norms equal, so the largest inner product is the smallest distance, and are
rotated at random. Lists are the cells of centroids fitted on at most ``sample`` rows; every row is indexed. A query scans the
lists with the nearest centroids, as many as reach ``coverage`` of the true neighbours in the sample, and starts with the 2 k-th distance
to the sample rows of these lists as its bound. In a list, distances grow
by column blocks: after d of D coordinates a candidate is abandoned if its partial distance, scaled by D / d, exceeds
the query's k-th distance by more than the factor (1 + eps / sqrt(d)) ** 2, the rejection of "it is among the nearest". What
survives all blocks is scored exactly, in double precision, on the original vectors. Queries that the tests or the choice of lists leave
with fewer rows than min(k, candidates) are asked again: every block of every list, and no test, so they get the exact answer.

Long lists are split into blocks and queries into batches, so a task never holds more than ``block_rows`` vectors and
``batch`` queries. Vectors null, zero, holding null or non-finite components, of another dimension than the most common one, or
without id take no part. Of repeated query ids one is asked; rows with a query's own id are no candidates of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabularium.llm.common import staged

COLUMNS = 16
PAIRS = 16_384  # pairs scored at once


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v, square) that take part; v as doubles."""
    v = F.col("v")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & v.isNotNull() & ~F.exists("v", odd))
    rows = rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).filter("square > 0")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (common["d"] if common else -1))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]) if parts else np.zeros(0)
    return flat.reshape(len(column), -1)


class Index:
    """Rotation and centroids, from a sample; ``probes`` lists are scanned for a query."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, lists: int, square: float, k: int, coverage: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.square, self.ids, self.sample, self.k, dim = square, ids, sample, k, sample.shape[1] + 1
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        x = self.stored(sample)
        lists = min(lists, len(x))
        self.centres = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(12):
            own = self.distances(x, self.centres).argmin(axis=1)
            sizes = np.bincount(own, minlength=lists)
            sums = np.stack([np.bincount(own, x[:, j], lists) for j in range(dim)], axis=1)
            self.centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], self.centres)
        own = self.own = self.distances(x, self.centres).argmin(axis=1)
        asked = rng.choice(len(x), min(256, len(x)), replace=False)
        score = sample[asked] @ sample.T
        score[np.arange(len(asked)), asked] = -np.inf
        near = np.argsort(-score, axis=1)[:, :min(k, len(x) - 1)]
        rank = np.argsort(np.argsort(self.distances(self.asked(sample[asked]), self.centres), axis=1), axis=1)
        need = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel()) if near.size else np.zeros(1, int)
        self.probes = int(need[min(len(need) - 1, int(np.ceil(coverage * len(need))))]) + 1

    def stored(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(0, self.square - (v * v).sum(axis=1)))]) @ self.turn

    def asked(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.zeros(len(v))]) @ self.turn

    def limits(self, ids: np.ndarray, q: np.ndarray, near: np.ndarray) -> np.ndarray:
        """A bound that twice k sample rows of the lists ``near`` keep, so that k are found though some are missed."""
        score = self.nth(ids, q, 2 * self.k, near)
        return self.square + (q * q).sum(axis=1) - 2 * score

    def nth(self, ids: np.ndarray, q: np.ndarray, place: int, near: np.ndarray | None = None) -> np.ndarray:
        """The score at ``place`` among sample rows of other ids, in the lists ``near`` if given; minus infinity if they are fewer."""
        out = np.full(len(q), -np.inf)
        if len(self.sample) >= place:
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                score = q[part] @ self.sample.T
                score[ids[part][:, None] == self.ids[None]] = -np.inf
                if near is not None:
                    probed = np.zeros((len(score), len(self.centres)), bool)
                    np.put_along_axis(probed, near[part], True, axis=1)
                    score[~probed[:, self.own]] = -np.inf
                out[part] = np.partition(score, -place, axis=1)[:, -place]
        return out

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T


def scan(index: Index, ids: np.ndarray, v: np.ndarray, asked_ids: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, eps: float, rows: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the block for each query, of those the tests leave: query number, id, score."""
    x, y = index.stored(v), index.asked(q)
    dim = x.shape[1]
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
    limit = limit.copy()
    for start in range(0, len(x), rows):
        part = slice(start, start + rows)
        partial = np.zeros((len(q), len(x[part])))
        alive = asked_ids[:, None] != ids[part][None]
        for c in range(0, dim, COLUMNS):
            a, b = y[:, c:c + COLUMNS], x[part, c:c + COLUMNS]
            if alive.mean() > 0.25:
                partial += Index.distances(a, b)
            else:
                i, j = np.nonzero(alive)
                partial[i, j] += ((a[i] - b[j]) ** 2).sum(axis=1)
            d = min(c + COLUMNS, dim)
            bound = limit * (d / dim) * (1 + eps / np.sqrt(d)) ** 2 if d < dim else limit * (1 + 1e-9) + 1e-9
            alive &= partial <= bound[:, None]
        i, j = np.nonzero(alive)
        own = v[part]
        score = np.empty(len(i))
        for at in range(0, len(i), PAIRS):
            pair = slice(at, at + PAIRS)
            score[pair] = np.einsum("nd,nd->n", q[i[pair]], own[j[pair]])
        cuts = np.searchsorted(i, np.arange(len(q) + 1))
        for n in np.flatnonzero(np.diff(cuts)):
            mine = slice(cuts[n], cuts[n + 1])
            s, w = np.append(best[n][0], score[mine]), np.append(best[n][1], ids[part][j[mine]])
            order = np.lexsort((w, -s))[:k]
            best[n] = s[order], w[order]
            if len(order) == k:
                limit[n] = min(limit[n], index.square + (q[n] * q[n]).sum() - 2 * s[order[-1]])
    which = np.repeat(np.arange(len(q)), [len(s) for s, _ in best])
    return which, np.concatenate([w for _, w in best]), np.concatenate([s for s, _ in best])


def exact(ids: np.ndarray, v: np.ndarray, asked_ids: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of the block for each query, but for those that score below ``least``: query number, id, score."""
    score = q @ v.T
    score[asked_ids[:, None] == ids[None]] = -np.inf
    place = min(k, len(v))
    least = np.maximum(least, np.partition(score, -place, axis=1)[:, -place])
    least -= 1e-9 * np.sqrt((q * q).sum(axis=1) * (v * v).sum(axis=1).max())  # products are rounded by their place in the matrix
    alive = np.isfinite(score) & (score >= least[:, None])
    which, found, best = [], [], []
    for n in np.flatnonzero(alive.any(axis=1)):
        j = np.flatnonzero(alive[n])
        s = np.einsum("nd,nd->n", np.broadcast_to(q[n], (len(j), q.shape[1])), v[j])
        order = np.lexsort((ids[j], -s))[:k]
        which.append(np.full(len(order), n))
        found.append(ids[j][order])
        best.append(s[order])
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(which), np.concatenate(found), np.concatenate(best)


def search(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = 20_000, list_rows: int = 2048, most_lists: int = 1024,
           coverage: float = 0.97, eps: float = 2.1, block_rows: int = 4096, batch: int = 1024) -> DataFrame:
    """Rows (query_id, rank, id, score): each query's k nearest by inner product; ``is_query`` is over the column ``id``."""
    spark = df.sparkSession
    rows = usable(df, key, vector)
    facts = rows.agg(F.count("*").alias("n"), F.max("square").alias("square"), F.count(F.when(is_query, 1)).alias("asked")).first()
    n = facts["n"]
    names = f"query_id long, {key} long, score double"
    if n < 2 or not facts["asked"]:
        return spark.createDataFrame([], names).select("query_id", F.lit(1).alias("rank"), key, "score")
    rate = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 1.2 * sample / n)) + 1
    chosen = rows.filter(rate).select("id", "v").limit(sample).collect()  # at most ``sample`` vectors
    if len(chosen) < 2:
        chosen = rows.select("id", "v").limit(sample).collect()
    index = Index(np.array([r["id"] for r in chosen]), np.array([r["v"] for r in chosen]), min(most_lists, -(-n // list_rows)), facts["square"], k, coverage)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                own = Index.distances(index.stored(matrix(b.column("v"))), index.centres).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(own.astype(np.int64))], ["id", "v", "list"])

    placed = staged(rows.select("id", "v").mapInArrow(assign, "id long, v array<double>, list long"))
    blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))  # one row a list

    def dealt(batches: int) -> DataFrame:
        """The stored rows by list and block, once for each batch of queries."""
        return placed.join(F.broadcast(blocks), "list").select(
            "list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"), "id", "v")

    def sent(asked: DataFrame, batches: int, *more: str) -> DataFrame:
        """The queries by list, block and batch; ``asked`` has the blocks of each list."""
        return asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"), "id", "v", *more)

    def probe(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"))
                far = Index.distances(index.asked(v), index.centres)
                near = np.argsort(far, axis=1, kind="stable")[:, :index.probes]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(index.limits(np.array(b.column("id")), v, near)), lists], ["id", "v", "limit", "lists"])

    def met(stored: DataFrame, asked: DataFrame, bound: str, best) -> DataFrame:
        """``best(ids, vectors, query ids, queries, bounds)`` on every block and batch, and the ranks over all."""

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", key, "score"])
            ids, own = np.array(left.column("id")), np.array(right.column("id"))
            which, found, score = best(ids, matrix(left.column("v")), own, matrix(right.column("v")), np.array(right.column(bound)))
            return pa.Table.from_arrays([pa.array(own[which]), pa.array(found), pa.array(score)], ["query_id", key, "score"])

        groups = ["list", "block", "batch"]
        found = stored.groupBy(*groups).cogroup(asked.groupBy(*groups)).applyInArrow(meet, names)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), key)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", key, "score")

    queries = placed.filter(is_query)
    single = queries.dropDuplicates(["id"]).select("id", "v")
    batches = -(-facts["asked"] // batch)
    asked = single.mapInArrow(probe, "id long, v array<double>, limit double, lists array<long>")
    asked = asked.select("id", "v", "limit", F.explode("lists").alias("list")).join(F.broadcast(blocks), "list")
    first = staged(met(dealt(batches), sent(asked, batches, "limit"), "limit", lambda *block: scan(index, *block, k, eps)))

    have = first.groupBy("query_id").agg(F.count("*").alias("have"))
    short = queries.groupBy("id").agg(F.count("*").alias("same")).join(have, F.col("id") == F.col("query_id"), "left")
    short = staged(short.filter(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.col("same"))).select("id"))
    left = short.count()
    if not left:
        return first

    def floor(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(index.nth(np.array(b.column("id")), v, k))], ["id", "v", "least"])

    batches = -(-left // batch)
    again = single.join(short, "id", "left_semi").mapInArrow(floor, "id long, v array<double>, least double").crossJoin(F.broadcast(blocks))
    whole = met(dealt(batches), sent(again, batches, "least"), "least", lambda *block: exact(*block, k))
    return first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(whole)
