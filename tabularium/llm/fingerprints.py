"""Operator 5, document fingerprints: a homomorphic multiset hash of a text's paragraphs.

Each paragraph (line) hashes to a wide vector, and a document's fingerprint is the sum of its paragraphs' vectors:
eight dense lanes modulo 2 ** 64, which decide equality, the number of paragraphs, and 256 lanes modulo 2 ** 32 with a Cauchy
variate of the paragraph each. Order does not matter; adding or removing a paragraph adds or subtracts its vector. Sums of Cauchy variates
are spread as widely as there are paragraphs, so the median size of the lanes of a difference estimates how many paragraphs
differ (repeats counted), to about a tenth whatever their number, up to some millions of them. Likeness is the share of common paragraphs in the union that this and
both numbers of paragraphs give.

Null and empty texts have no paragraph and the zero vector; equal fingerprints have likeness 1. Repeated rows each give a
row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from tabularium.llm.common import mix, parts, slices

DENSE, LANES = 8, 256
UNIT = 16  # lanes count sixteenths
TAIL = 64  # cells of the table at each end whose variates are computed
AT_ONCE = 2048  # paragraphs whose lanes are made at once
U = np.uint64
_SALT = mix(np.arange(1, LANES // 4 + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def variates(u: np.ndarray) -> np.ndarray:
    """Cauchy variates, in units, of numbers in [0, 1)."""
    return np.rint(UNIT * np.tan(np.pi * (u - 0.5))).astype(np.int64)


_TABLE = variates((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint32)


def lanes_of(seeds: np.ndarray) -> np.ndarray:
    """Sum of the lanes of paragraphs, by a hash of each."""
    out = np.zeros(LANES, np.uint32)
    for at in range(0, len(seeds), AT_ONCE):
        seed = seeds[at:at + AT_ONCE]
        cell = mix(seed[:, None] ^ _SALT).astype("<u8").view("<u2")
        lanes = _TABLE[cell]
        i, j = np.nonzero((cell < TAIL) | (cell >= (1 << 16) - TAIL))
        inside = (mix(seed[i] + (j + 1).astype(U) * U(0xC2B2AE3D27D4EB4F)) >> U(32)) / 2 ** 32
        lanes[i, j] = variates((cell[i, j] + inside) / (1 << 16)).astype(np.uint32)
        out += lanes.sum(axis=0, dtype=np.uint32)
    return out


RANGE_BYTES = 8 << 20  # text of one range of neighbours


def paragraphs(text: str | None) -> list[str]:
    return text.split("\n") if text else []


class Sum:
    """A fingerprint that paragraphs can join and leave."""

    def __init__(self, dense: np.ndarray | None = None, lanes: np.ndarray | None = None, number: int = 0):
        self.dense = np.zeros(DENSE, np.uint64) if dense is None else dense
        self.lanes = np.zeros(LANES, np.uint32) if lanes is None else lanes
        self.number = number

    @staticmethod
    def of(texts: Iterable[str]) -> Sum:
        digests = b"".join(hashlib.blake2b(t.encode(), digest_size=64).digest() for t in texts)
        if not digests:
            return Sum()
        parts = np.frombuffer(digests, "<u8").reshape(-1, DENSE)
        return Sum(parts.sum(axis=0, dtype=np.uint64), lanes_of(parts[:, 0]), len(parts))

    def __add__(self, other: Sum) -> Sum:
        return Sum(self.dense + other.dense, self.lanes + other.lanes, self.number + other.number)

    def __sub__(self, other: Sum) -> Sum:
        return Sum(self.dense - other.dense, self.lanes - other.lanes, self.number - other.number)

    def edited(self, before: list[str], after: list[str]) -> Sum:
        """The sum once the paragraphs ``before`` have become ``after``; common ones are not hashed again."""
        old, new = Counter(before), Counter(after)
        return self - Sum.of((old - new).elements()) + Sum.of((new - old).elements())

    def likeness(self, other: Sum) -> float:
        if (self.dense == other.dense).all():
            return 1.0
        both, least = self.number + other.number, abs(self.number - other.number)
        spread = float(np.median(np.abs((self.lanes - other.lanes).view(np.int32).astype(np.int64)))) / UNIT
        differ = least + 2 * round((spread - least) / 2)  # of the same parity as both
        differ = min(max(differ, least or 2), both)
        return (both - differ) / (both + differ)

    def text(self) -> str:
        return base64.b64encode(self.dense.astype("<u8").tobytes() + np.array([self.number], "<i8").tobytes() + self.lanes.astype("<u4").tobytes()).decode()

    @staticmethod
    def read(text: str) -> Sum:
        raw = base64.b64decode(text)
        at = DENSE * 8
        return Sum(np.frombuffer(raw, "<u8", DENSE).astype(np.uint64), np.frombuffer(raw, "<u4", LANES, at + 8).astype(np.uint32), int(np.frombuffer(raw, "<i8", 1, at)[0]))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and fingerprint of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [Sum.of(paragraphs(t)).text() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, pa.string())], ["key", "fingerprint"])

    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(work, f"key {source.schema['key'].dataType.simpleString()}, fingerprint string").withColumnRenamed("key", key)


def _neighbours(df: DataFrame, range_bytes: int) -> DataFrame:
    """Rows (doc_id, text, range, tail): ranges of descending ids, each with the row that follows its last one marked as tail.

    Null ids come last. Only one id per range goes through the driver.
    """
    spark = df.sparkSession
    size = df.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n")).first()
    n = max(parts(spark), -(-(size["b"] or 0) // range_bytes))
    cuts = df.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) if size["n"] and n > 1 else []
    cuts = sorted({float(c) for c in cuts})
    placed = df.withColumn("id", F.col("doc_id").cast("double"))
    if cuts:
        placed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="id", outputCol="bucket", handleInvalid="keep").transform(placed)
    else:
        placed = placed.withColumn("bucket", F.lit(0.0))
    last = len(cuts) + 1
    place = F.when(F.col("doc_id").isNull(), last).otherwise(len(cuts) - F.col("bucket")).cast("long")
    placed = placed.select("doc_id", "text", place.alias("range"), F.lit(False).alias("tail"))
    heads = sorted(placed.groupBy("range").agg(F.max("doc_id").alias("head")).collect())
    follow = [(heads[(i + 1) % len(heads)]["head"], heads[i]["range"]) for i in range(len(heads))]
    if not follow:
        return placed
    pairs = spark.createDataFrame(follow, "head long, range long")  # as many rows as ranges
    tails = df.join(F.broadcast(pairs) if len(follow) < 100_000 else pairs, df["doc_id"].eqNullSafe(pairs["head"]))
    return placed.unionByName(tails.select("doc_id", "text", "range", F.lit(True).alias("tail")))


def edit_trial(df: DataFrame, key: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each row's fingerprint, and that of its text once the next row (descending key, the first after the last; equal keys by
    text) has replaced its second half, with the likeness of both, and to the next row. Keys are integers."""
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True))
        rows.sort(key=lambda r: (r[2], r[0] is None, -(r[0] or 0), r[1]))
        own = [r for r in rows if not r[2]]
        out = []
        texts = [r[1] for r in rows[:len(own) + 1]]
        if not own:
            texts = []
        sums = [Sum.of(paragraphs(t)) for t in texts]
        for i, (k, value, _) in enumerate(own):
            half = len(value) // 2
            edited = value[:len(value) - half] + texts[i + 1][:half]
            changed = sums[i].edited(paragraphs(value), paragraphs(edited))
            digest = hashlib.sha256(edited.encode()).hexdigest()
            out.append((k, len(value), digest, sums[i].text(), changed.text(), sums[i].likeness(changed), sums[i].likeness(sums[i + 1])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _neighbours(source, range_bytes).groupBy("range").applyInArrow(work, schema).withColumnRenamed("doc_id", key)
