"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but the last return the columns of
``documents``, with n_chars brought up to date; null texts pass language identification no more, so later ones see none.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from itertools import pairwise

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabularium.llm import jaccard, language, packing, secrets, substrings
from tabularium.llm.common import shared_dir, slices, staged
from tabularium.session import table

FEW_IDS = 500_000  # ids that are broadcast, 4 MB
LEAST_SCORE = 0.4  # a text in one language scores near 1, an even mixture of two near 0.5


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null, or of which no language holds a fair share of the letters go."""
    field = language.train(docs, allowed=~language.held_out("doc_id", 4, 2))
    return language.keep_identified(docs, field, LEAST_SCORE)


def _single(docs: DataFrame, size: int) -> DataFrame:
    """One row, that of the least text, for each doc_id and set of shingles; texts without shingles and rows without id by their text."""
    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField("_set", T.StringType())])

    def with_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                tokens, first = jaccard.shingle_sets(part.column("text"), size)
                sets = [hashlib.sha256(tokens[a:b].tobytes()).hexdigest() if b > a else None for a, b in pairwise(first)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets, pa.string())], [*names, "_set"])

    repeated = staged(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    small = F.broadcast(repeated) if repeated.count() <= FEW_IDS else repeated  # then the texts need not be shuffled
    again = docs.join(small, "doc_id", "left_semi").select(*names).unionByName(docs.filter("doc_id IS NULL"))
    own = F.when(F.col("doc_id").isNull() | F.col("_set").isNull(), F.concat(F.lit("="), F.sha2("text", 256))).otherwise(F.col("_set"))
    again = again.mapInArrow(with_set, schema).groupBy("doc_id", own.alias("_set")).agg(F.min(F.struct("text", *[c for c in names if c not in ("doc_id", "text")])).alias("_row"))
    again = again.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.{c}") for c in names])
    return docs.filter("doc_id IS NOT NULL").join(small, "doc_id", "left_anti").select(*names).unionByName(again)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 on five-word shingles connect, the one with the smallest doc_id stays. Of its rows one of each
    set of shingles stays, and of rows without id one of each text."""
    found = jaccard.join_components(docs, size=5, num=80)
    copies = staged(found.filter("doc_id <> component_id").select("doc_id").distinct())
    few = copies.count() <= FEW_IDS  # then the texts need not be shuffled
    return _single(docs.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti").select(*docs.columns), size=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a 13-word window of a document with a smaller doc_id go; a document goes if nothing is left of it."""
    return _counted(substrings.remove_repeats(docs, window=13))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    return _counted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids (little-endian, 32 bits each) and places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
