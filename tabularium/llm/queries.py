"""The operators as registered queries over the given tables, with SQL twins where SQL can say them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabularium.llm import bytepair, compression, fingerprints, jaccard, language, middle, neighbours, packing, secrets, substrings, toxicity, turns, twins, warc
from tabularium.llm.common import shared_dir
from tabularium.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_secrets": twins.SECRETS, "op3_substrings": twins.SUBSTRINGS, "op7_jaccard": twins.JACCARD, "op10_warc": twins.WARC, "op11_turns": twins.TURNS, "op13_middle": twins.MIDDLE}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return (
        found.withColumn("listed", listed)
        .select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                F.sha2("listed", 256).alias("base_sha256"), F.col("listed").alias("spans"))
    )


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), special=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_bytepair(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bytepair.encode(table(spark, folder, "documents"), ranks, pattern, decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.find_repeats(table(spark, folder, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_trial(table(spark, folder, "documents"))


@query
def op6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.search(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query
def op7_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.join_components(table(spark, folder, "documents"), size=4, num=85)


@query
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    records = warc.round_trip(table(spark, folder, "pages"), place)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    field = language.train(docs, allowed=~language.held_out("doc_id", 4, 2))
    return language.identify(docs, field).select("doc_id", language.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), language.held_out("doc_id", 5, 0)
    model = toxicity.train(docs, table(spark, folder, "labels"), allowed=~held)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op12_compression(spark: SparkSession, folder: str) -> DataFrame:
    judged = compression.judge(table(spark, folder, "documents"), window=8)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op13_middle(spark: SparkSession, folder: str) -> DataFrame:
    both = middle.restore(middle.transform(table(spark, folder, "documents"), seed=7, rate=100, suffix_first=50))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query
def op11_turns(spark: SparkSession, folder: str) -> DataFrame:
    return turns.trial(table(spark, folder, "conversations"))
