"""Stored files: size and hash, and their verification."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def stored(spark: SparkSession, path: str, schema: T.StructType | str | None = None, kind: str = "parquet", **options: str) -> DataFrame | None:
    """The table at a path, or nothing if there is none (or, without a schema, no file in it)."""
    reader = spark.read.options(**options)
    try:
        return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def fingerprint(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    return files.select(key, F.length(content).cast("bigint").alias("size"), F.sha2(F.col(content), 256).alias("sha256"))


def verify(registry: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``size_ok`` and ``hash_ok`` per registered file; a missing file fails both."""
    found = stored.select(key, F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    return registry.join(found, key, "left").select(
        key, F.coalesce(F.col("size") == F.col("_size"), F.lit(False)).alias("size_ok"),
        F.coalesce(F.col("sha256") == F.col("_sha"), F.lit(False)).alias("hash_ok"),
    )
