"""Image rows: (key, height, width, channels, data) with one byte per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` decoded by Spark (PNG, JPEG, BMP); undecodable ones keep a row with no data."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path)
    return images.select(
        F.col("image.origin").alias("key"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.when(F.col("image.height") > 0, F.col("image.data")).alias("data"),
    )
