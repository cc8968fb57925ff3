"""Feed a table to a stream in time order, and run a stream until its input is used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_slices(df: DataFrame, folder: str, ts: str, slices: int = 4, files: int = 4) -> None:
    """Append ``df`` to ``folder`` in ``slices`` consecutive time ranges of ``files`` files each; rows without a time come first."""
    probs = [i / slices for i in range(1, slices)]
    cuts = df.agg(F.percentile_approx(F.unix_micros(ts), probs, 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:]):
        part = df
        if low is not None:
            part = part.where(F.unix_micros(ts) > low)
        if high is not None:
            upto = F.unix_micros(ts) <= high
            part = part.where(upto if low is not None else upto | F.col(ts).isNull())
        part.repartition(files).write.mode("append").parquet(folder)


def open_stream(spark: SparkSession, folder: str, schema, files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def open_written(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Stream over what another query writes. A trigger takes as many files as a trigger of the writer may leave, one a partition, so that
    there are no more triggers than the writer had, however many files lie there."""
    return open_stream(spark, folder, schema, max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def drain(rows: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run to the end of the available input into Parquet and read the result back."""
    query = (
        rows.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def drain_batches(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    query = (
        rows.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
