"""Tumbling aggregates on streams of events: an extension of the batch windows to event time.

The same functions run on batch and streaming DataFrames. In update mode, as ``replayed`` runs them, the
watermark drops the state of a window once the newest event is ``LATE`` past its end, and events that come later
than that. What a batch of events changed is written by batch; the last version of a window is its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import new_path

LATE = "2 hours"


def _start():
    return F.unix_timestamp(F.col("w.start")).alias("start")


def events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the files of an events table, with event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # a stream reads folders; one file is picked from its folder by name
    folder, _, name = path.rpartition("/")
    rows = source.option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_sums(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """(subject, start, n, sum_x) by user and window of event time."""
    grouped = rows.withWatermark("ts", LATE).groupBy(F.col("user_id").alias("subject"), F.window("ts", width).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("sum_x")).select("subject", _start(), "n", "sum_x")


def code_counts(rows: DataFrame, width: str = "2 hours") -> DataFrame:
    """(subject, code, start, n): a bag of event types by user and window of event time."""
    grouped = rows.withWatermark("ts", LATE).groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("code"), F.window("ts", width).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select("subject", "code", _start(), "n")


def replayed(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], keys: list[str], files_per_batch: int = 1) -> DataFrame:
    """The result of ``transform`` on all that is in ``path``, run as a stream to its end; ``keys`` name a row of it."""
    base = new_path(spark, "live")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream = transform(events(spark, path, files_per_batch)).writeStream.outputMode("update").foreachBatch(keep)
    stream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    changed = spark.read.parquet(f"{base}/out")
    last = F.max_by(F.struct(*[c for c in changed.columns if c != "batch"]), "batch").alias("r")
    return changed.groupBy(*keys).agg(last).select("r.*")
