"""Structured Streaming forms of the event operators; each takes a streaming DataFrame and keeps state only as long as its watermark allows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def read_events(spark, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Events from Parquet files as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, user_id, n: events of each user in each window; windows close when the watermark passes them."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "user_id", "n")


def first_of_each(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without those that come again under the same id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Write what has come so far as Parquet, once each, and stop; a later call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
