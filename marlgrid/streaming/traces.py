"""Streams over the append-only trace (an extension: the batch engine needs none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layer_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events and mean time per layer and window; later events than the watermark are dropped."""
    timed = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "layer").agg(F.count(F.lit(1)).alias("n_events"), F.avg("elapsed_ms").alias("mean_ms"))


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a memory table and return it (tests, small reports)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
