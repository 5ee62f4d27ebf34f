"""Trip counts per cell, type and hour on a stream, equal to the batch counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridreach.operators.spatial import tile
from gridreach.sources.files import scratch

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def hourly_counts(trips: DataFrame, size: float) -> DataFrame:
    """Counts per (ix, iy, event_type, hour); works on a batch or on a stream with a watermark."""
    hour = F.window("start_time", "1 hour")
    g = trips.groupBy(tile(F.col("x"), size).alias("ix"), tile(F.col("y"), size).alias("iy"), "event_type", hour).agg(F.count("*").alias("n"))
    return g.select("ix", "iy", "event_type", F.col("window.start").alias("hour"), "n")


def stream_counts(stream: DataFrame, size: float, watermark: str = "1 hour") -> DataFrame:
    return hourly_counts(stream.withWatermark("start_time", watermark), size)


def run_to_table(spark: SparkSession, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Drain the available input; each micro-batch overwrites its own folder, so a retried batch changes nothing.

    Counts only grow, so the largest value of a key is its final one.
    """
    out, state = scratch(spark, "counts"), scratch(spark, "state")

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    return rows.groupBy(*keys).agg(F.max("n").alias("n"))
