"""Streams: running error estimates over the verdict log, and windows over events.

State is bounded: two counters a frame for the estimate, and windows up to the watermark for events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators.gate import estimate
from pagequarry.sources.verdicts import parsed


def verdict_stream(spark: SparkSession, folder: str, files: int = 1000) -> DataFrame:
    """Valid verdicts as they are appended to the log."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files).text(folder)).where("problem IS NULL").drop("problem", "line")


def running_estimate(verdicts: DataFrame) -> DataFrame:
    """The error estimate over all verdicts so far; for output mode ``complete``."""
    return estimate(verdicts)


def event_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by tumbling, or with ``slide`` sliding, windows; repeated event ids count once."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    e = e.dropDuplicatesWithinWatermark(["event_id"]) if e.isStreaming else e.dropDuplicates(["event_id"])
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no gap of ``gap`` or more."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
