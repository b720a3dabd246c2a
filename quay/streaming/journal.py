"""Extension (not part of what the other operators must match): journals and events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "t string, n long, bytes long, sha256 string, at timestamp"


def journal_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New journal lines as they come; torn lines are left out."""
    lines = spark.readStream.text(folder).select(F.from_json("value", LINE).alias("l"))
    return lines.where("l is not null and l.t is not null").select("l.*")


def event_counts(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by type and window; state older than the watermark is dropped. ``ts`` without a zone counts as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
