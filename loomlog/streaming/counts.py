"""Counts of commands kept up to date over a stream of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators.clean import drop_noise


def running_counts(entries: DataFrame) -> DataFrame:
    """Frequency and last use of each command; for output mode complete or update."""
    return drop_noise(entries).groupBy("command").agg(F.count("*").alias("frequency"), F.max("timestamp").alias("last_used"))


def windowed_counts(entries: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Frequency per time window, with late entries up to ``delay``."""
    timed = drop_noise(entries).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)
    return timed.groupBy(F.window("timestamp", window), "command").agg(F.count("*").alias("frequency"))
