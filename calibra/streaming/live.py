"""The same answers over streams: capture sessions and outcome counts as rows arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(events: DataFrame, key: str, gap: str = "5 minutes 1 microsecond", late: str = "10 minutes") -> DataFrame:
    """Sessions of events(key, ts) that a watermark closes: key, begin, end, events. A gap of exactly five minutes does not part."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"), F.min("ts").alias("begin"), F.max("ts").alias("end")).select(key, "begin", "end", "events")


def live_outcomes(outcomes: DataFrame) -> DataFrame:
    """Running counts of outcomes(truth, pred), for update mode."""
    return outcomes.groupBy("truth", "pred").agg(F.count("*").alias("n"))
