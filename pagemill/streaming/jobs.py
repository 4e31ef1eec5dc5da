"""Streaming forms: result cache, job states, call rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = {"processing": 0, "running": 1, "success": 2, "partial": 2, "failed": 2}


def first_in_window(events: DataFrame, key: str, ts: str = "ts", hours: int = 24) -> DataFrame:
    """The first event of each key within the hours: what a result cache lets through. State ends with the watermark."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{hours} hours")
    return timed.dropDuplicatesWithinWatermark([key])


def rates(events: DataFrame, key: str, ts: str = "ts", window: str = "60 seconds", slide: str = "20 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls per key in sliding windows."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("calls")).select(F.col("window.start").alias("start"), key, "calls")


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Polling sessions of each key: a pause of ``gap`` ends one."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), key, "events")


def job_state(log: DataFrame, job: str = "scrape_id", status: str = "status", ts: str = "ts") -> DataFrame:
    """The state of each job from its log of states: the furthest one, the latest of equals. For batch, and for a stream in complete mode."""
    rank = F.lit(0)
    for name, n in ORDER.items():
        rank = F.when(F.col(status) == name, n).otherwise(rank)
    return log.groupBy(job).agg(F.max_by(status, F.struct(rank, F.col(ts))).alias(status), F.max(ts).alias(ts))
