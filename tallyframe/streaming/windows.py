"""Windows over event time, the same for a stream and for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    """ts as a timestamp with a zone, which watermarks need."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if events.isStreaming else rows


def tumbling(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    return sliding(events, width, width, late)


def sliding(events: DataFrame, width: str, step: str, late: str = "1 hour") -> DataFrame:
    """(event_type, start, end, n, total)."""
    w = F.window("ts", width) if width == step else F.window("ts", width, step)
    out = _timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once; a stream forgets ids that the watermark has passed."""
    rows = _timed(events, late)
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])


def paired(left: DataFrame, right: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Events of one user on two streams, the right one no later than so long after the left."""
    a = _timed(left, late).select(F.col("user_id").alias("user"), F.col("ts").alias("left_ts"), F.col("event_id").alias("left_id"))
    b = _timed(right, late).select(F.col("user_id"), F.col("ts").alias("right_ts"), F.col("event_id").alias("right_id"))
    return a.join(b, F.expr(f"user = user_id and right_ts >= left_ts and right_ts <= left_ts + interval {within}")).drop("user")
