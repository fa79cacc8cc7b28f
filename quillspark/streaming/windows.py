"""Event-time windows on streams and tables alike: watermarks bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by window and keys; rows later than ``late`` behind the newest are dropped on a stream, none on a table."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = marked.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def active_users(events: DataFrame, ts: str, user: str, width: str = "15 minutes", slide: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Distinct users by sliding window: exact on a table, approximate on a stream, where exact sets would be unbounded state."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    users = F.approx_count_distinct(user) if events.isStreaming else F.count_distinct(user)
    out = marked.groupBy(F.window(ts, width, slide).alias("w")).agg(users.alias("users"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "users")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end after ``gap`` without events."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    out = marked.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_requests(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once: on a stream within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
