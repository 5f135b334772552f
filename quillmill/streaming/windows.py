"""Event-time aggregation over unbounded events. Extensions: the reported analytics are monthly and bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAY = "1 hour"


def tumbling(events: DataFrame, width: str, time: str = "ts", group: str = "event_type", delay: str = DELAY) -> DataFrame:
    return windowed(events, F.window(time, width), time, group, delay)


def sliding(events: DataFrame, width: str, slide: str, time: str = "ts", group: str = "event_type", delay: str = DELAY) -> DataFrame:
    return windowed(events, F.window(time, width, slide), time, group, delay)


def sessions(events: DataFrame, gap: str, time: str = "ts", group: str = "user_id", delay: str = DELAY, also: dict[str, Column] | None = None) -> DataFrame:
    """``also`` has further aggregates by name. Bounds come from the events themselves: Spark moves filters on a session's window below the merging of sessions, where it isn't whole yet."""
    late = events.withWatermark(time, delay) if events.isStreaming else events
    counted = late.groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min(time).alias("start"), F.max(time).alias("latest"), *[c.alias(n) for n, c in (also or {}).items()])
    return counted.select("start", (F.col("latest") + F.expr(f"interval {gap}")).alias("end"), group, "n", "total", *(also or {}))


def windowed(events: DataFrame, window, time: str, group: str, delay: str) -> DataFrame:
    late = events.withWatermark(time, delay) if events.isStreaming else events
    counted = late.groupBy(window.alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n", "total")
