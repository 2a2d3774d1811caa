"""Windowed statistics and deduplication of log streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.logstats import traffic_aggregates


def stream_stats(
    log: DataFrame, length: str, watermark: str, slide: str | None = None, by: tuple[str, ...] = (), session_gap: str | None = None
) -> DataFrame:
    """Traffic counters per tumbling, sliding or session window; rows behind the watermark are dropped in append mode."""
    late = log.withWatermark("ts", watermark)
    if session_gap:
        window = F.session_window("ts", session_gap)
    else:
        window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = late.groupBy(window.alias("w"), *by).agg(*traffic_aggregates())
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *grouped.columns[1 + len(by):])


def dedup_log(log: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """First copy of every request; state is kept as long as the watermark."""
    return log.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["request_id"])
