"""Requests in flight: coalescing in one node, and fetch spans across nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordered import SLOT_ROWS, ordered_scan
from rankloom.operators.renewal import renewal_chain


def coalesce_requests(log: DataFrame, key: str, seconds: str, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Label requests leader or waiter: a waiter starts while its key's leader is still running.

    ``log`` has (request_id, ts) and a duration in seconds; ``leader_at`` is the start of the leader.
    """
    at = F.unix_micros("ts")
    timed = log.withColumns({"_at": at, "_until": at + F.round(F.col(seconds) * 1_000_000).cast("bigint")})
    marked = renewal_chain(timed, [key], "ts", ["request_id"], closed=False, slot_rows=slot_rows)
    return marked.withColumns(
        {
            "role": F.when(F.col("opens"), "leader").otherwise("waiter"),
            "leader_at": F.timestamp_micros("span_at"),
        }
    ).drop("_at", "_until", "opens", "span_at")


def dedup_factor(labelled: DataFrame) -> DataFrame:
    """Requests, leaders and requests per leader."""
    return labelled.agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("role") == "leader").alias("leaders"),
        F.round(F.count("*") / F.count_if(F.col("role") == "leader"), 6).alias("factor"),
    )


def fetch_spans(cdc: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Spans between a fetch_start and the event of its key that ends it.

    An insert or a cancel ends a span, a later start replaces it; a start that nothing follows stays open.
    """
    events = cdc.filter(F.col("event_type").isin("fetch_start", "fetch_cancel", "insert")).withColumn(
        "_e", F.struct("event_type", "origin_node_id", "timestamp_ms")
    )
    events = events.withColumn("_ts", F.col("timestamp_ms") / 1000)
    order = ["origin_node_id", "sequence"]
    seen = ordered_scan(events, ["query_key"], "_ts", order, slot_rows, previous={"_before": "_e"})
    closed = seen.filter(F.col("_before.event_type") == "fetch_start").select(
        "query_key",
        F.col("_before.origin_node_id").alias("origin"),
        F.col("_before.timestamp_ms").alias("start_ms"),
        F.col("timestamp_ms").alias("end_ms"),
        F.when(F.col("event_type") == "insert", "inserted").when(F.col("event_type") == "fetch_cancel", "cancelled")
        .otherwise("replaced").alias("outcome"),
    )
    last = events.groupBy("query_key").agg(F.max_by("_e", F.struct("_ts", *order)).alias("e"))
    left_open = last.filter(F.col("e.event_type") == "fetch_start").select(
        "query_key",
        F.col("e.origin_node_id").alias("origin"),
        F.col("e.timestamp_ms").alias("start_ms"),
        F.lit(None).cast("bigint").alias("end_ms"),
        F.lit("open").alias("outcome"),
    )
    return closed.unionByName(left_open)


def wait_for_fetches(requests: DataFrame, spans: DataFrame, timeout_ms: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Whether each request (request_id, query_key, node_id, at_ms) waits for another node's fetch, and how that ends.

    The latest span that started before the request counts if it is still open then; a wait is served when the span
    ends within the timeout.
    """
    fetch = F.struct(F.col("origin").alias("origin"), F.col("end_ms").alias("end_ms"))
    marks = spans.select(
        "query_key", F.col("start_ms").alias("at_ms"), F.lit(0).alias("_row"), F.col("origin").alias("_by"), fetch.alias("_span")
    )
    asked = requests.withColumns({"_row": F.lit(1), "_by": F.col("node_id")})
    both = asked.unionByName(marks, allowMissingColumns=True).withColumn("_ts", F.col("at_ms") / 1000)
    seen = ordered_scan(both, ["query_key"], "_ts", ["_row", "_by", "request_id"], slot_rows, last_seen={"_open": "_span"})
    end = F.col("_open.end_ms")
    waits = F.col("_open").isNotNull() & (end.isNull() | (end > F.col("at_ms"))) & (F.col("_open.origin") != F.col("node_id"))
    left = end - F.col("at_ms")
    served = F.coalesce(left <= timeout_ms, F.lit(False))
    return seen.filter("_row = 1").select(
        "request_id",
        F.when(~waits, "proceed").when(served, "served").otherwise("timed_out").alias("outcome"),
        F.when(waits, F.when(served, left).otherwise(F.lit(timeout_ms))).otherwise(F.lit(0)).cast("bigint").alias("waited_ms"),
    )
