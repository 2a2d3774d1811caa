"""Change events of cache nodes: folding to a table, gaps, snapshots and parity.

``event_id`` is the order of arrival. An insert wins over what is stored only when it is newer; a remove always
applies and forgets how new the removed entry was; a remove without key clears everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordered import SLOT_ROWS, ordered_scan

STATE = ["query_key", "timestamp_ms", "payload", "upstream_id", "context_id"]


def _decision(node_id: str, now_ms: int) -> Column:
    """Why an event does not reach the table at all, or null."""
    expiry = F.col("absolute_expiry_ms")
    kind = F.col("event_type")
    bad_payload = (F.col("payload") == "") | F.try_parse_json("payload").isNull()
    return (
        F.when(F.col("origin_node_id") == node_id, "echo")
        .when((expiry > 0) & (expiry <= now_ms), "expired")
        .when(kind.isin("fetch_start", "fetch_cancel"), "ignored")
        .when((kind == "insert") & bad_payload, "bad_payload")
    )


def effective_events(events: DataFrame, node_id: str, now_ms: int) -> DataFrame:
    """The events that reach the table."""
    return events.filter(_decision(node_id, now_ms).isNull())


def reduce_cdc(events: DataFrame) -> DataFrame:
    """The few of ``effective_events`` that decide what they leave behind: one insert and one remove per key, and one clear-all.

    Aggregations only, all with map-side combine. Per key only inserts after its last remove and after the last clear count;
    the newest of them stays, the first to arrive among equals. Reduced events of several batches, in order of arrival, reduce to
    what all their events do, so a batch can be reduced without a look at what is stored.
    """
    removal = F.col("event_type") == "remove"
    cleared = events.agg(F.max(F.when(removal & (F.col("query_key") == ""), F.col("event_id"))).alias("c")).scalar()
    after_clear = F.col("event_id") > F.coalesce(cleared, F.lit(-2))
    removed = events.filter(removal & (F.col("query_key") != "")).groupBy("query_key").agg(F.max("event_id").alias("removed_at"))
    live = (
        events.filter((F.col("event_type") == "insert") & after_clear)
        .join(removed, "query_key", "left")
        .filter(F.col("event_id") > F.coalesce("removed_at", F.lit(-2)))
    )
    newest = F.struct(-F.col("timestamp_ms"), F.col("event_id"))
    kept = live.groupBy("query_key").agg(
        F.min_by(F.struct("event_id", "timestamp_ms", "payload", "upstream_id", "context_id"), newest).alias("x")
    )
    removes = removed.select("query_key", F.col("removed_at").alias("event_id")).filter(after_clear)
    clear = events.filter(removal & (F.col("query_key") == "")).groupBy("query_key").agg(F.max("event_id").alias("event_id"))
    return (
        kept.select("query_key", F.lit("insert").alias("event_type"), "x.*")
        .unionByName(removes.unionByName(clear).withColumn("event_type", F.lit("remove")), allowMissingColumns=True)
    )


def stored_entries(reduced: DataFrame) -> DataFrame:
    """The table that reduced events leave behind."""
    return reduced.filter(F.col("event_type") == "insert").select(*STATE)


def fold_cdc(events: DataFrame, node_id: str, now_ms: int) -> DataFrame:
    """Table that the events leave behind."""
    return stored_entries(reduce_cdc(effective_events(events, node_id, now_ms)))


def label_cdc(events: DataFrame, node_id: str, now_ms: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Add ``result`` to every event: applied, stale, or why it was skipped."""
    labelled = events.withColumn("_skip", _decision(node_id, now_ms))
    counted = F.col("_skip").isNull()
    clear = (counted & (F.col("event_type") == "remove") & (F.col("query_key") == "")).cast("int")
    remove = (counted & (F.col("event_type") == "remove")).cast("int")
    rows = labelled.withColumns(
        {
            "_clear": clear,
            "_remove": remove,
            "_ts": F.when(counted & (F.col("event_type") == "insert"), F.col("timestamp_ms")),
        }
    )
    rows = ordered_scan(rows, [], "event_id", [], slot_rows, running_sum={"_clears": "_clear"})
    rows = ordered_scan(rows, ["query_key"], "event_id", [], slot_rows, running_sum={"_removes": "_remove"})
    rows = ordered_scan(
        rows, ["query_key", "_clears", "_removes"], "event_id", [], slot_rows, prior_max={"_newest": "_ts"}
    )
    stale = F.coalesce(F.col("_newest") >= F.col("_ts"), F.lit(False))
    result = F.coalesce("_skip", F.when((F.col("event_type") == "insert") & stale, "stale").otherwise("applied"))
    return rows.select(*events.columns, result.alias("result"))


def cdc_counts(labelled: DataFrame) -> DataFrame:
    """Received, applied and skipped events."""
    applied = F.count_if(F.col("result") == "applied")
    return labelled.agg(
        F.count("*").alias("received"), applied.alias("applied"), (F.count("*") - applied).alias("skipped")
    )


def cdc_gaps(events: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Missing sequence numbers per origin: the last one before and the first one after each gap."""
    seen = ordered_scan(events, ["origin_node_id"], "sequence", [], slot_rows, previous={"after": "sequence"})
    gap = F.col("sequence") - F.col("after") - 1
    return seen.filter(gap > 0).select("origin_node_id", "after", F.col("sequence").alias("before"), gap.alias("missing"))


def snapshot_events(entries: DataFrame, node_id: str, now_ms: int, fresh: float, stale: float, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Insert events for all entries, numbered from 1 by age without a global sort, with a common expiry."""
    numbered = ordered_scan(
        entries.withColumn("_one", F.lit(1)), [], "cached_at", ["norm_key"], slot_rows, running_sum={"sequence": "_one"}
    )
    return numbered.select(
        "sequence",
        F.unix_millis("cached_at").alias("timestamp_ms"),
        F.lit("insert").alias("event_type"),
        F.col("norm_key").alias("query_key"),
        F.col("response_json").alias("payload"),
        "upstream_id",
        "context_id",
        F.lit(node_id).alias("origin_node_id"),
        F.lit(now_ms + int((fresh + stale) * 1000)).cast("bigint").alias("absolute_expiry_ms"),
    )


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys in each table and keys that differ: only in one, or with another time stamp."""
    both = a.select("query_key", F.col("timestamp_ms").alias("ta")).join(
        b.select("query_key", F.col("timestamp_ms").alias("tb")), "query_key", "full_outer"
    )
    return both.agg(
        F.count("ta").alias("a_keys"),
        F.count("tb").alias("b_keys"),
        F.count_if(F.col("tb").isNull()).alias("only_a"),
        F.count_if(F.col("ta").isNull()).alias("only_b"),
        F.count_if(F.col("ta") != F.col("tb")).alias("different"),
    )
