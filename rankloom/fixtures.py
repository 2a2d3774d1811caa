"""Bindings of the operators' inputs to the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import SPACE

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark passages as queries."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("query"),
        F.lit(5).alias("top_k"),
        F.lit("bench").alias("context_id"),
    )


def own_k(item) -> Column:
    """A number of results of each query's own, one in four without."""
    kind = F.pmod(item, F.lit(4))
    return F.when(kind == 0, 1).when(kind == 1, 5).when(kind == 2, 20)


def failed_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Legs that fail for a query (query_id, upstream_id): where the last event of the two is no view and no purchase."""
    leg = F.pmod("user_id", F.lit(3))
    name = F.when(leg == 0, "fts_en").when(leg == 1, "fts_intl").otherwise("vec_all")
    last = table(spark, sf, "events").groupBy(F.pmod(F.col("value").cast("bigint"), F.lit(400)).alias("query_id"), name.alias("upstream_id")).agg(
        F.max_by("event_type", "event_id").alias("last")
    )
    return last.filter(~F.col("last").isin("view", "purchase")).select("query_id", "upstream_id")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a searchable corpus."""
    # At most one leading piece is empty, so seven pieces hold the first five words.
    word_list = F.array_remove(F.split(F.col("text"), SPACE, 7), "")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("corpus"),
        F.col("lang").alias("topic"),
        F.concat_ws(" ", F.slice(word_list, 1, 5)).alias("title"),
        F.array("lang", "source").alias("tags"),
    )


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a log of answered requests."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("client_id"),
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(4)).cast("string")).alias("context_id"),
        F.concat(F.lit("u"), F.pmod("user_id", F.lit(5)).cast("string")).alias("upstream_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("key"),
        kind.alias("event_type"),
        F.col("value").alias("latency_ms"),
        (kind != "error").alias("success"),
        F.when(kind.isin("view", "click"), "hit").when(kind == "purchase", "stale").otherwise("miss").alias(
            "cache_status"
        ),
        F.when(kind == "signup", "not_in_cache").when(kind == "error", "upstream_error").alias("miss_reason"),
    )


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Accesses in time order: a key, and the cluster of keys that mean the same."""
    return request_log(spark, sf).select(
        F.col("request_id").alias("seq"),
        "ts",
        F.col("key"),
        F.pmod("key", F.lit(30)).alias("cluster_id"),
        "context_id",
    )


def content_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases as changes of the content behind a cluster."""
    return (
        request_log(spark, sf)
        .filter(F.col("event_type") == "purchase")
        .select(F.pmod("key", F.lit(30)).alias("cluster_id"), "ts")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


# The scope phrases of the benchmark context: (phrase_id, text, weight, own floor).
PHRASES = [
    (1, "the", 1.0, None),
    (2, "thon the", 1.5, None),
    (3, "and onesen", 2.0, None),
    (4, "der und", 1.0, 0.6),
    (5, "queaux des", -1.0, None),
    (6, "it hein", 1.5, None),
]


def scope_phrases(spark: SparkSession) -> DataFrame:
    """The phrase dimension, a literal configuration table."""
    return spark.createDataFrame(
        [("bench", *p) for p in PHRASES],
        "context_id string, phrase_id int, text string, weight double, min_similarity double",
    )


def cdc_events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a change stream of three nodes; rows of the highest values got lost on the way.

    The sequence counts the events of a node in order of their ids.
    """
    from rankloom.operators.ordered import ordered_scan

    e = table(spark, sf, "events")
    kind = F.col("event_type")
    rows = e.select(
        "event_id",
        F.concat(F.lit("n"), F.pmod("user_id", F.lit(3)).cast("string")).alias("origin_node_id"),
        (F.unix_millis(F.col("ts").cast("timestamp")) - F.pmod(F.col("event_id") * 7919, F.lit(600_000))).alias(
            "timestamp_ms"
        ),
        F.when(kind.isin("signup", "view"), "insert").when(kind == "error", "remove").when(kind == "purchase", "fetch_start")
        .otherwise("fetch_cancel").alias("event_type"),
        F.when((kind == "error") & (F.col("value") > 470), "").otherwise(F.get_json_object("props", "$.k")).alias("query_key"),
        F.when(F.col("value") < 5, "").otherwise(F.to_json(F.struct(F.col("value").alias("took_ms")))).alias("payload"),
        F.concat(F.lit("u"), F.pmod("user_id", F.lit(5)).cast("string")).alias("upstream_id"),
        F.concat(F.lit("c"), F.pmod("user_id", F.lit(4)).cast("string")).alias("context_id"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, F.lit(0)).otherwise(F.unix_millis(F.col("ts").cast("timestamp")) + 86_400_000)
        .cast("bigint").alias("absolute_expiry_ms"),
        F.lit(1).alias("_one"),
        "value",
    )
    counted = ordered_scan(rows, ["origin_node_id"], "event_id", [], running_sum={"sequence": "_one"})
    return counted.filter(F.col("value") <= 480).drop("_one", "value")
