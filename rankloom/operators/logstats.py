"""Statistics of a request log. Latencies are kept as whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import ratio, round6
from rankloom.operators.drift import LEVELS
from rankloom.operators.ordered import ordered_scan

AUDIT_QUERY_BYTES = 200


def micros(latency_ms) -> Column:
    return F.round(F.col(latency_ms) * 1000).cast("bigint")


def _is(status: str) -> Column:
    return F.col("cache_status") == status


def _mean_ms(total: Column, n: Column) -> Column:
    """Whole-microsecond mean, shown in milliseconds."""
    return round6(F.when(n > 0, F.floor(total / n) / 1000).otherwise(0.0))


def query_stats(log: DataFrame, key: str = "key", hash_only: bool = False) -> DataFrame:
    """Per query: requests, hits, misses, hit rate, latencies, first and last time seen."""
    rows = log.select(
        (F.sha2(F.col(key).cast("string"), 256) if hash_only else F.col(key)).alias("query_key"),
        "ts", "cache_status", micros("latency_ms").alias("us"),
    )
    n, hits = F.count("*"), F.count_if(_is("hit"))
    return rows.groupBy("query_key").agg(
        n.alias("requests"),
        hits.alias("hits"),
        (n - hits).alias("misses"),
        round6(ratio(hits, n)).alias("hit_rate"),
        _mean_ms(F.sum("us"), n).alias("avg_ms"),
        (F.max("us") / 1000).alias("max_ms"),
        (F.min("us") / 1000).alias("min_ms"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def top_queries(stats: DataFrame, by: str = "requests", n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc(by), F.asc("query_key")).limit(n)


def low_hit_rate(stats: DataFrame, threshold: float, n: int = 10) -> DataFrame:
    """Repeated queries with the lowest hit rates."""
    rows = stats.filter((F.col("requests") > 1) & (F.col("hit_rate") < threshold))
    return rows.orderBy(F.asc("hit_rate"), F.asc("query_key")).limit(n)


def overall_stats(log: DataFrame, key: str = "key") -> DataFrame:
    """Unique queries, requests, hits, hit rate and mean latency; built on per-query sums."""
    per_key = log.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(_is("hit")).alias("h"), F.sum(micros("latency_ms")).alias("us")
    )
    return per_key.agg(
        F.count("*").alias("unique_queries"),
        F.sum("n").alias("requests"),
        F.sum("h").alias("hits"),
        round6(ratio(F.sum("h"), F.sum("n"))).alias("hit_rate"),
        _mean_ms(F.sum("us"), F.sum("n")).alias("avg_ms"),
    )


def audit_text(query: str) -> Column:
    """Query as the audit log keeps it: at most 200 bytes of whole characters, then three dots."""
    head = F.make_valid_utf8(F.substring(F.encode(F.col(query), "UTF-8"), 1, AUDIT_QUERY_BYTES).cast("string"))
    whole = F.regexp_replace(head, "\ufffd+$", "")
    return F.when(F.octet_length(query) > AUDIT_QUERY_BYTES, F.concat(whole, F.lit("..."))).otherwise(F.col(query))


def audit_stats(log: DataFrame) -> DataFrame:
    n = F.count("*")
    return log.agg(
        n.alias("total"),
        round6(ratio(F.count_if("success"), n)).alias("success_rate"),
        round6(ratio(F.count_if(_is("hit")), n)).alias("hit_rate"),
        F.floor(F.sum(F.floor("latency_ms").cast("bigint")) / n).alias("avg_latency_ms"),
    )


def audit_select(
    log: DataFrame,
    client_id=None,
    failures: bool = False,
    slower_than_ms: float | None = None,
    recent: int | None = None,
) -> DataFrame:
    """Log rows of a client, failed ones, ones strictly slower than a limit, the most recent ones."""
    if client_id is not None:
        log = log.filter(F.col("client_id") == client_id)
    if failures:
        log = log.filter(~F.col("success"))
    if slower_than_ms is not None:
        log = log.filter(F.col("latency_ms") > slower_than_ms)
    if recent is not None:
        log = log.orderBy(F.desc("ts"), F.desc("request_id")).limit(recent)
    return log


def traffic_aggregates() -> list[Column]:
    """The counters of a traffic snapshot, for batch groups and stream windows alike."""
    n, errors = F.count("*"), F.count_if(F.col("miss_reason") == "upstream_error")
    return [
        n.alias("total"),
        F.count_if(_is("hit")).alias("hits"),
        F.count_if(_is("stale")).alias("stale"),
        F.count_if(_is("miss")).alias("misses"),
        F.count_if(F.col("miss_reason") == "not_in_cache").alias("not_in_cache"),
        errors.alias("upstream_errors"),
        round6(ratio(F.count_if(_is("hit")), n)).alias("hit_rate"),
        round6(ratio(errors, n)).alias("error_rate"),
        _mean_ms(F.sum(micros("latency_ms")), n).alias("avg_ms"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
    ]


def traffic_snapshot(log: DataFrame, group: list[str]) -> DataFrame:
    """Traffic counters for every level of ``group``, down from the grand total (null keys)."""
    return log.rollup(*group).agg(*traffic_aggregates())


def cascade_traffic(outcomes: DataFrame) -> DataFrame:
    """Counts of cascade stop reasons and the mean depth."""
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("stop_reason") == "threshold_met").alias("met"),
        F.count_if(F.col("stop_reason") == "all_exhausted").alias("exhausted"),
        F.count_if(F.col("stop_reason") == "max_depth_reached").alias("depth_limited"),
        round6(F.avg("depth")).alias("avg_depth"),
    )


def drift_traffic(levels: DataFrame) -> DataFrame:
    """Drift observations (level, alert) by level, and how many of them raised an alert that the one before had not."""
    return levels.agg(
        *[F.count_if(F.col("level") == x).alias(f"drift_{x}") for x in LEVELS],
        F.count_if("raised").alias("drift_alerts"),
    )


def metrics_snapshot(log: DataFrame, outcomes: DataFrame, levels: DataFrame) -> DataFrame:
    """One row: traffic counters of a log, of its cascades (query_id, stop_reason, depth) and of its drift (upstream_id, ts, seq, level, alert).

    An alert counts where it begins: at an observation whose upstream had none at the one before.
    """
    begun = ordered_scan(levels, ["upstream_id"], "ts", ["seq"], previous={"_before": "alert"})
    begun = begun.withColumn("raised", F.col("alert") & ~F.coalesce("_before", F.lit(False)))
    parts = [log.agg(*traffic_aggregates()), cascade_traffic(outcomes), drift_traffic(begun)]
    named = [p.select(F.lit(0).alias("_one"), *[F.col(c).alias(f"{n}{c}") for c in p.columns]) for p, n in zip(parts, ("", "cascade_", ""))]
    # one row each
    return named[0].join(named[1], "_one").join(named[2], "_one").drop("_one")


def context_stats(log: DataFrame) -> DataFrame:
    n, hits = F.count("*"), F.count_if(_is("hit"))
    return log.groupBy("context_id").agg(
        n.alias("queries"), hits.alias("hits"), (n - hits).alias("misses"), round6(ratio(hits, n)).alias("hit_rate")
    )


def agent_usage(log: DataFrame, agents: DataFrame) -> DataFrame:
    """Usage per agent (client_id, allowed contexts; none listed means all).

    The log is summed per agent and context before it meets the agents.
    """
    per_context = log.groupBy("client_id", "context_id").agg(
        F.count("*").alias("n"), F.count_if(_is("hit")).alias("h"), F.count_if(_is("miss")).alias("m"),
        F.count_if("rate_limited").alias("r"),
    )
    rows = agents.join(per_context, "client_id", "left")
    denied = F.col("context_id").isNotNull() & (F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("context_id"))

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    return rows.withColumn("d", F.when(denied, F.col("n"))).groupBy("client_id").agg(
        total("n").alias("requests"), total("h").alias("hits"), total("m").alias("misses"),
        total("r").alias("rate_limited"), total("d").alias("context_denied"),
    )


def mutation_stats(log: DataFrame) -> DataFrame:
    """Mutations and entries touched: per mutation and reason, per context, and in all."""
    sets = [[F.col("mutation"), F.col("reason")], [F.col("context_id")], []]
    return log.groupingSets(sets, "mutation", "reason", "context_id").agg(
        F.count("*").alias("mutations"), F.sum("entries_affected").alias("entries")
    )


def embed_stats(log: DataFrame) -> DataFrame:
    """Embedding lookups (source cached, coalesced or computed): counts and hit rate."""
    n, hits = F.count("*"), F.count_if(F.col("source") == "cached")
    return log.agg(
        n.alias("lookups"),
        hits.alias("hits"),
        F.count_if(F.col("source") == "computed").alias("computed"),
        F.count_if(F.col("source") == "coalesced").alias("coalesced"),
        round6(ratio(hits, n)).alias("hit_rate"),
    )


def upstream_rates(log: DataFrame) -> DataFrame:
    """Failure rate per upstream and its share of all requests."""
    per = log.groupBy("upstream_id").agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("failures"))
    all_requests = per.agg(F.sum("requests").alias("n")).scalar()
    return per.select(
        "upstream_id", "requests", "failures",
        round6(ratio(F.col("failures"), F.col("requests"))).alias("failure_rate"),
        round6(F.col("requests") / all_requests).alias("share"),
    )
