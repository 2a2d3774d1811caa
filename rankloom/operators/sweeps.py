"""What-if sweeps over logged probes and lists, token buckets, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import round6
from rankloom.operators.folds import CHUNK_ROWS, keyed_fold
from rankloom.operators.ordered import SLOT_ROWS, top_rows


def cascade_sweep(
    probes: DataFrame, thresholds: list[float], min_results: int = 1, max_depth: int = 3
) -> DataFrame:
    """Where each query's cascade would stop per threshold, from (query_id, upstream_id, priority, best_score, result_count, latency_ms).

    At most ``max_depth`` legs of a query are kept before they are folded to an array.
    """
    first = top_rows(probes, ["query_id"], [F.asc("priority"), F.asc("upstream_id")], max_depth, rank="_r")
    legs = first.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("_r", "upstream_id", "best_score", "result_count", "latency_ms"))).alias("legs")
    )
    swept = legs.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    good = F.filter(
        "legs", lambda leg: (leg["best_score"] >= F.col("threshold")) & (leg["result_count"] >= min_results)
    )
    swept = swept.withColumn("_hit", F.get(good, 0))
    depth = F.coalesce(F.col("_hit._r"), F.size("legs"))
    tried = F.slice("legs", F.lit(1), depth)
    return swept.select(
        "query_id",
        "threshold",
        F.col("_hit.upstream_id").alias("chosen"),
        F.array_join(F.transform(tried, lambda leg: leg["upstream_id"]), ",").alias("tried"),
        F.coalesce(F.col("_hit._r") > 1, F.lit(False)).alias("cascaded"),
        round6(F.aggregate(tried, F.lit(0.0), lambda acc, leg: acc + leg["latency_ms"])).alias("total_latency_ms"),
    )


def federated_sweep(hits: DataFrame, weights: tuple[float, ...] = (0.3, 0.5, 0.7), top_k: int = 10) -> DataFrame:
    """Per query and local weight: the order of (query_id, id, score, source) hits, and how many are local."""
    swept = hits.withColumn("weight", F.explode(F.array(*[F.lit(min(1.0, max(0.0, w))) for w in weights])))
    local = F.lower("source") == "local"
    scored = swept.withColumn(
        "adjusted", round6(F.when(local, F.col("score") * F.col("weight")).otherwise(F.col("score") * (1 - F.col("weight"))))
    )
    order = [F.desc("adjusted"), F.asc("source"), F.asc("id")]
    best = top_rows(scored, ["query_id", "weight"], order, top_k, rank="_r")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "id"))), lambda x: x["id"].cast("string"))
    return best.groupBy("query_id", "weight").agg(
        F.count_if(local).alias("local_count"),
        F.count_if(~local).alias("remote_count"),
        F.min_by("id", "_r").alias("top_id"),
        F.array_join(listed, ",").alias("ordered_ids"),
    )


def bucket_start() -> list:
    """State of a token bucket before its first request: full, never used."""
    return [None, None]


def bucket_step(state: list, now_us: int, rps: float, burst: float) -> tuple[list, tuple]:
    """Refill by the time passed, then take one token if there is one."""
    tokens, last = state
    tokens = burst if last is None else min(burst, tokens + (now_us - last) / 1e6 * rps)
    allowed = tokens >= 1.0
    tokens = tokens - 1.0 if allowed else tokens
    return [tokens, int(now_us)], (bool(allowed), round(tokens, 6))


def token_bucket(
    arrivals: DataFrame, key: str, rates: list[tuple[float, float]], chunk_rows: int = CHUNK_ROWS, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """Label (request_id, ts, key) arrivals allowed or denied for every (rps, burst), with the tokens left."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("rps"), F.lit(float(b)).alias("burst")) for r, b in rates]))
    rows = arrivals.withColumn("_g", grid).select(*arrivals.columns, "_g.rps", "_g.burst", F.unix_micros("ts").alias("_at"))
    return keyed_fold(
        rows, [key, "rps", "burst"], "ts", ["request_id"], ["_at", "rps", "burst"], "allowed boolean, tokens double",
        bucket_start, bucket_step, chunk_rows, slot_rows,
    ).drop("_at")


def compare_runs(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys of params and metrics whose values differ between the runs ``a`` and ``b`` of each pair; a missing key counts."""

    def values(side: str) -> DataFrame:
        chosen = pairs.select("a", "b").join(runs.withColumnRenamed("run_id", side), side)
        parts = [
            chosen.select("a", "b", F.lit(part).alias("part"), F.explode(part).alias("key", f"value_{side}"))
            for part in ("params", "metrics")
        ]
        return parts[0].unionByName(parts[1])

    both = values("a").join(values("b"), ["a", "b", "part", "key"], "full_outer")
    return both.filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def selected_run(runs: DataFrame) -> DataFrame:
    """The latest selected run of a session, else its last one."""
    place: Column = F.struct("selected", "seq")
    return runs.groupBy("session_id").agg(F.max_by("run_id", place).alias("run_id"))


def consecutive_runs(runs: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbouring runs of a session; runs are few per session."""
    w = Window.partitionBy("session_id").orderBy("seq")
    return runs.select(F.lag("run_id").over(w).alias("a"), F.col("run_id").alias("b")).filter(F.col("a").isNotNull())
