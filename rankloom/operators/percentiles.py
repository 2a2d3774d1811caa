"""Exact percentiles per group, by three definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import round6
from rankloom.operators.ordered import SLOT_ROWS, ordered_scan, top_rows


def _ranks(method: str, n: Column, p: Column) -> tuple[Column, Column, Column]:
    """1-based lower rank, upper rank and the share of the upper one."""
    if method == "nearest_rank":
        r = F.greatest(F.lit(1), F.least(n, F.ceil(p * n)))
        return r, r, F.lit(0.0)
    if method == "nearest_index":
        r = F.least(n, F.floor((n - 1) * p + 0.5) + 1)
        return r, r, F.lit(0.0)
    if method == "linear":
        at = (n - 1) * p
        low = F.floor(at)
        return low + 1, F.least(n, low + 2), at - low
    raise ValueError(f"unknown percentile method {method}")


def percentiles(
    df: DataFrame, group: list[str], value: str, ps: list[float], method: str, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """(group, p, value): exact percentiles.

    Values are counted first, with map-side combine; the running count is then taken in slots of at most ``slot_rows``
    values, so that a group of any size spreads over many tasks.
    """
    if not group:
        everything = percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, ps, method, slot_rows)
        return everything.drop("_all")
    counts = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    placed = ordered_scan(counts, group, value, [], slot_rows, running_sum={"_upto": "_n"})
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    wanted = totals.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    low, high, share = _ranks(method, F.col("_total"), F.col("p"))
    wanted = wanted.withColumns({"_low": low.cast("bigint"), "_high": high.cast("bigint"), "_share": share})
    after = F.col("_upto") - F.col("_n")
    near = placed.join(wanted, group).filter((F.col("_upto") >= F.col("_low")) & (after < F.col("_high")))
    is_low = (F.col("_upto") >= F.col("_low")) & (after < F.col("_low"))
    is_high = (F.col("_upto") >= F.col("_high")) & (after < F.col("_high"))
    both = near.groupBy(*group, "p").agg(
        F.max(F.when(is_low, F.col(value))).alias("_a"),
        F.max(F.when(is_high, F.col(value))).alias("_b"),
        F.max("_share").alias("_share"),
    )
    return both.select(*group, "p", round6(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias(value))


def adaptive_timeout(
    log: DataFrame, multiplier: float = 2.0, low_ms: float = 100.0, high_ms: float = 30_000.0, samples: int = 1000
) -> DataFrame:
    """Timeout per upstream: P99 of its last ``samples`` latencies times ``multiplier``, clamped."""
    last = top_rows(log, ["upstream_id"], [F.desc("ts"), F.desc("request_id")], samples, rank="_back")
    p99 = percentiles(last, ["upstream_id"], "latency_ms", [0.99], "nearest_rank")
    bounded = F.least(F.lit(high_ms), F.greatest(F.lit(low_ms), F.col("latency_ms") * multiplier))
    return p99.select("upstream_id", round6("latency_ms").alias("p99_ms"), round6(bounded).alias("timeout_ms"))
