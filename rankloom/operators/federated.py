"""Local and remote result lists: whether to ask the remote side, and how to merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordered import top_rows

MODES = ("local_only_fallback", "local_priority", "remote_priority", "interleave")


def federated_decision(
    queries: DataFrame,
    local: DataFrame,
    mode: str = "local_priority",
    min_results: int = 3,
    min_score: float = 0.7,
    fallback_on_empty: bool = True,
    fallback_on_low_score: bool = True,
) -> DataFrame:
    """Per query: whether the remote side is needed and why, from its local hits."""
    seen = local.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    n = F.coalesce("n", F.lit(0))
    if mode in ("interleave", "remote_priority"):
        reason = F.lit("always_remote")
    else:
        reason = (
            F.when(n == 0, "empty_local" if fallback_on_empty else "local_sufficient")
            .when(n < min_results, "below_min_results")
            .when(F.lit(fallback_on_low_score) & (F.greatest("top", F.lit(0.0)) < min_score), "low_confidence")
            .otherwise("local_sufficient")
        )
    rows = queries.select("query_id").join(seen, "query_id", "left").select("query_id", reason.alias("reason"))
    return rows.withColumn("query_remote", F.col("reason") != "local_sufficient")


def federated_merge(
    local: DataFrame, remote: DataFrame, mode: str = "local_priority", max_results: int = 10
) -> tuple[DataFrame, DataFrame]:
    """Merged hits (query_id, rank, id, score, source) and counts per query, for both lists as (query_id, rank, id, score)."""
    if mode not in MODES:
        raise ValueError(f"unknown merge mode {mode}")
    primary = "remote" if mode == "remote_priority" else "local"
    both = local.withColumn("source", F.lit("local")).unionByName(remote.withColumn("source", F.lit("remote")))
    both = both.withColumn("second", (F.col("source") != primary).cast("int"))
    sides = both.groupBy("query_id").agg(
        F.count_if(F.col("source") == "local").alias("local_count"),
        F.count_if(F.col("source") == "remote").alias("remote_count"),
    )
    if mode == "local_only_fallback":
        alone = sides.filter(F.col("local_count") == 0).select("query_id")
        kept = both.filter(F.col("second") == 0).unionByName(
            both.filter(F.col("second") == 1).join(alone, "query_id", "left_semi")
        )
        order = [F.asc("place"), F.asc("id")]
    elif mode == "interleave":
        place = F.struct((-F.col("score")).alias("s"), "second", "rank")
        kept = (
            both.groupBy("query_id", "id")
            .agg(F.min_by(F.struct("rank", "score", "source", "second"), place).alias("x"))
            .select("query_id", "id", "x.*")
        )
        order = [F.desc("score"), F.asc("second"), F.asc("place"), F.asc("id")]
    else:
        first = both.filter(F.col("second") == 0)
        later = (
            both.groupBy("query_id", "id")
            .agg(
                F.min("second").alias("second"),
                F.min_by(F.struct("rank", "score", "source"), F.struct("second", "rank")).alias("x"),
            )
            .filter(F.col("second") == 1)
            .select("query_id", "id", "x.*", "second")
        )
        kept = first.unionByName(later)
        order = [F.asc("second"), F.asc("place"), F.asc("id")]
    merged = top_rows(kept.withColumnRenamed("rank", "place"), ["query_id"], order, max_results)
    counts = kept.groupBy("query_id").agg(F.count("*").alias("kept"))
    dropped = F.lit(0) if mode == "local_only_fallback" else F.col("local_count") + F.col("remote_count") - F.col("kept")
    stats = sides.join(counts, "query_id").select(
        "query_id",
        "local_count",
        "remote_count",
        F.least("kept", F.lit(max_results)).alias("merged_count"),
        dropped.cast("bigint").alias("duplicates_removed"),
        (F.col("remote_count") > 0).alias("remote_queried"),
    )
    return merged.select("query_id", "rank", "id", "score", "source"), stats
