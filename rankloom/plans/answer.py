"""The whole life of a query as one job over tables of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import query_key
from rankloom.functions.ttl import MAX_FROZEN_SECONDS, freshness
from rankloom.operators.cascade import CascadeConfig, Leg, cascade, upstream_failures
from rankloom.operators.embed import embed_texts
from rankloom.operators.scope import ScopeConfig, scope
from rankloom.operators.search_vector import semantic_match
from rankloom.operators.validation import content_checks, validate_queries, validate_responses
from rankloom.session import cut


@dataclass
class AnswerConfig:
    fresh_seconds: float = 300
    stale_seconds: float = 300
    max_frozen_seconds: float = MAX_FROZEN_SECONDS
    tau: float | None = 0.92  # None: no semantic tier
    scope_mode: str = "filter"
    cascade: CascadeConfig = field(default_factory=CascadeConfig)
    scope: ScopeConfig = field(default_factory=ScopeConfig)
    embedder: Callable[[DataFrame], DataFrame] | None = None


def answer_queries(
    queries: DataFrame,
    entries: DataFrame,
    entry_hits: DataFrame,
    legs: list[Leg],
    docs: DataFrame,
    phrases: DataFrame,
    now: str,
    cfg: AnswerConfig | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answer (query_id, query, context_id, top_k): responses and one audit row per query.

    ``entries`` (norm_key, context_id, query, cached_at) and ``entry_hits`` (norm_key, rank, id, score) are earlier
    answers. A valid query is served by its fresh or stale entry, else by the nearest entry of its
    context that has not expired, else by the cascade; equal queries are searched once, for as many results as the one of them
    that wants most, and each gets as many as it asked for. If every leg fails, the query's own entry serves it frozen as long as
    it has not expired; without one it ends as upstream_error. Legs that are up and find nothing are an empty answer.
    """
    cfg = cfg or AnswerConfig()
    checked = validate_queries(queries).withColumn("norm_key", query_key("query", "context_id"))
    valid = checked.filter(F.col("error_code").isNull())
    age = F.lit(now).cast("timestamp").cast("double") - F.col("cached_at").cast("double")
    classed = entries.withColumn(
        "freshness",
        freshness(age, F.col("norm_key"), cfg.fresh_seconds, cfg.stale_seconds, cfg.max_frozen_seconds),
    )

    # Distinct questions: the first asker leads, the others wait for the same answer.
    asked = valid.groupBy("norm_key", "context_id").agg(
        F.min_by("query", "query_id").alias("query"), F.min("query_id").alias("leader"), F.max("effective_top_k").alias("top_k")
    )
    exact = asked.join(classed.select("norm_key", "freshness"), "norm_key", "left")
    exact = cut(exact)
    served = exact.filter(F.col("freshness").isin("fresh", "stale"))
    rest = exact.filter(~F.coalesce(F.col("freshness").isin("fresh", "stale"), F.lit(False)))

    def vectors(df: DataFrame) -> DataFrame:
        return cut(embed_texts(df, "text", embedder=cfg.embedder).drop("text"))

    context_text = F.concat(F.lit("ctx:"), F.col("context_id"), F.lit(":"), F.col("query")).alias("text")
    if cfg.tau is None:
        matched = rest.select("norm_key", F.col("norm_key").alias("matched_key")).where("false")
    else:
        matched = semantic_match(
            vectors(rest.select(F.col("norm_key").alias("query_id"), "context_id", context_text)),
            vectors(entries.select(F.col("norm_key").alias("id"), "context_id", context_text)),
            tau=cfg.tau,
            within=("context_id",),
        ).select(F.col("query_id").alias("norm_key"), "matched_key")
    usable = classed.filter(F.col("freshness") != "expired").select(F.col("norm_key").alias("matched_key"))
    matched = matched.join(usable, "matched_key", "left_semi")
    routed = cut(rest.join(matched, "norm_key", "left"))
    missed = routed.filter(F.col("matched_key").isNull())

    # The leader's own short id stands for the question: a digest would travel with every candidate document.
    found, outcome, leg_scores = cascade(
        missed.select(F.col("leader").alias("query_id"), "query", "context_id", "top_k"), legs, cfg.cascade
    )
    down = upstream_failures(outcome, leg_scores).select(F.col("query_id").alias("leader"))
    failed = cut(missed.join(down, "leader").select("leader", "norm_key", F.coalesce(F.col("freshness") == "frozen", F.lit(False)).alias("frozen")))
    # a content ends where its hit is judged: it meets a hit that is complete, and goes into no later exchange or table
    listed = found.join(missed.select(F.col("leader").alias("query_id"), "context_id"), "query_id").join(docs.select("id", "content"), "id")
    scoped = cut(scope(content_checks(listed), phrases, cfg.scope_mode, cfg.scope, drop=("content",)))
    faulty = validate_responses(scoped.withColumn("metadata", F.lit(None).cast("string"))).filter(
        F.col("error_code").isNotNull()
    )
    fetched = (
        scoped.join(faulty.select("query_id"), "query_id", "left_anti")
        .withColumnRenamed("query_id", "leader")
        .join(missed.select("leader", "norm_key"), "leader")
    )

    key_hits = (
        served.select("norm_key", F.col("norm_key").alias("from_key"))
        .unionByName(routed.filter(F.col("matched_key").isNotNull()).select("norm_key", F.col("matched_key").alias("from_key")))
        .unionByName(failed.filter("frozen").select("norm_key", F.col("norm_key").alias("from_key")))
        .join(entry_hits.withColumnRenamed("norm_key", "from_key"), "from_key")
        .select("norm_key", "rank", "id", "score")
        .unionByName(fetched.select("norm_key", "rank", "id", "score"))
    )
    askers = valid.select("query_id", "norm_key", "effective_top_k")
    responses = (
        askers.join(key_hits, "norm_key").filter(F.col("rank") <= F.col("effective_top_k"))
        .select("query_id", "rank", "id", "score")
    )

    faults = faulty.select(F.col("query_id").alias("leader"), F.lit(True).alias("faulty"))
    by_key = (
        served.select("norm_key", "leader", F.when(F.col("freshness") == "fresh", "hit").otherwise("stale").alias("cache_status"),
                      F.lit("exact").alias("tier"), F.lit(None).cast("string").alias("miss_reason"))
        .unionByName(
            routed.join(failed.select("norm_key", "frozen", F.lit(True).alias("down")), "norm_key", "left").select(
                "norm_key",
                "leader",
                F.when(F.col("matched_key").isNotNull(), "hit").when(F.col("frozen"), "frozen").otherwise("miss").alias("cache_status"),
                F.when(F.col("matched_key").isNotNull(), "semantic").when(F.col("frozen"), "exact").otherwise("search").alias("tier"),
                F.when(F.col("matched_key").isNotNull(), None).when(F.col("down"), "upstream_error")
                .otherwise(F.when(F.col("freshness").isNull(), "not_in_cache").otherwise("expired")).alias("miss_reason"),
            )
        )
        .join(outcome.select(F.col("query_id").alias("leader"), "final_leg", "stop_reason"), "leader", "left")
        .join(faults, "leader", "left")
    )
    counts = key_hits.groupBy("norm_key").agg(F.count("*").alias("n"))
    audit = (
        checked.select("query_id", "norm_key", "error_code", "effective_top_k")
        .join(by_key, "norm_key", "left")
        .join(counts, "norm_key", "left")
        .select(
            "query_id",
            F.coalesce("cache_status", F.lit("error")).alias("cache_status"),
            F.when(F.col("error_code").isNull(), F.col("tier")).alias("tier"),
            F.when(F.col("faulty"), "upstream_error").otherwise(F.col("miss_reason")).alias("miss_reason"),
            "final_leg",
            "stop_reason",
            F.when(F.col("query_id") == F.col("leader"), "leader").when(F.col("leader").isNotNull(), "waiter").alias("role"),
            F.least(F.coalesce("n", F.lit(0)), "effective_top_k").cast("bigint").alias("result_count"),
            "error_code",
        )
    )
    return responses, audit
