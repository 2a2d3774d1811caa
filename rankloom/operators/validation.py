"""Checks of requests, responses and time stamps, and content hashes of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import trim_space

# Limits of the data model, in bytes where they measure text.
MAX_QUERY_BYTES = 10_000
MAX_TOP_K = 1000
DEFAULT_TOP_K = 10
MAX_RESULTS = 1000
MAX_CONTENT_BYTES = 100_000
MAX_RESPONSE_BYTES = 10 * 1024 * 1024
RESULT_OVERHEAD_BYTES = 32

REQUEST_CONTROL = r"[\x01-\x08\x0B\x0C\x0E-\x1F]"
CONTENT_CONTROL = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
NUL = "\x00"


def validate_queries(df: DataFrame) -> DataFrame:
    """Add the code of the first failing rule (null when valid) and the effective top_k."""
    query, k = F.col("query"), F.col("top_k")
    code = (
        F.when(trim_space(query) == "", "empty_query")
        .when(F.octet_length(query) > MAX_QUERY_BYTES, "query_too_long")
        .when(query.contains(NUL), "null_byte")
        .when(query.rlike(REQUEST_CONTROL), "control_char")
        .when(k > MAX_TOP_K, "top_k_too_large")
    )
    effective = F.least(F.coalesce(k, F.lit(DEFAULT_TOP_K)), F.lit(MAX_TOP_K))
    return df.withColumns({"error_code": code, "effective_top_k": effective})


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and quarantined rows of a table that ``validate_queries`` has checked."""
    return df.filter(F.col("error_code").isNull()), df.filter(F.col("error_code").isNotNull())


def content_checks(hits: DataFrame) -> DataFrame:
    """Add what ``validate_responses`` asks of a content, so that the content itself need not travel to it."""
    content = F.col("content")
    code = (
        F.when(F.octet_length(content) > MAX_CONTENT_BYTES, "content_too_long")
        .when(content.contains(NUL), "content_null_byte")
        .when(content.rlike(CONTENT_CONTROL), "content_control_char")
    )
    return hits.withColumns({"content_error": code, "content_bytes": F.octet_length(content)})


def _hit_error() -> Column:
    score = F.col("score")
    infinite = score.isin(float("inf"), float("-inf"))
    return (
        F.when(F.col("id").cast("string") == "", "empty_result_id")
        .when(F.isnan(score) | infinite, "invalid_score")
        .otherwise(F.col("content_error"))
    )


def validate_responses(hits: DataFrame) -> DataFrame:
    """One row per query: the first rule its list of hits breaks, and the hit that breaks it.

    ``hits`` have a content, or the columns of ``content_checks``. A single aggregation with map-side combine; no list is ever collected.
    """
    if "content_error" not in hits.columns:
        hits = content_checks(hits)
    code = _hit_error()
    size = (
        F.octet_length(F.col("id").cast("string"))
        + F.col("content_bytes")
        + F.lit(RESULT_OVERHEAD_BYTES)
        + F.coalesce(F.octet_length("metadata"), F.lit(0))
    )
    per_query = hits.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.min(F.when(code.isNotNull(), F.struct("rank", code.alias("code"), F.col("id").cast("string").alias("id")))).alias(
            "bad"
        ),
        F.sum(size.cast("bigint")).alias("bytes"),
    )
    too_many, too_large = F.col("n") > MAX_RESULTS, F.col("bytes") > MAX_RESPONSE_BYTES
    return per_query.select(
        "query_id",
        F.when(too_many, "too_many_results")
        .when(F.col("bad").isNotNull(), F.col("bad.code"))
        .when(too_large, "response_too_large")
        .alias("error_code"),
        F.when(~too_many, F.col("bad.id")).alias("bad_result_id"),
    )


def check_timestamps(df: DataFrame, max_age_ms: int, now_ms: int, skew_ms: int) -> DataFrame:
    """Label ``generated_at`` (epoch ms, may be null) as ok, future or too_old."""
    at = F.col("generated_at")
    return df.withColumn(
        "time_check",
        F.when(at > now_ms + skew_ms, "future").when(at < now_ms - max_age_ms, "too_old").otherwise("ok"),
    )


def content_hash(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One hash per list of hits over its length and every rank, id, score, content and metadata.

    Each hit is hashed with its rank and the hashes are combined by xor, so equal lists give
    equal hashes and the aggregation combines before the shuffle.
    """
    text = F.concat_ws(
        "\u0001",
        F.col("rank").cast("string"),
        F.col("id").cast("string"),
        F.round(F.col("score") * 1e6).cast("bigint").cast("string"),
        F.col("content"),
        F.coalesce(F.col("metadata"), F.lit("")),
    )
    digest = F.sha2(text, 256)
    parts = [F.conv(F.substring("_digest", 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(4)]
    return (
        hits.select(*keys, digest.alias("_digest"))
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"), *[F.bit_xor(p).alias(f"_x{i}") for i, p in enumerate(parts)])
        .select(
            *keys,
            F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("_n", "_x0", "_x1", "_x2", "_x3")]), 256).alias(
                "content_hash"
            ),
        )
    )


def integrity_report(entries: DataFrame) -> DataFrame:
    """Total, valid, invalid and missing counts of ``stored_hash`` against ``content_hash``."""
    stored = F.col("stored_hash")
    return entries.agg(
        F.count("*").alias("total"),
        F.count_if(stored == F.col("content_hash")).alias("valid"),
        F.count_if(stored != F.col("content_hash")).alias("invalid"),
        F.count_if(stored.isNull()).alias("missing"),
    )


def drop_corrupted(entries: DataFrame) -> DataFrame:
    """Entries without those whose stored hash contradicts their content."""
    return entries.filter(F.col("stored_hash").isNull() | (F.col("stored_hash") == F.col("content_hash")))
