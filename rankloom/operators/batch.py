"""Many queries in one call, with a status per query and a summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.validation import validate_queries


def batch_search(
    queries: DataFrame, search: Callable[[DataFrame], DataFrame], max_queries: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search all valid queries: (hits, status per batch id, summary).

    A batch id that occurs twice fails, like a query that breaks a rule. With ``max_queries`` a larger
    batch is refused as a whole.
    """
    if max_queries is not None and queries.limit(max_queries + 1).count() > max_queries:
        raise ValueError(f"batch has more than {max_queries} queries")
    ids = queries.groupBy("query_id").agg(F.count("*").alias("uses"))
    checked = validate_queries(queries).join(ids, "query_id")
    code = F.when(F.col("uses") > 1, "duplicate_id").otherwise(F.col("error_code"))
    status = checked.groupBy("query_id").agg(F.first(code).alias("error_code"))
    hits = search(queries.join(status.filter(F.col("error_code").isNull()), "query_id", "left_semi"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    per_query = status.join(found, "query_id", "left").select(
        "query_id",
        F.col("error_code").isNull().alias("success"),
        "error_code",
        F.coalesce("n", F.lit(0)).alias("result_count"),
    )
    summary = per_query.agg(
        F.count("*").alias("total"),
        F.count_if("success").alias("succeeded"),
        F.count_if(~F.col("success")).alias("failed"),
    ).withColumn("complete", F.col("succeeded") + F.col("failed") == F.col("total"))
    return hits, per_query, summary
