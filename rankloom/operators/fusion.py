"""Reciprocal rank fusion of the lists that several legs return for a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import round6
from rankloom.operators.ordered import asked_k, top_rows


def fuse_rrf(hits: DataFrame, k: int = 60, max_results: int | str = 10) -> DataFrame:
    """Fuse (query_id, upstream_id, rank, id, score, content_key) into one list per query.

    Hits with equal content are one item; each of its places adds 1 / (k + rank). The item is shown as
    its best-scored instance, whose own score is kept. ``max_results`` may name a column of the hits with each query's own number.
    """
    best_first = F.struct((-F.col("score")).alias("s"), "id", "upstream_id")
    items = hits.groupBy("query_id", "content_key").agg(
        F.sum(1 / (F.lit(k) + F.col("rank"))).alias("rrf"),
        F.min_by(F.struct("id", "score", "upstream_id"), best_first).alias("shown"),
        F.max(asked_k(max_results)).alias("_most"),
    )
    flat = items.select("query_id", "shown.*", round6("rrf").alias("rrf_score"), "_most")
    most = max_results if isinstance(max_results, int) else "_most"
    return top_rows(flat, ["query_id"], [F.desc("rrf_score"), F.asc("id")], most).select(
        "query_id", "rank", "id", "score", "rrf_score", "upstream_id"
    )
