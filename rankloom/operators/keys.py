"""Repeat accesses by raw and by normalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import exact_key, query_key
from rankloom.session import cut


def _first_access(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    # texts are normalised and hashed once; only their keys are written and joined
    keyed = cut(log.select("seq", "context_id", exact_key("query").alias("exact_key"), query_key("query", "context_id").alias("norm_key")))
    exact = keyed.groupBy("norm_key", "context_id", "exact_key").agg(
        F.min("seq").alias("first_exact"), F.count("*").alias("accesses")
    )
    return keyed, exact


def key_collapse(log: DataFrame) -> DataFrame:
    """Label every access exact, normalized or miss by what was seen before it in its context.

    First accesses come from an aggregation that combines before the shuffle; the join back
    has one row per key on its small side, which adaptive execution splits under skew.
    """
    keyed, exact = _first_access(log)
    first = exact.join(exact.groupBy("norm_key").agg(F.min("first_exact").alias("first_norm")), "norm_key")
    kind = (
        F.when(F.col("seq") > F.col("first_exact"), "exact")
        .when(F.col("seq") > F.col("first_norm"), "normalized")
        .otherwise("miss")
    )
    return keyed.join(first.select("norm_key", "exact_key", "first_exact", "first_norm"), ["norm_key", "exact_key"]).select(
        "seq", "context_id", "norm_key", kind.alias("hit_kind")
    )


def collapse_counts(log: DataFrame) -> DataFrame:
    """Per normalised key: accesses and the number of distinct raw texts behind it."""
    _, exact = _first_access(log)
    return exact.groupBy("norm_key").agg(
        F.count("*").alias("exact_keys"), F.sum("accesses").alias("accesses")
    )
