"""Access traces from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trace, rejected): key and cluster per line, and the lines without a query.

    Blank lines are skipped; a line without cluster is its own cluster, named by the hash of its query.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    fields = F.from_json("value", "query string, cluster_id bigint")
    rows = lines.select("value", fields["query"].alias("key"), fields["cluster_id"].alias("cluster"))
    own = F.conv(F.substring(F.sha2("key", 256), 1, 15), 16, 10).cast("bigint")
    good = rows.filter(F.col("key").isNotNull()).select("key", F.coalesce("cluster", own).alias("cluster_id"))
    return good, rows.filter(F.col("key").isNull()).select(F.col("value").alias("line"))
