"""Contents that carry an older version marker than the latest known one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import marked_version


def stale_content(hits: DataFrame, latest: DataFrame, key: str) -> DataFrame:
    """Hits whose trailing version marker lies below ``latest.version`` of their key."""
    marked = hits.withColumn("content_version", marked_version("content"))
    return marked.join(latest.select(key, F.col("version").alias("latest_version")), key).filter(
        F.col("content_version") < F.col("latest_version")
    )
