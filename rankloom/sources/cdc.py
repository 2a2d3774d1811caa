"""Change events from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CDC_SCHEMA = (
    "event_id bigint, sequence bigint, timestamp_ms bigint, event_type string, query_key string, payload string, "
    "upstream_id string, context_id string, origin_node_id string, absolute_expiry_ms bigint"
)


def read_cdc(spark: SparkSession, path: str, event_types: list[str] | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream of change events from JSON files; no types means all types."""
    reader = spark.readStream.schema(CDC_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    events = reader.json(path)
    return events.filter(F.col("event_type").isin(event_types)) if event_types else events
