"""Change events applied to a table, micro-batch by micro-batch, without rewriting it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.cdc import effective_events, reduce_cdc, stored_entries
from rankloom.session import numbered_folders, remove_folder, work_dir

CHANGES = "query_key string, event_type string, event_id bigint, timestamp_ms bigint, payload string, upstream_id string, context_id string"
#: Batches after which the changes are merged into one base table.
COMPACT_EVERY = 32


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """The newest base and the changes of all batches after it."""
    rows, first = spark.createDataFrame([], CHANGES), -1
    bases = numbered_folders(spark, f"{path}/base", "upto")
    if bases:
        first = bases[-1]
        rows = rows.unionByName(spark.read.schema(CHANGES).parquet(f"{path}/base/upto={first}"))
    later = [f"{path}/changes/batch={n}" for n in numbered_folders(spark, f"{path}/changes", "batch") if n > first]
    return rows.unionByName(spark.read.schema(CHANGES).parquet(*later)) if later else rows


def stored_table(spark: SparkSession, path: str) -> DataFrame:
    """What the batches so far have left behind."""
    return stored_entries(reduce_cdc(_changes(spark, path)))


def _compact(spark: SparkSession, path: str, n: int) -> None:
    """Merge all changes up to batch ``n``; what the base before the last one covers goes, so that a reader of the last one is not disturbed."""
    bases = numbered_folders(spark, f"{path}/base", "upto")
    reduce_cdc(_changes(spark, path)).write.mode("overwrite").parquet(f"{path}/base/upto={n}")
    if bases:
        for old in numbered_folders(spark, f"{path}/changes", "batch"):
            if old <= bases[-1]:
                remove_folder(spark, f"{path}/changes/batch={old}")
        for old in bases[:-1]:
            remove_folder(spark, f"{path}/base/upto={old}")


def apply_cdc(stream: DataFrame, node_id: str, now_ms: int, state_path: str | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """Fold a change stream into a table and return it.

    Batch n writes the keys that it touches, the last write and the last remove of each, and a clear-all as one mark that every
    key is held against when the table is read. Nothing stored is read or written again but by a merge every ``compact_every``
    batches. A batch that runs twice leaves the same files, and a restart without new files returns the newest table. Events
    must arrive in order of ``event_id`` from batch to batch, in any order within one.
    """
    spark = stream.sparkSession
    path = state_path or work_dir(spark, "cdc-state")

    def write(batch: DataFrame, n: int) -> None:
        reduce_cdc(effective_events(batch, node_id, now_ms)).write.mode("overwrite").parquet(f"{path}/changes/batch={n}")
        if (n + 1) % compact_every == 0:
            _compact(batch.sparkSession, path, n)

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stored_table(spark, path)
