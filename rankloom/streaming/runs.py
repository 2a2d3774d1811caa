"""Run streams over the files that are there, into tables in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.session import work_dir

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Keyed state needs the RocksDB store; the session's own choice comes back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def drain_append(stream: DataFrame, name: str) -> DataFrame:
    """Append the stream's rows to a table until the files are read; exactly once by the file sink's log."""
    spark = stream.sparkSession
    out = work_dir(spark, name)
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_complete(stream: DataFrame, name: str) -> DataFrame:
    """Keep the latest complete result of an aggregating stream as a table."""
    spark = stream.sparkSession
    out = work_dir(spark, name)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        stream.writeStream.foreachBatch(replace).outputMode("complete")
        .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@contextmanager
def kept_progress(spark: SparkSession, most: int = 100_000):
    """Keep the progress of every batch of a run."""
    name = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain_update(stream: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, list[dict]]:
    """Keep the last version of every row of an aggregating stream, by ``keys``; and per batch what its state held and dropped.

    A batch writes the rows that it changed. State goes with the watermark: the second result has a row per batch with ``batch``,
    ``state_rows`` and ``late_rows``, the rows that came after their window was closed and are counted nowhere else.
    """
    spark = stream.sparkSession
    out = work_dir(spark, name)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    with kept_progress(spark):
        query = (
            stream.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        told = query.recentProgress
    by_batch = [
        {"batch": p["batchId"], "state_rows": sum(o["numRowsTotal"] for o in p["stateOperators"]), "late_rows": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])}
        for p in told
    ]
    versions = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    last = versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns), by_batch
