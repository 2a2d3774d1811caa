"""Session helpers: local test sessions, durable work folders, lineage cuts and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Rows and bytes (as JSON) up to which a dimension (queries, phrases, grids) may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rankloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    It lies under the shared folder that the cluster names in ``spark.checkpoint.dir``;
    only a local-mode session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: While a table is written: what its shuffles left on disk goes when it is complete, for no other plan reads that.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: While packed tables meet: a file is a partition, and a row a batch, for a row holds megabytes.
PACKED = {"spark.sql.files.openCostInBytes": str(1 << 40), "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for as long as a table is written."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that it is computed once."""
    path = work_dir(df.sparkSession, "cut")
    with settings(df.sparkSession, CLEANED):
        df.write.options(**options).parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.cut_path = path
    return read


def cut_packed(df: DataFrame) -> DataFrame:
    """``cut`` for rows of megabytes: each is a file, so that a reader holds one."""
    return cut(df, maxRecordsPerFile=1, compression="zstd")


def meet_packed(stream: DataFrame, held: DataFrame, on: Column, parts: int, function: Callable, shape: StructType) -> DataFrame:
    """Written: what ``function`` makes of all pairs of rows of two packed tables that ``on`` allows.

    No row is shuffled or broadcast. A task holds one row of ``held`` and reads one of ``parts`` parts of ``stream`` past it; the function
    gets the pairs as Arrow batches of one row.
    """
    spark = stream.sparkSession
    with settings(spark, PACKED):
        return cut(stream.coalesce(parts).hint("shuffle_replicate_nl").join(held, on).mapInArrow(function, shape))


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the finished tables ``path/name=n``, ascending."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = parent.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(parent):
        return []
    found = [x.getPath() for x in files.listStatus(parent)]
    done = [x.getName() for x in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.removeprefix(f"{name}=")) for x in done if x.startswith(f"{name}="))


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``cut`` wrote behind these tables. Only for tables that nothing will read again: their successors are written."""
    for df in tables:
        path = getattr(df, "cut_path", None)
        if path is not None:
            remove_folder(df.sparkSession, path)
            df.cut_path = None


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` when a count shows that it has at most ``limit`` rows and ``most`` bytes.

    A larger side is returned without a hint: Spark then shuffles both sides and adaptive
    execution splits the skewed partitions.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, held = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and held <= most else df


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are evaluated once per row.

    A projection would be merged into every later use of the column; a one-element explode is not.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", made).select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])
