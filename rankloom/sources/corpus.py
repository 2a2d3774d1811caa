"""Corpora and query texts from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import trim_space

CORPUS_SCHEMA = (
    "id string, title string, content string, category string, tags array<string>, topic string, overlap boolean, "
    "_corrupt_record string"
)


def read_corpus(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Documents from JSON lines or Parquet, with a fixed schema; unreadable lines fill ``_corrupt_record``."""
    if fmt == "json":
        return spark.read.schema(CORPUS_SCHEMA).option("mode", "PERMISSIVE").json(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown corpus format {fmt}")


def read_query_texts(spark: SparkSession, path: str) -> DataFrame:
    """One query per line, or the second field of a line with tabs; trimmed, empty ones dropped."""
    line = F.col("value")
    text = trim_space(F.when(line.contains("\t"), F.get(F.split(line, "\t"), 1)).otherwise(line))
    return spark.read.text(path).select(text.alias("query")).filter(F.col("query") != "")
