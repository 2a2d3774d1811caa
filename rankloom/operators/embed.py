"""Text embeddings, computed once per distinct text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import tokens
from rankloom.session import cut, discard, numbered_folders

DIM = 128


def hash_bow(dim: int = DIM, normalized: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Bag-of-words embedder: every token counts on the axis that its hash names.

    Maps (text_key, text) to (text_key, embedding). All in built-in expressions: tokens are
    counted per axis inside the partition of their text.
    """

    def embed(texts: DataFrame) -> DataFrame:
        axis = F.pmod(F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
        counts = (
            texts.select("text_key", F.explode(tokens("text")).alias("token"))
            .groupBy("text_key", axis.alias("axis"))
            .agg(F.count("*").cast("double").alias("n"))
            .groupBy("text_key")
            .agg(
                F.map_from_entries(F.collect_list(F.struct("axis", "n"))).alias("axes"),
                (F.sqrt(F.sum(F.col("n") * F.col("n"))) if normalized else F.lit(1.0)).alias("norm"),
            )
        )
        dense = F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: F.coalesce(F.try_element_at("axes", i) / F.col("norm"), F.lit(0.0)),
        )
        return counts.select("text_key", dense.alias("embedding"))

    return embed


def embed_texts(
    df: DataFrame,
    text_col: str,
    known: DataFrame | None = None,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    dim: int = DIM,
) -> DataFrame:
    """Add ``embedding`` to every row; each distinct text that ``known`` lacks is embedded once.

    ``known`` has (text_key, embedding), the key being the SHA-256 of the text. Texts travel
    through one shuffle, in which copies are merged before they are sent.
    """
    embedder = embedder or hash_bow(dim)
    keyed = df.withColumn("text_key", F.sha2(text_col, 256))
    texts = keyed.groupBy("text_key").agg(F.first(text_col).alias("text"))
    if known is not None:
        texts = texts.join(known, "text_key", "left_anti")
    vectors = embedder(texts)
    if known is not None:
        vectors = vectors.unionByName(known.select("text_key", "embedding"))
    zero = F.array_repeat(F.lit(0.0), dim)
    return (
        keyed.join(vectors, "text_key", "left")
        .withColumn("embedding", F.coalesce("embedding", zero))
        .drop("text_key")
    )


class VectorStore:
    """Vectors of texts (text_key, embedding) kept between runs in a folder: a run appends what it had to compute, and reads the rest."""

    def __init__(self, spark: SparkSession, path: str, dim: int = DIM):
        self.spark, self.path, self.dim = spark, path, dim

    def known(self) -> DataFrame:
        """All vectors of finished runs."""
        runs = [f"{self.path}/run={n}" for n in numbered_folders(self.spark, self.path, "run")]
        reader = self.spark.read.schema("text_key string, embedding array<double>")
        return reader.parquet(*runs) if runs else self.spark.createDataFrame([], "text_key string, embedding array<double>")

    def embed(self, df: DataFrame, text_col: str, embedder: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, int]:
        """``df`` with ``embedding``, and how many texts had to be computed.

        Keys alone are held against the stored ones, so that no stored vector and no known text travels before it is
        needed; the new vectors are written as one run before anything reads them. A run that finds nothing new writes nothing.
        """
        texts = df.select(F.sha2(text_col, 256).alias("text_key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        missing = texts.join(self.known().select("text_key"), "text_key", "left_anti").dropDuplicates(["text_key"])
        made = cut((embedder or hash_bow(self.dim))(missing).select("text_key", F.col("embedding").cast("array<double>").alias("embedding")))
        n = made.count()
        if n:
            number = 1 + max(numbered_folders(self.spark, self.path, "run"), default=-1)
            made.write.mode("overwrite").parquet(f"{self.path}/run={number}")
        discard(made)
        return embed_texts(df, text_col, known=self.known(), embedder=_none(self.dim), dim=self.dim), n


def _none(dim: int) -> Callable[[DataFrame], DataFrame]:
    """An embedder for texts that are all known: those that are not (texts without tokens) keep the zero vector."""
    return lambda texts: texts.select("text_key", F.array_repeat(F.lit(0.0), dim).alias("embedding"))
