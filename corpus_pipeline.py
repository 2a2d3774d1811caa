"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``. n_chars is kept in step where a stage changes texts. Only these
columns are read, so others may have any name; an empty table gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import neardup, packing, pii, quality, rules
from rankloom.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and every rule. Null and empty texts have no words and go; repeated rows are judged alike."""
    return rules.apply_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being good, given their text and their site, reaches the threshold.

    Null sources and langs are groups of their own, empty texts are judged by their site; without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels, keep=COLUMNS).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class of copies and near copies; null, empty and blank texts are one class."""
    return neardup.one_of_each(docs.select(*COLUMNS))


def sanitise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it generalised; a null text stays null, repeated rows stay."""
    clean = pii.sanitise(docs.select(*COLUMNS)).withColumn("text", F.col("_clean"))
    return clean.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids in the sources' proportions, with their ids; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("near_dedup", drop_near_copies),
    ("pii", sanitise_texts),
    ("packing", pack_sequences),
]

#: The classifier, the near copies and the tokens are beyond SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
