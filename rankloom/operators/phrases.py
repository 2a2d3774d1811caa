"""Phrases and terms that characterise texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import round6
from rankloom.functions.text import NOT_TERM, SPACE, tokens

# Words that are never suggested as scope phrases.
SUGGEST_STOP = (
    "the and for with from that this are was were have has been not but you your all any can will into about over"
).split()
# Words that are never key terms of a document.
TERM_STOP = (
    "the and for are but not you all can had her was one our out has have each make like from this that with they "
    "been will more when than into some very what about which their other also its over such most only then them same "
    "much would where does using based uses used"
).split()


def suggest_phrases(texts: DataFrame, max_phrases: int = 8) -> DataFrame:
    """Best scope phrases of (doc_id, text): frequent tokens, the more so if not in every text.

    ``max_phrases`` is 1 to 32.
    """
    if not 1 <= max_phrases <= 32:
        raise ValueError("max_phrases must be 1 to 32")
    per_doc = (
        texts.select("doc_id", F.explode(tokens("text")).alias("phrase"))
        .filter((F.octet_length("phrase") >= 3) & ~F.col("phrase").isin(SUGGEST_STOP))
        .groupBy("doc_id", "phrase")
        .agg(F.count("*").alias("n"))
    )
    counts = per_doc.groupBy("phrase").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    n_docs = texts.agg(F.greatest(F.count("*"), F.lit(1)).alias("n")).scalar()
    idf = F.greatest(F.lit(0.0), F.log(n_docs / F.col("df"))) + 1
    scored = counts.select("phrase", "tf", "df", round6(F.col("tf") * idf).alias("score"), F.lit(1.0).alias("weight"))
    return scored.orderBy(F.desc("score"), "phrase").limit(max_phrases)


def key_terms(docs: DataFrame, max_df: int = 2) -> DataFrame:
    """(id, term) for the terms of content and title that at most ``max_df`` documents share."""
    terms = (
        docs.select("id", F.explode(F.array_distinct(F.concat(tokens("content", NOT_TERM), tokens("title", NOT_TERM)))).alias("term"))
        .filter((F.octet_length("term") > 3) & ~F.col("term").isin(TERM_STOP))
    )
    if max_df <= 2:
        # The least and the greatest id are all documents of such a term: no join back is needed.
        rare = terms.groupBy("term").agg(F.count("*").alias("df"), F.min("id").alias("a"), F.max("id").alias("b"))
        return rare.filter(F.col("df") <= max_df).select(
            F.explode(F.array_distinct(F.array("a", "b"))).alias("id"), "term"
        )
    rare = terms.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") <= max_df)
    return terms.join(rare, "term", "left_semi").select("id", "term")


def key_phrases(docs: DataFrame) -> DataFrame:
    """Add ``phrases``: sorted distinct pairs of neighbouring words that look like names."""
    edges = r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$"
    named = r"^\p{Lu}|[-_]"
    split = docs.withColumn("_w", F.array_remove(F.split("content", SPACE), ""))
    n = F.size("_w")
    pairs = F.zip_with(
        F.slice("_w", F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice("_w", F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )
    telling = F.filter(
        pairs,
        lambda p: (F.octet_length(p["a"]) > 3)
        & (F.octet_length(p["b"]) > 3)
        & (p["a"].rlike(named) | p["b"].rlike(named)),
    )
    cleaned = F.transform(
        telling, lambda p: F.struct(F.regexp_replace(p["a"], edges, "").alias("a"), F.regexp_replace(p["b"], edges, "").alias("b"))
    )
    joined = F.transform(
        F.filter(cleaned, lambda p: (p["a"] != "") & (p["b"] != "")), lambda p: F.concat_ws(" ", p["a"], p["b"])
    )
    return split.withColumn("phrases", F.array_sort(F.array_distinct(joined))).drop("_w")
