"""Lexical search: many queries against a corpus, ranked by BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import by_max_score, round6
from rankloom.functions.text import tokens
from rankloom.operators.ordered import asked_k, top_rows
from rankloom.operators.text_index import TextIndex, build_text_index, query_tokens, search_index
from rankloom.session import cut, discard


def corpus_statistics(docs: DataFrame, fields: tuple[str, ...], vocabulary: DataFrame | None = None) -> DataFrame:
    """(field, token, df, n, avg_length) in one pass; restricted to the tokens of ``vocabulary`` when given.

    Every document adds an empty token that carries its length, so that document frequencies, document count and
    average length come from one aggregation with map-side combine. The table can be stored and handed to ``text_search``.
    """
    spread = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(f).alias("toks")) for f in fields]))
    lists = docs.select(spread.alias("x")).select("x.field", "x.toks", F.size("x.toks").alias("length")).filter(F.col("length") > 0)
    rows = lists.select("field", "length", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("toks"))).alias("token"))
    if vocabulary is not None:
        wanted = vocabulary.withColumn("wanted", F.lit(True))
        rows = rows.join(wanted, "token", "left").filter((F.col("token") == "") | F.col("wanted"))
    counts = cut(rows.groupBy("field", "token").agg(F.count("*").alias("df"), F.sum("length").alias("total")))
    # one row per field
    whole = counts.filter(F.col("token") == "").select("field", F.col("df").alias("n"), (F.col("total") / F.col("df")).alias("avg_length"))
    return counts.filter(F.col("token") != "").join(F.broadcast(whole), "field").select("field", "token", "df", "n", "avg_length")


def text_search(
    queries: DataFrame,
    docs: DataFrame | TextIndex,
    fields: tuple[str, ...] = ("content", "title"),
    top_k: int | str = 10,
    min_score: float | None = None,
    normalized: bool = False,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Top ``top_k`` documents per query as (query_id, rank, id, score); a column's name gives every query its own number.

    ``docs`` is a corpus, or the index of one, which any number of searches may share. A document's score is that of its
    best field. With ``normalized`` the scores of a query are divided by its best one; ``min_score`` applies to what is
    returned. ``stats`` are stored ``corpus_statistics``, for scores as in a larger corpus.
    """
    index = docs if isinstance(docs, TextIndex) else build_text_index(docs, fields)
    asked = query_tokens(queries, asked_k(top_k))
    found = search_index(asked, index, stats)
    # what was found is written; an index made for this search alone serves no other
    discard(asked, *[index.lists] * (index is not docs))
    hits = top_rows(found, ["query_id"], [F.desc("score"), F.asc("id")], top_k if isinstance(top_k, int) else "k")
    if normalized:
        top = F.max("score").over(Window.partitionBy("query_id"))
        hits = hits.withColumn("score", round6(by_max_score(F.col("score"), top)))
    if min_score is not None:
        hits = hits.filter(F.col("score") >= min_score)
    return hits.select("query_id", "rank", "id", "score")
