"""Evaluation of rankings and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import round6
from rankloom.functions.text import words
from rankloom.operators.percentiles import percentiles
from rankloom.operators.phrases import key_phrases, key_terms
from rankloom.operators.ordered import top_rows
from rankloom.session import once

# Weights of the parts of a document that an answer may mention.
TITLE, TITLE_PART, PHRASE, TAG, TERM = 3.0, 0.67, 2.0, 1.0, 0.5
TITLE_SHARE, MATCHED = 0.6, 0.3
MAX_PHRASES, MAX_TERMS = 5, 10


def movements(base: DataFrame, tuned: DataFrame, k: int) -> DataFrame:
    """How every id of two top-k lists (query_id, rank, id, score) moved."""
    sides = [
        df.filter(F.col("rank") <= k).select("query_id", "id", F.col("rank").alias(f"{n}_rank"), F.col("score").alias(f"{n}_score"))
        for df, n in ((base, "baseline"), (tuned, "tuned"))
    ]
    both = sides[0].join(sides[1], ["query_id", "id"], "full_outer")
    b, t = F.col("baseline_rank"), F.col("tuned_rank")
    zero = F.lit(0.0)
    status = (
        F.when(b.isNull(), "new").when(t.isNull(), "evicted").when(t < b, "up").when(t > b, "down").otherwise("stable")
    )
    return both.select(
        "query_id", "id", status.alias("status"), b, t,
        F.coalesce("baseline_score", zero).alias("baseline_score"),
        F.coalesce("tuned_score", zero).alias("tuned_score"),
        round6(F.coalesce("tuned_score", zero) - F.coalesce("baseline_score", zero)).alias("score_delta"),
    )


def verdicts(moves: DataFrame) -> DataFrame:
    """Per query: degraded when anything was evicted, else improved, changed or unchanged."""
    counts = moves.groupBy("query_id").agg(
        F.count_if(F.col("status") == "evicted").alias("evicted"),
        F.count_if(F.col("status") == "new").alias("new"),
        F.count_if(~F.col("status").isin("new", "evicted")).alias("overlap"),
    )
    label = (
        F.when(F.col("evicted") > 0, "degraded")
        .when((F.col("new") > 0) & (F.col("overlap") > 0), "improved")
        .when(F.col("new") > 0, "changed")
        .otherwise("unchanged")
    )
    return counts.withColumn("verdict", label)


def score_answers(answers: DataFrame, expected: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How well answers (query_id, answer) mention their expected documents (query_id, id).

    Returns the confidence per document and the recall per query. Key terms come from the whole corpus, everything
    else only from expected documents.
    """
    wanted = expected.select("id").distinct()
    chosen = key_phrases(docs.join(wanted, "id", "left_semi"))
    terms = (
        key_terms(docs).join(wanted, "id", "left_semi").groupBy("id").agg(F.slice(F.array_sort(F.collect_list("term")), 1, MAX_TERMS).alias("terms"))
    )
    parts = chosen.join(terms, "id", "left").select(
        "id",
        F.lower("title").alias("title"),
        F.transform(F.slice("phrases", 1, MAX_PHRASES), F.lower).alias("phrases"),
        F.transform("tags", F.lower).alias("tags"),
        F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
    )
    rows = expected.join(answers.select("query_id", F.lower("answer").alias("answer")), "query_id").join(parts, "id", "left")
    text = F.col("answer")

    def found(items: Column, as_spaced: bool = False) -> Column:
        def inside(x: Column) -> Column:
            hit = text.contains(x)
            return hit | text.contains(F.replace(x, F.lit("-"), F.lit(" "))) if as_spaced else hit

        return F.size(F.filter(items, inside))

    long_words = F.filter(words("title"), lambda w: F.octet_length(w) > 3)
    rows = once(rows, long_words=long_words)
    share = found(F.col("long_words")) / F.size("long_words")
    title = (
        F.when(text.contains(F.col("title")), TITLE)
        .when((F.size("long_words") > 0) & (share >= TITLE_SHARE), TITLE * TITLE_PART)
        .otherwise(0.0)
    )
    got = title + PHRASE * found(F.col("phrases")) + TAG * found(F.col("tags"), True) + TERM * found(F.col("terms"))
    total = TITLE + PHRASE * F.size("phrases") + TAG * F.size("tags") + TERM * F.size("terms")
    confidence = round6(F.coalesce(got / total, F.lit(0.0)))
    per_doc = once(rows, confidence=confidence).select(
        "query_id", "id", "confidence", (F.col("confidence") >= MATCHED).alias("matched")
    )
    counts = per_doc.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("matched").alias("m"))
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    per_query = answers.select("query_id").join(counts, "query_id", "left").select(
        "query_id", n.alias("expected_count"), m.alias("matched_count"),
        round6(F.when(n > 0, m / n).otherwise(1.0)).alias("recall"),
    )
    return per_doc, per_query


def eval_report(results: DataFrame) -> DataFrame:
    """Per vertical of (vertical, strategy, success, recall, confidence, time_ms): means over successes, and times."""
    ok = F.col("success")
    base = results.groupBy("vertical").agg(
        F.count("*").alias("queries"),
        F.count_if(ok).alias("succeeded"),
        round6(F.coalesce(F.avg(F.when(ok, F.col("recall"))), F.lit(0.0))).alias("mean_recall"),
        round6(F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0))).alias("mean_confidence"),
        round6(F.avg("time_ms")).alias("mean_ms"),
        F.min("time_ms").alias("min_ms"),
    )
    times = percentiles(results, ["vertical"], "time_ms", [0.95, 0.97, 0.99], "linear")
    wide = times.groupBy("vertical").agg(
        *[F.max(F.when(F.col("p") == p, F.col("time_ms"))).alias(f"p{round(p * 100)}_ms") for p in (0.95, 0.97, 0.99)]
    )
    return base.join(wide, "vertical")


def strategy_matrix(results: DataFrame, verticals: list[str]) -> DataFrame:
    """Strategies by verticals: mean recall, number of queries and whether the recall reaches one half."""
    mean = round6(F.avg("recall"))
    return results.groupBy("strategy").pivot("vertical", verticals).agg(
        mean.alias("recall"), F.count(F.lit(1)).alias("queries"), (mean >= 0.5).alias("pass")
    )


def best_verticals(results: DataFrame) -> DataFrame:
    """Vertical with the highest mean recall per strategy."""
    means = results.groupBy("strategy", "vertical").agg(round6(F.avg("recall")).alias("recall"))
    return means.groupBy("strategy").agg(
        F.min_by("vertical", F.struct(-F.col("recall"), F.col("vertical"))).alias("best_vertical"), F.max("recall").alias("recall")
    )


def expected_topic_check(hits: DataFrame, docs: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query (query_id, expected_topic, min_results): hits on the topic, and whether they suffice."""
    topics = hits.join(docs.select("id", "topic"), "id").join(expected, "query_id")
    on_topic = topics.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), F.count_if(F.col("topic") == F.col("expected_topic")).alias("on_topic")
    )
    return expected.join(on_topic, "query_id", "left").select(
        "query_id",
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        F.coalesce("on_topic", F.lit(0)).alias("on_topic"),
        (F.coalesce("on_topic", F.lit(0)) >= F.col("min_results")).alias("passed"),
    )


def partition_queries(queries: DataFrame, verticals: DataFrame) -> DataFrame:
    """One query (strategy, position, query_id) of each strategy per vertical (vertical, index from 1), by position.

    Raises when a strategy has fewer queries than there are verticals.
    """
    n = verticals.count()
    short = queries.groupBy("strategy").count().filter(F.col("count") < n)
    if not short.isEmpty():
        raise ValueError(f"a strategy has fewer than {n} queries")
    placed = top_rows(queries, ["strategy"], [F.asc("position"), F.asc("query_id")], n, rank="index")
    return placed.join(verticals, "index").select("vertical", "strategy", "query_id")


def backend_sets(docs: DataFrame, matrix: DataFrame, backends: list[str], overlap: int = 10) -> DataFrame:
    """(backend, id): the first documents of each corpus go everywhere, the others where ``matrix`` sends their corpus."""
    shared = top_rows(docs.select("corpus", "id"), ["corpus"], [F.asc("id")], overlap)
    everywhere = shared.select(F.explode(F.array(*[F.lit(b) for b in backends])).alias("backend"), "id")
    others = docs.select("corpus", "id").join(shared.select("id"), "id", "left_anti").join(matrix, "corpus")
    return everywhere.unionByName(others.select("backend", "id"))


def corpus_summary(docs: DataFrame) -> DataFrame:
    """Documents per corpus and its distinct topics, of which there are few."""
    pairs = docs.groupBy("corpus", "topic").agg(F.count("*").alias("n"))
    return pairs.groupBy("corpus").agg(
        F.sum("n").alias("entries"), F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("topics")
    )
