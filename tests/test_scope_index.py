"""Scope signals by an index of phrase words against the folded form, which compares every phrase with every content."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import scope
from rankloom.operators.scope import ScopeConfig, indexed_signals, scope_signals

PHRASES = "context_id string, phrase_id int, text string, weight double, min_similarity double"
HITS = "query_id bigint, context_id string, rank int, id string, score double, content string"


def made(spark, seed, n_phrases=120, vectors=False):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "a", "it", "hein", "bit", "heinz", "an", "and", "Über", "x,", "cat", "concatenate", "of"]) + rng.choice(["", "", "", "s"])
    text = lambda n: rng.choice(["", " "]) + " ".join(word() for _ in range(n)).replace(" ", rng.choice([" ", " ", "  "]))
    phrases = [
        (rng.choice(["c1", "c1", "c1", "c2"]), i, rng.choice([text(rng.randrange(0, 7)), "at", "t", "it hein", "oncat", ""]), rng.choice([1.0, 2.5, 0.0, -1.0, None, float("nan")]), rng.choice([None, None, 0.1, 0.6, 0.99, 0.0 if seed == 2 else 0.3]))
        for i in range(n_phrases)
    ]
    hits = [(q, rng.choice(["c1", "c1", "c2", "c3"]), r, f"d{r}", 0.5, rng.choice([text(rng.randrange(0, 20)), None, "bit heinz"])) for q in range(12) for r in range(1, 6)]
    h, p = spark.createDataFrame(hits, HITS), spark.createDataFrame(phrases, PHRASES)
    if vectors:
        vector = lambda c: F.when(F.hash(c) % 3 != 0, F.array(*[(F.pmod(F.hash(c, F.lit(i)), F.lit(7)) - 3).cast("double") for i in range(4)]))
        h, p = h.withColumn("embedding", vector("content")), p.withColumn("embedding", vector("text"))
    return h, p


def told(df):
    return sorted((r.query_id, r["rank"], r.best_sim, r.best_weighted, r.any_phrase, r.max_weight is None) for r in df.collect())


@pytest.mark.parametrize("vectors", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_index_equals_all_pairs(spark, monkeypatch, seed, vectors):
    hits, phrases = made(spark, seed, vectors=vectors)
    monkeypatch.setattr(scope, "FEW_PHRASES", 10**6)
    whole = told(scope_signals(hits, phrases))
    monkeypatch.setattr(scope, "FEW_PHRASES", 3)
    assert told(scope_signals(hits, phrases)) == whole
    assert told(indexed_signals(hits, phrases, ScopeConfig(), bucket=5)) == whole


def test_many_phrases_of_one_context_are_not_broadcast(spark):
    phrases = spark.range(100_000).select(
        F.lit("c").alias("context_id"), F.col("id").cast("int").alias("phrase_id"), F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" common")).alias("text"),
        F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("min_similarity"),
    )
    hits = spark.createDataFrame([(1, "c", 1, "a", 0.9, "word77 here"), (1, "c", 2, "b", 0.8, "nothing of it"), (1, "c", 3, "d", 0.7, "word99999 common ground")], HITS)
    got = scope.scope_signals(hits, phrases)
    assert {r.id: (r.best_sim, r.any_phrase) for r in got.collect()} == {"a": (0.5, True), "b": (0.0, False), "d": (1.0, True)}
