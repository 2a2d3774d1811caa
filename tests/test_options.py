"""Options that no registered query takes."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators.embed import VectorStore, hash_bow
from rankloom.operators.semantic_replay import tau_frontier
from rankloom.operators.validation import split_valid, validate_queries
from rankloom.session import small, work_dir
from rankloom.sources import corpus, entry_store


def test_distill_attaches_vectors_and_counts_its_limit(spark):
    rows = [(f"k{i}", f"q{i}", "ctx", "up", 1700000000 - i * 60, 0, "{}") for i in range(20)]
    df = spark.createDataFrame(rows, "norm_key string, query string, context_id string, upstream_id string, t bigint, extended_count int, response_json string")
    entries = df.withColumn("cached_at", F.timestamp_seconds("t"))
    vectors = spark.createDataFrame([("k19", [1.0, 0.0]), ("k3", [0.0, 1.0])], "norm_key string, embedding array<double>")
    got = entry_store.distill(entries, "2023-11-14 22:13:20", 3600.0, limit=3, embeddings=vectors).collect()
    assert [r.norm_key for r in got] == ["k19", "k18", "k17"]
    assert [r.embedding for r in got] == [[1.0, 0.0], None, None]


def test_corpus_from_parquet(spark):
    path = work_dir(spark, "test-corpus")
    spark.createDataFrame([("1", "text", "a title")], "id string, content string, title string").write.parquet(path)
    assert corpus.read_corpus(spark, path, fmt="parquet").select("id", "content", "title").first() == ("1", "text", "a title")


def test_valid_and_refused_queries_part(spark):
    df = validate_queries(spark.createDataFrame([(1, "a", 1), (2, "", 1), (3, "b", 5000)], "query_id bigint, query string, top_k int"))
    good, bad = split_valid(df)
    assert [r.query_id for r in good.collect()] == [1] and {r.query_id: r.error_code for r in bad.collect()} == {2: "empty_query", 3: "top_k_too_large"}


def test_only_small_sides_are_broadcast(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    df = spark.range(100).withColumn("x", F.array_repeat(F.lit("some words"), 50))
    assert hinted(small(df)) and not hinted(small(df, limit=99)) and not hinted(small(df, most=10_000))
    assert hinted(small(df.where("false")))


def test_second_run_of_a_store_embeds_nothing(spark):
    store, df = VectorStore(spark, work_dir(spark, "test-vectors"), dim=8), spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "...")], "id bigint, text string")
    first, n = store.embed(df, "text")
    assert n == 2 and first.count() == 5
    calls = []

    def counting(texts):
        calls.append(texts.count())
        return hash_bow(8)(texts)

    again, n = store.embed(df, "text", counting)
    assert n == 0 and calls == [1]  # the text without a token has no vector to keep
    key = lambda d: sorted((r.id, r.embedding) for r in d.collect())
    assert key(again) == key(first)
    assert store.embed(df.unionByName(spark.createDataFrame([(6, "d")], "id bigint, text string")), "text")[1] == 1


@pytest.mark.parametrize("indexed", [False, True])
def test_threshold_sweep_with_and_without_an_index(spark, indexed):
    rows = [("c", i, f"t{i % 9}", f"g{i % 3}", [float(i % 9), 1.0, float(i % 2)]) for i in range(40)]
    trace = spark.createDataFrame(rows, "context_id string, seq bigint, text_key string, cluster_id string, embedding array<double>")
    got = [tuple(r) for r in tau_frontier(trace, [0.5, 0.99], indexed).orderBy("tau").collect()]
    assert got[0][1:4] == (40, 31, 8) and got == [tuple(r) for r in tau_frontier(trace, [0.5, 0.99]).orderBy("tau").collect()]
