"""Search, fusion, merging, scope and validation on literal rows."""

import math
import random

import pytest

from rankloom.operators import batch, federated, fusion, scope, search_text, search_vector, validation
from rankloom.operators.cascade import CascadeConfig, Leg, cascade


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, rank int, id string, score double")


def test_vector_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search_vector, "BLOCK_ROWS", 7)
    monkeypatch.setattr(search_vector, "PART_ROWS", 11)
    rng = random.Random(3)
    vecs = [(i, rng.randrange(2), [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)]
    vecs += [(60, 0, [1.0, 0.0]), (61, 1, [])]
    df = spark.createDataFrame(vecs, "id bigint, g bigint, embedding array<double>")
    q = df.withColumnRenamed("id", "query_id")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 6) if n else 0.0

    for within in ((), ("g",)):
        got = {}
        for r in search_vector.vector_search(q, df, top_k=3, within=within, skip_same=True).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
        for i, g, v in vecs:
            want = [
                (-cos(v, w), j) for j, h, w in vecs if i != j and len(v) == len(w) > 0 and (not within or g == h)
            ]
            want = [(k + 1, j, -s) for k, (s, j) in enumerate(sorted(want)[:3])]
            assert sorted(got.get(i, [])) == want, (i, within)


def test_text_search_prefers_the_best_field(spark):
    docs = spark.createDataFrame(
        [("a", "red fox runs", "x"), ("b", "blue fish", "red"), ("c", "green bird", "y")], "id string, content string, title string"
    )
    q = spark.createDataFrame([(1, "Red!"), (2, "none")], "query_id bigint, query string")
    got = [(r.query_id, r.rank, r.id) for r in search_text.text_search(q, docs).collect()]
    assert sorted(got) == [(1, 1, "b"), (1, 2, "a")]


def test_rrf_merges_equal_contents(spark):
    rows = [(1, "l", 1, "a", 0.2, "K"), (1, "l", 2, "b", 0.9, "L"), (1, "m", 1, "c", 0.8, "K")]
    df = spark.createDataFrame(rows, "query_id bigint, upstream_id string, rank int, id string, score double, content_key string")
    got = [(r.rank, r.id, r.score, r.rrf_score) for r in fusion.fuse_rrf(df).orderBy("rank").collect()]
    assert got == [(1, "c", 0.8, round(2 / 61, 6)), (2, "b", 0.9, round(1 / 62, 6))]


def test_merge_modes(spark):
    local = hits(spark, [(1, 1, "a", 0.5), (1, 2, "a", 0.4), (1, 3, "b", 0.3)])
    remote = hits(spark, [(1, 1, "b", 0.9), (1, 2, "c", 0.2), (1, 3, "c", 0.1), (2, 1, "z", 0.7)])

    def ids(mode):
        merged, stats = federated.federated_merge(local, remote, mode)
        lists = [r.id for r in merged.filter("query_id = 1").orderBy("rank").collect()]
        only_remote = [r.id for r in merged.filter("query_id = 2").collect()]
        return lists, only_remote, stats.filter("query_id = 1").first()["duplicates_removed"]

    assert ids("local_only_fallback") == (["a", "a", "b"], ["z"], 0)
    assert ids("local_priority") == (["a", "a", "b", "c"], ["z"], 2)
    assert ids("remote_priority") == (["b", "c", "c", "a"], ["z"], 2)
    assert ids("interleave") == (["b", "a", "c"], ["z"], 3)


def test_cascade_keeps_the_first_of_equal_best_and_stops_early(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id bigint")
    asked = []

    def leg(name, priority, rows):
        def search(pending):
            asked.append((name, sorted(r.query_id for r in pending.collect())))
            return hits(spark, rows).join(pending.select("query_id"), "query_id", "left_semi")

        return Leg(name, "vector", priority, search)

    legs = [
        leg("one", 1, [(1, 1, "a", 0.9), (2, 1, "b", 0.4)]),
        leg("two", 2, [(2, 1, "c", 0.4), (3, 1, "d", 0.3)]),
    ]
    found, outcome, _ = cascade(q, legs)
    rows = {r.query_id: (r.stop_reason, r.final_leg, r.tried, r.depth) for r in outcome.collect()}
    assert asked == [("one", [1, 2, 3]), ("two", [2, 3])]
    assert rows == {
        1: ("threshold_met", "one", "one", 1),
        2: ("all_exhausted", "one", "one,two", 2),
        3: ("all_exhausted", "two", "one,two", 2),
    }
    assert sorted(r.id for r in found.collect()) == ["a", "b", "d"]
    limited = cascade(q, legs, CascadeConfig(max_depth=1))[1]
    assert {r.query_id: r.stop_reason for r in limited.collect()}[3] == "max_depth_reached"


def test_scope_rules(spark):
    rows = [(1, "c", 1, "a", 0.9, "alpha beta"), (1, "c", 2, "b", 0.8, "beta"), (1, "c", 3, "d", 0.7, "none here"), (2, "other", 1, "e", 0.5, "x")]
    df = spark.createDataFrame(rows, "query_id bigint, context_id string, rank int, id string, score double, content string")
    phrases = spark.createDataFrame(
        [("c", 1, "alpha beta", 2.0, None), ("c", 2, "beta", -1.0, 0.99)],
        "context_id string, phrase_id int, text string, weight double, min_similarity double",
    )
    s = {r.id: (r.best_sim, r.best_weighted, r.any_phrase) for r in scope.scope_signals(df, phrases).collect()}
    assert s == {"a": (1.0, 2.0, True), "b": (1.0, 1.0, True), "d": (0.0, 0.0, False), "e": (1.0, 1.0, True)}

    def order(mode):
        out = scope.scope(df, phrases, mode).filter("query_id = 1").orderBy("rank")
        return [(r.id, r.score) for r in out.collect()]

    assert order("filter") == [("a", 0.9), ("b", 0.8)]
    assert order("rerank") == [("a", 0.93), ("b", 0.71), ("d", 0.49)]
    assert order("boost") == [("a", 1.17), ("b", 0.92), ("d", 0.7)]


@pytest.mark.parametrize(
    "query,k,code",
    [
        ("", None, "empty_query"), ("  \t", None, "empty_query"), ("é" * 5001, None, "query_too_long"), ("a\x00b", None, "null_byte"),
        ("a\x0bb", None, "control_char"), ("a\tb\nc\r", 1000, None), ("a", 1001, "top_k_too_large"), ("a", None, None),
    ],
)
def test_request_rules(spark, query, k, code):
    df = spark.createDataFrame([(1, query, k)], "query_id bigint, query string, top_k int")
    row = validation.validate_queries(df).first()
    assert row["error_code"] == code
    assert row["effective_top_k"] == (10 if k is None else min(k, 1000))


def test_response_rules(spark):
    rows = [
        (1, 1, "a", 1.0, "ok", None), (1, 2, "", 1.0, "x", None), (2, 1, "b", float("inf"), "x", None), (3, 1, "c", 1.0, "x" * 100_001, None),
        (4, 1, "d", 1.0, "a\x00", None), (5, 1, "e", 1.0, "a\x85", None), (6, 1, "f", 1.0, "a\tb\n", None),
    ]
    rows += [(7, i, str(i), 1.0, "", None) for i in range(1001)] + [(8, i, str(i), 1.0, "y" * 100_000, None) for i in range(105)]
    df = spark.createDataFrame(rows, "query_id bigint, rank int, id string, score double, content string, metadata string")
    got = {r.query_id: (r.error_code, r.bad_result_id) for r in validation.validate_responses(df).collect()}
    assert got == {
        1: ("empty_result_id", ""), 2: ("invalid_score", "b"), 3: ("content_too_long", "c"), 4: ("content_null_byte", "d"),
        5: ("content_control_char", "e"), 6: (None, None), 7: ("too_many_results", None), 8: ("response_too_large", None),
    }


def test_batch_refuses_duplicates(spark):
    q = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("b", "", 1), ("c", "z", 1)], "query_id string, query string, top_k int")

    def search(valid):
        return valid.selectExpr("query_id", "1 AS rank", "'d' AS id", "1.0D AS score")

    _, status, summary = batch.batch_search(q, search)
    assert {r.query_id: r.error_code for r in status.collect()} == {"a": "duplicate_id", "b": "empty_query", "c": None}
    assert tuple(summary.first()) == (3, 1, 2, True)
    with pytest.raises(ValueError):
        batch.batch_search(q, search, max_queries=3)
