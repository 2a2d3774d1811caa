"""The text index against plain scoring: any blocks, skipped blocks, a number of results of each query's own."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.operators import text_index
from rankloom.operators.fusion import fuse_rrf
from rankloom.operators.search_text import corpus_statistics, text_search
from rankloom.operators.search_vector import vector_search
from rankloom.operators.text_index import build_text_index


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 60)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(30))), " ".join(word() for _ in range(rng.randrange(4)))) for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "", "w7 w7"), (n + 2, rows[0][1], rows[0][2])]


def plain(docs, queries):
    """(query_id, rank, id, score) by scoring every document."""
    split = lambda t: [x for x in re.split(r"[^\w]+|_", (t or "").lower()) if x]
    out = []
    fields = [{i: Counter(split(row[f])) for i, *row in docs} for f in (0, 1)]
    for qid, text, k in queries:
        scores = {}
        for held in fields:
            full = {i: c for i, c in held.items() if c}
            n, avg = len(full), sum(sum(c.values()) for c in full.values()) / max(len(full), 1)
            for i, c in full.items():
                s, hit = 0.0, False
                for token, qtf in Counter(split(text)).items():
                    if c[token]:
                        df = sum(token in x for x in full.values())
                        hit = True
                        s += qtf * math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * c[token] / (c[token] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
                if hit:
                    scores[i] = max(scores.get(i, 0.0), s)
        best = sorted((-round(s, 6), i) for i, s in scores.items())[: 10 if k is None else k]
        out += [(qid, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


QUERIES = [(1, "w1 w2 w9", 1), (2, "w3 W40 w40", 5), (3, "w60", 20), (4, "w5 w6 w7 w8", None), (5, None, 5), (6, "", 5), (7, "unknown", 5), (8, "w1", 400)]


@pytest.mark.parametrize("settings", [{}, {"BLOCK_DOCS": 16}, {"BLOCK_DOCS": 16, "FEW_BLOCKS": 0}, {"BLOCK_DOCS": 7, "FEW_BLOCKS": 0, "PART_TOKENS": 3}, {"SLICE_BYTES": 100, "BLOCK_BYTES": 2000, "FEW_BLOCKS": 2}])
def test_any_blocks_give_the_same_hits(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(text_index, name, value)
    docs = spark.createDataFrame(corpus(), "id bigint, content string, title string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id bigint, query string, top_k int")
    got = text_search(queries, docs, top_k="top_k").collect()
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in got) == plain(corpus(), QUERIES)


def test_blocks_that_cannot_win_are_left_unread(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 20)
    monkeypatch.setattr(text_index, "FEW_BLOCKS", 0)
    rows = [(i, "needle needle needle" if i < 20 else f"needle {'hay ' * 40}{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "id bigint, content string").coalesce(1).sortWithinPartitions("id")
    index = build_text_index(docs, ("content",))
    assert index.blocks == 20
    queries = spark.createDataFrame([(1, "needle", 3)], "query_id bigint, query string, top_k int")
    tokens = text_index.query_tokens(queries, F.col("top_k"))
    found = text_index.search_index(tokens, index)
    blocks = {r.id // 20 for r in found.collect()}
    assert blocks == {0}  # every block but the first has a bound below the third score there


def test_stored_statistics_take_the_place_of_the_corpus(spark):
    whole = spark.createDataFrame(corpus(), "id bigint, content string, title string")
    stats = corpus_statistics(whole, ("content", "title"))
    part = whole.where("id < 40")
    queries = spark.createDataFrame([(1, "w1 w2 w9", 5)], "query_id bigint, query string, top_k int")
    scores = {r.id: r.score for r in text_search(queries, whole, top_k=400).collect()}
    got = text_search(queries, part, top_k=400, stats=stats).collect()
    assert got and all(r.id < 40 and abs(scores[r.id] - r.score) < 2e-6 for r in got)


def test_string_ids_and_empty_corpora(spark):
    docs = spark.createDataFrame([("b", "same words"), ("a", "same words"), ("c", "other")], "id string, content string")
    queries = spark.createDataFrame([("q", "same words")], "query_id string, query string")
    assert [(r["rank"], r.id) for r in text_search(queries, docs, ("content",), 2).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    assert text_search(queries, docs.where("false"), ("content",), 2).count() == 0


def test_own_numbers_in_vector_search_and_fusion(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "id bigint, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 20), (3, [1.0, 0.0], None), (4, [1.0, 0.0], 0)], "query_id bigint, embedding array<double>, top_k int")
    hits = vector_search(queries, vectors, top_k="top_k")
    assert {r.query_id: r["count"] for r in hits.groupBy("query_id").count().collect()} == {1: 1, 2: 20, 3: 10, 4: 1}
    lists = hits.withColumn("upstream_id", F.lit("v")).withColumn("content_key", F.col("id")).join(queries.select("query_id", "top_k"), "query_id")
    fused = fuse_rrf(lists, max_results="top_k")
    assert {r.query_id: r["count"] for r in fused.groupBy("query_id").count().collect()} == {1: 1, 2: 20, 3: 10, 4: 1}


def test_a_search_sends_no_list_and_no_query_once_for_each_block(spark, monkeypatch):
    """The shuffled rows of a search are those of the queries' tokens, however many blocks and parts of the queries meet."""
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common") for i in range(200)], "id bigint, content string").coalesce(1)
    queries = spark.createDataFrame([(i, f"common w{i % 5}", 2) for i in range(60)], "query_id bigint, query string, top_k int")
    monkeypatch.setattr(text_index, "BLOCK_DOCS", 10)
    monkeypatch.setattr(text_index, "PART_TOKENS", 30)
    index = build_text_index(docs, ("content",))
    assert index.blocks == 20 and index.lists.count() == 20
    plans, write = [], text_index.meet_packed

    def watched(stream, held, *rest):
        assert held.count() == 4 and "Exchange" not in stream.crossJoin(held).hint("shuffle_replicate_nl")._jdf.queryExecution().sparkPlan().toString()
        plans.append((stream, held))
        return write(stream, held, *rest)

    monkeypatch.setattr(text_index, "meet_packed", watched)
    found = text_search(queries, index, ("content",), top_k="top_k")
    assert len(plans) == 1 and found.count() == 120
    assert {r.id for r in found.where("query_id = 3").collect()} == {3, 8}  # both words, smaller ids first


def test_a_private_index_is_deleted_after_its_search(spark, monkeypatch):
    made = []
    cut_packed = text_index.cut_packed
    monkeypatch.setattr(text_index, "cut_packed", lambda df: made.append(cut_packed(df)) or made[-1])
    docs = spark.createDataFrame([(i, f"w{i}") for i in range(9)], "id bigint, content string")
    queries = spark.createDataFrame([(1, "w3")], "query_id bigint, query string")
    found = text_search(queries, docs, ("content",), 2)
    assert len(made) == 2 and all(df.cut_path is None for df in made)
    assert [r.id for r in found.collect()] == [3]
