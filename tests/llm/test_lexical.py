"""Ranked lexical search against SQL, against plain scoring, and on edge cases."""

import duckdb
import numpy as np
import pytest

from rankloom.llm import lexical, queries
from tools.check import table

SF = "/root/testdata/sf0.001"


def sql_rows(docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return sorted(con.execute(queries.load()[1]["op12_lexical"]).fetchall())


def found(spark, docs, items):
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    fns, sql = queries.load()
    df = fns["op12_lexical"](spark, SF)
    rel = con.execute(sql["op12_lexical"])
    assert table(df.columns, df.collect()) == table([d[0] for d in rel.description], rel.fetchall())


def corpus(rng, n):
    words = np.array([f"w{i}" for i in range(200)])
    p = 1 / np.arange(1, 201)
    return [(int(i), " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum()))) for i in rng.permutation(n)]


@pytest.mark.parametrize("settings", [{}, {"RUN": 16, "BLOCK_DOCS": 100, "PART_TERMS": 20}, {"RUN": 7, "SHORT": 0.2, "SLICE_BYTES": 500, "BLOCK_BYTES": 4000}, {"SHORT": 1.0}, {"SHORT": 0.0, "RUN": 32}])
def test_any_blocks_runs_and_parts(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(3)
    docs, items = corpus(rng, 700), corpus(rng, 30)
    assert found(spark, docs, items) == sql_rows(docs, items)


def test_hybrid_equals_plain_sums(monkeypatch):
    monkeypatch.setattr(lexical, "RUN", 64)
    rng = np.random.default_rng(5)
    for _ in range(300):
        n_docs, k = int(rng.integers(1, 900)), int(rng.integers(1, 12))
        lists, total = [], np.zeros(n_docs, np.int64)
        for _ in range(rng.integers(0, 9)):
            at = np.flatnonzero(rng.random(n_docs) < rng.choice([0.005, 0.1, 0.7, 1.0]))
            scores = rng.integers(0, rng.choice([3, 1000]), len(at))
            np.add.at(total, at, scores)
            lists.append(lexical._List.of(at, scores, n_docs))
        best = sorted((-s, d) for d, s in enumerate(total.tolist()) if s > 0)[:k]
        places, scores = lexical.best_of_block(lists, n_docs, k)
        assert [(-s, d) for d, s in zip(places.tolist(), scores.tolist())] == best


def test_runs_that_cannot_win_are_not_read(monkeypatch):
    monkeypatch.setattr(lexical, "RUN", 8)
    read = []

    class Places(np.ndarray):
        def __getitem__(self, key):
            read.append(key)
            return super().__getitem__(key)

    scores = np.r_[np.full(8, 9), np.ones(72, np.int64)]
    x = lexical._List.of(np.arange(80), scores, 80)
    x.places = x.places.view(Places)
    places, best = lexical.best_of_block([x], 80, 3)
    assert places.tolist() == [0, 1, 2] and best.tolist() == [9, 9, 9]
    assert {k.start for k in read if isinstance(k, slice)} == {0}


def test_edges(spark):
    long = " ".join(f"t{i % 997}" for i in range(30_000))
    docs = [(5, "Alpha beta"), (3, "alpha BETA"), (3, "alpha BETA"), (7, None), (8, ""), (9, " .,; "), (None, "alpha beta"), (1, "Ünï ÜNÏ 12"), (2, long)]
    items = [(1, "ALPHA alpha"), (2, None), (3, ""), (4, "unknown"), (5, "ünï"), (6, "ÜNÏ 12 t3"), (None, "beta")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, Block string, times int")
    got = lexical.search(lexical.build_index(frame), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, row string")).collect()
    ranked = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        ranked.setdefault(r.item_id, []).append(r.doc_id)
    assert ranked == {1: [3, 3, 5, None], None: [3, 3, 5, None], 6: [1, 2]}
    empty = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(lexical.build_index(empty), asked).count() == 0
    assert lexical.search(lexical.build_index(frame), asked.where("false")).count() == 0


def test_repeated_queries_find_their_documents_again(spark):
    got = found(spark, [(1, "a b"), (2, "a c")], [(1, "b"), (1, "b")])
    assert len(got) == 2 and got[0] == got[1]
