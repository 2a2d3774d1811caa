"""The source divergence audit against SQL and against plain counting, with runs and pages of every size."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from rankloom.llm import divergence, queries
from tools.check import table

SF = "/root/testdata/sf0.001"


def sql_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    rel = con.execute(queries.load()[1]["op13_divergence"])
    return table([d[0] for d in rel.description], rel.fetchall())


def found(spark, rows, parts=3):
    df = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string").repartition(parts))
    return table(df.columns, df.collect())


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)] + ["é", "日本", "Straße"])
    sources = np.array(["hot", "a", "b", "c", "", "é"])
    made = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", ""]), rng.choice(sources, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])
        made.append((str(lang), str(source), " ".join(rng.choice(words, rng.integers(0, 25)).tolist())))
    return made


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    fns, sql = queries.load()
    df = fns["op13_divergence"](spark, SF)
    rel = con.execute(sql["op13_divergence"])
    assert table(df.columns, df.collect()) == table([d[0] for d in rel.description], rel.fetchall())


@pytest.mark.parametrize("settings", [{}, {"MEMORY": 3000, "PAGE_TERMS": 3, "SLICE_BYTES": 400, "SHARDS": 2}, {"MEMORY": 1, "SLICE_BYTES": 200, "SHARDS": 9}, {"PAIR_SUMS": 3, "SENT": 2}])
def test_any_runs_pages_and_shards(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(1, 600)
    assert found(spark, rows) == sql_rows(rows)


def test_merge_streams_sorted_pages():
    """Runs of any overlap, in pages: every kept term once with all its sources, and never more open pages than runs."""
    import pyarrow as pa

    rng, pages, want = np.random.default_rng(2), [], defaultdict(Counter)
    for _ in range(12):
        terms = sorted({f"t{x:03d}" for x in rng.integers(0, 200, 60)})
        for i in range(0, len(terms), 7):
            some, sizes, sources, counts = terms[i : i + 7], [], [], []
            for t in some:
                own = sorted(set(rng.integers(0, 3, 2).tolist()))
                sizes.append(len(own))
                for s in own:
                    c = int(rng.integers(1, 5))
                    sources.append(s)
                    counts.append(c)
                    want[t][f"s{s}"] += c
            pages.append({"shard": 0, "lang": "en", "first": some[0], "terms": some, "sizes": sizes, "sources": sources, "counts": counts, "docs": counts, "names": ["s0", "s1", "s2"]})
    pages.sort(key=lambda p: p["first"])
    batches = [pa.RecordBatch.from_pylist(pages[i : i + 5]) for i in range(0, len(pages), 5)]
    got = {t: dict(zip(names, counts)) for _, t, names, counts in divergence.merged(iter(batches), 10)}
    assert got == {t: dict(c) for t, c in want.items() if sum(c.values()) >= 10}


def test_edges(spark):
    some = "alpha beta GAMMA ünï"
    rows = [(None, "s", some)] * 6 + [("", "s", some)] * 6 + [(None, None, "alpha " * 30_000), ("", "t", None), ("", "u", ""), ("fr", "x", some), ("fr", "y", some)]
    assert found(spark, rows) == sql_rows(rows)
    got = divergence.audit(spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, p0 int")).collect()
    assert {(r.source, r.item) for r in got if r.lang == "" and r.part == "pair"} == {(a, b) for a in ("s", "", "t", "u") for b in ("s", "", "t", "u") if a != b}
    assert all(r.value == 0 for r in got if r.lang == "fr") and sum(r.lang == "fr" for r in got) == 2
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n = 7 * 10**17
    df = spark.createDataFrame([(n // 3, n, 12345)], "count long, n long, v long").select(divergence.share("count", "n", "v").alias("p"))
    assert df.first().p == 1 + 10**9 * (n // 3 + 2) // (n + 2 * 12345)
