"""Operators against plain versions of themselves on the small tables."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from rankloom.llm import bpe, neardup, packing, queries
from tools.check import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_topk", "op8_rules", "op9_licenses"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found, sql = queries.load()
    df = found[name](spark, SF)
    rel = con.execute(sql[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in rel.description], rel.fetchall())


def test_near_duplicate_classes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in neardup.with_classes(docs).collect()}
    assert got == {i: top(i) for i in sets}


def test_buckets_of_nine_members_are_compared_in_full(spark):
    """Four pairs and one single node in two shared buckets: every link is found, whatever the order of the hubs."""
    band = "key long, band int, node long, n long, prio long, sketch array<long>, marks array<int>"
    members = [(key, key, node, 10, node * 7919 % 11, [0] * 8, [1, 2]) for key in (0, 1) for node in range(9)]
    sets = [(node, [node // 2 * 100 + i for i in range(10)]) for node in range(9)]
    links, roots = neardup.link_buckets(spark.createDataFrame(members, band), spark.createDataFrame(sets, "node long, s array<int>"), 0.8)
    assert sorted(map(tuple, links.collect())) == [(0, 1), (2, 3), (4, 5), (6, 7)]
    assert {r.root for r in roots.collect()} == {0, 2, 4, 6}


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    values = np.r_[np.arange(300), np.arange(300)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sign = neardup.darts(values, np.repeat([0, 1], 300), np.r_[a, b], 2, 4000)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_windows_hold_the_proportions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs.repartition(4), path)
    mixed = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").sum("length").collect()
    total, by_window = Counter(), defaultdict(dict)
    for r in mixed:
        total[r[1]] += r[2]
        by_window[r[0]][r[1]] = r[2]
    whole = sum(total.values())
    own = {s for s, n in total.items() if n * 64 >= whole}
    for w, held in by_window.items():
        if (w + 1) * 4096 <= whole:
            assert sum(held.values()) == 4096
            assert all(abs(held.get(s, 0) - 4096 * total[s] / whole) < 2 for s in own if len(own) > 1 and s in held)


@pytest.mark.parametrize("large", [0, 9])
def test_small_sources_are_spread_over_all_windows(spark, large):
    """A hundred even sources, alone or beside one of nine tenths: none has a queue, and each is half sent at half of the tape."""
    n = 100
    rows = [(i, "word of the text " * (8 + i * 31 % 5), f"s{i // 10}") for i in range(10 * n)]
    rows += [(10 * n + i, "word of the text " * 100, "large") for i in range(large * n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df.repartition(4, "source"), public_tokenizers.path("word_bpe_49k.json"), window=512)
    seen = got.join(df.select("doc_id", "source"), "doc_id").select("source", (packing.F.col("sequence_id") * 512 + packing.F.col("offset")).alias("at"), "length").collect()
    half, total, early = sum(r.length for r in seen) / 2, Counter(), Counter()
    for r in seen:
        total[r.source] += r.length
        early[r.source] += r.length if r.at < half else 0
    assert len(total) == n + bool(large)
    assert all(abs(early[s] / total[s] - 0.5) <= 0.2 for s in total)
    places = sorted((r.at, r.length) for r in seen)
    assert places[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(places, places[1:]))


def test_merges_of_long_words():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.Vocabulary(path)
    texts = ["a" * 4001, "ab" * 999, "=" * 5000, "Σίσυφος ΣΑΣ", "don't I'LL x's", "1 234 ½ Ⅷ", "é \x1c \x85 ​"]
    assert own.encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_large_buckets_lose_no_link(spark):
    """Twenty pairs that share a passage in one bucket, each pair ranked last and behind all hubs: no round of hubs finds one."""
    band = "key long, band int, node long, n long, prio long, sketch array<long>, marks array<int>"
    members = [(0, 0, node, 20, node if node < 40 else 100 + node % 20, [0] * 8, [1]) for node in range(80)]
    own = lambda node: node if node < 40 else 40 + node % 20
    sets = [(node, [*range(12), *(1000 * own(node) + i for i in range(1, 8)), 10**6 + node]) for node in range(80)]
    links, roots = neardup.link_buckets(spark.createDataFrame(members, band), spark.createDataFrame(sets, "node long, s array<int>"), 0.8)
    assert sorted(map(tuple, links.collect())) == [(n, n + 20) for n in range(40, 60)]
    assert {(r.node, r.root) for r in roots.collect()} == {(n, 40 + (n - 40) % 20) for n in range(60, 80)}
