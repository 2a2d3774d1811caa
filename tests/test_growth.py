"""What a single row, block or plan may hold, however large the tables are."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.catalog import entry_tables
from rankloom.llm import topk
from rankloom.operators import search_vector as sv
from rankloom.operators import text_index
from rankloom.operators.text_index import _Block, _scorer
from rankloom.sources.backend_hits import parse_hits


def test_top_k_broadcasts_nothing(spark):
    df = spark.range(60).select(F.col("id").alias("vec_id"), F.array(*[F.col("id") * 0.01 * i for i in range(4)]).alias("embedding"))
    found = topk.top_k(df, F.col("_id") % 20 == 0, k=3)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.rank, r.vec_id) for r in found.where("query_id = 20").orderBy("rank").collect()] == [(1, 59), (2, 58), (3, 57)]


@pytest.mark.parametrize("values", [[-3, 127], [-129, 5], [40_000], [2**40, -1], []])
def test_block_values_take_few_bytes(values):
    kept = topk._narrow(np.array(values, np.int64))
    assert kept.tolist() == values and kept.itemsize == {(-3, 127): 1, (-129, 5): 2, (40_000,): 4, (2**40, -1): 8, (): 1}[tuple(values)]


@pytest.mark.parametrize("backend", ["elasticsearch", "meilisearch", "milvus", "qdrant"])
def test_responses_come_in_pages(spark, tmp_path, monkeypatch, backend):
    rows = [(i // 2, f"text {i} " * 20, "en" if i % 3 else "de", "a" if i % 4 else None, i * 10) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    whole = entry_tables._raw_responses(spark, str(tmp_path), backend)
    assert whole.count() == 2
    expected = parse_hits(whole, backend).collect()
    monkeypatch.setattr(entry_tables, "PAGE_BYTES", 2000)
    pages = entry_tables._raw_responses(spark, str(tmp_path), backend)
    assert pages.count() > 10 and pages.agg(F.max(F.length("response"))).first()[0] < 4000
    got = parse_hits(pages, backend).collect()
    assert len(got) == 120 and sorted(map(str, got)) == sorted(map(str, expected))
    assert sorted(r.rank for r in got if r.query_id == "a") == list(range(1, 91))


def test_scorer_holds_no_scores_per_query(spark):
    """A thousand askers of one list cost its scores once, and a group of many queries is no larger than its block."""
    size, askers = 8192, 1000
    asks = [{"query_id": i, "k": 2, "qtf": 1 + i % 2} for i in range(askers)]
    rows = pa.table({
        "field": pa.array([0, 0], pa.int32()), "weight": [None, 2.0], "asks": pa.array([None, asks]),
        "places": pa.array([None, np.arange(size).astype("<u2").tobytes()]), "times": pa.array([None, np.arange(1, size + 1).astype("<u4").tobytes()]),
        "ids": pa.array([list(range(size)), None], pa.list_(pa.int64())), "lengths": pa.array([np.arange(1, size + 1).astype("<i8").tobytes(), None]),
    })
    tracemalloc.start()
    found = _scorer({0: (size, 10.0)}, 1, (pa.int64(), pa.int64()))(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20 and found.num_rows == 2 * askers
    tf = np.arange(1, size + 1)
    scores = np.round(2 * tf / (tf + 1.2 * (0.25 + 0.75 * tf / 10)), 6)
    best = np.lexsort((np.arange(size), -scores))[:2]
    assert found.column("id").to_pylist()[:2] == best.tolist() and found.column("score").to_pylist()[:2] == scores[best].tolist()


def _block_of(texts, step):
    block = _Block(1)
    for at in range(0, len(texts), step):
        part = texts[at : at + step]
        block.add(pa.array(range(at, at + len(part)), pa.int64()), [pa.array(part, pa.string())])
    return block


def test_a_block_is_sorted_in_parts():
    """Writing a block of many postings takes at most 28 bytes for each, what is held of them included."""
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(4000)])
    texts = [" ".join(words[rng.choice(4000, 300, replace=False)]) for _ in range(3000)]
    tracemalloc.start()
    block = _block_of(texts, 200)
    tracemalloc.reset_peak()
    postings = sum(int(np.sum(row["df"])) for row in block.rows(0) if "df" in row)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert postings == 900_000 and peak < 28 * postings


def test_a_block_holds_names_in_few_bytes():
    """Postings and names of a gathered block, whether Python, numpy or Arrow keeps them, and every list of it."""
    rng = np.random.default_rng(8)
    words = np.array([f"word{i}" for i in range(100_000)])
    texts = [" ".join(words[rng.choice(len(words), 300, replace=False)]) for _ in range(3000)]
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    block = _block_of(texts, 300)
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 22 * 900_000
    lists = [row for row in block.rows(0) if "df" in row]
    names = [t for row in lists for t in row["token"]]
    assert sum(int(np.sum(row["df"])) for row in lists) == 900_000 and names == sorted(set(" ".join(texts).split()))


def test_cosines_hold_no_copies_of_a_part():
    """A part of the corpus is held as its matrix and once in single precision, beside one step's similarities."""
    m = np.random.default_rng(9).standard_normal((8192, 128))
    rows = pd.DataFrame({"id": np.arange(len(m)), "embedding": list(m)})
    asked = rows[:40].rename(columns={"id": "query_id"}).assign(k=3)
    tracemalloc.start()
    found = sv._block_top_k("cosine", None, False, False)(asked, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.2 * m.nbytes
    assert len(found) == 120 and found.query("query_id == id")["score"].eq(1.0).sum() == 40


@pytest.mark.parametrize("settings", [{"SORTED": 1}, {"SORTED": 7, "SENT": 3}, {"SORTED": 1 << 18}])
def test_parts_of_a_block_keep_all_lists(monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(text_index, name, value)
    texts = [" ".join(["common"] * (1 + i % 3) + [f"t{i % 5}"] * 2 + [f"own{i}"]) for i in range(40)] + [None, ""]
    found, heads = {}, []
    for row in _block_of(texts, 9).rows(0):
        if "token" not in row:
            heads.append((row["n"], row["total"], np.frombuffer(row["lengths"][0], "<i8").tolist()))
            continue
        for token, df, most, least, places, times in zip(*(row[c] for c in ("token", "df", "most", "least", "places", "times")), strict=True):
            at, tf = np.frombuffer(places.as_buffer(), "<u2").tolist(), np.frombuffer(times.as_buffer(), "<u4").tolist()
            assert token not in found and len(at) == df
            found[token] = (dict(zip(at, tf, strict=True)), int(most), int(least))
    lengths = [4 + i % 3 for i in range(40)] + [0, 0]
    expected = {}
    for i, text in enumerate(texts):
        for token in set((text or "").split()):
            expected.setdefault(token, {})[i] = text.split().count(token)
    assert heads == [([40], [sum(lengths)], lengths)]
    assert found == {t: (p, max(p.values()), min(lengths[i] for i in p)) for t, p in expected.items()}


@pytest.mark.parametrize("kind", ["plain", "skip_same", "earlier"])
def test_best_cosines_equal_plain_ones(kind):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 3, (700, 6)).astype(float)
    m[:20] = 0
    m[300:600] = m[300]
    m[40:60] += rng.standard_normal((20, 6)) * 1e-6
    rows = pd.DataFrame({"id": rng.permutation(700), "seq": rng.permutation(700), "embedding": list(m)})
    asked = rows.rename(columns={"id": "query_id"}).assign(k=rng.integers(1, 6, 700))
    for least in (None, 0.9):
        got = sv._block_top_k("cosine", least, kind == "skip_same", kind == "earlier")(asked, rows)
        sims = np.round(sv.similarities(m, m, "cosine"), 6)
        expected = []
        for i, (q, s, k) in enumerate(zip(asked["query_id"], asked["seq"], asked["k"], strict=True)):
            good = [j for j in range(700) if (kind != "skip_same" or rows["id"][j] != q) and (kind != "earlier" or rows["seq"][j] < s) and (least is None or sims[i, j] >= least)]
            expected += [(q, k, rows["id"][j], sims[i, j]) for j in sorted(good, key=lambda j: (-sims[i, j], rows["id"][j]))[:k]]
        assert sorted(got.itertuples(index=False, name=None)) == sorted(expected)


def test_best_cosines_compute_few_pairs(monkeypatch):
    """Only rows that may be among the best are computed as doubles, and later rows are not compared at all."""
    m = np.random.default_rng(5).standard_normal((2000, 16))
    rows = pd.DataFrame({"id": np.arange(2000), "seq": np.arange(2000), "embedding": list(m)})
    met = []
    einsum = np.einsum
    monkeypatch.setattr(sv.np, "einsum", lambda how, a, b: met.append(len(a)) or einsum(how, a, b))
    found = sv._block_top_k("cosine", 0.5, False, True)(rows.rename(columns={"id": "query_id"}).assign(k=1), rows)
    assert len(found) > 1000 and sum(met) < 40_000
