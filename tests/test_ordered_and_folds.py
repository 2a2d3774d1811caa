"""Ordered scans and keyed folds against plain Python, with one key holding most rows and tiny slots and chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import folds, health, inflight, ordered, percentiles, renewal, replay, sweeps
from rankloom.operators.ordered import ordered_scan


def events(n=400, seed=7):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.5, 1, 3, 40, 900])
        key = 0 if rng.random() < 0.6 else rng.randrange(1, 5)
        rows.append((i, key, t, rng.choice([None, rng.randrange(100)]), rng.random() < 0.6))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "seq bigint, key bigint, t double, v int, success boolean")
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


@pytest.mark.parametrize("rows_in_slot", [1, 8, 64, 1 << 20])
def test_ordered_scan_equals_loop(spark, rows_in_slot):
    rows = events()
    df = frame(spark, rows).withColumn("one", F.lit(1))
    got = ordered_scan(
        df, ["key"], "ts", ["seq"], rows_in_slot, previous={"p": "v"}, last_seen={"l": "v"}, running_sum={"n": "one"},
        running_max={"m": "v"}, prior_max={"pm": "v"},
    )
    got = {r.seq: (r.p, r.l, r.n, r.m, r.pm) for r in got.collect()}
    for key_rows in by_key(rows).values():
        prev = last = top = None
        for i, (seq, _, _, v, _) in enumerate(key_rows):
            before = top
            new_last = v if v is not None else last
            top = v if top is None else (top if v is None else max(top, v))
            assert got[seq] == (prev if i else None, new_last, i + 1, top, before)
            prev, last = v, new_last


def test_ttl_replay_in_chunks_equals_loop(spark):
    rows = events()
    trace = frame(spark, rows).withColumn("cluster_id", F.col("key"))
    got = replay.fills(trace, [5.0, 100.0, 2000.0], slot_rows=16)
    got = {(r.ttl, r.seq): r.is_fill for r in got.collect()}
    assert len(got) == 3 * len(rows)
    for ttl in (5.0, 100.0, 2000.0):
        for key_rows in by_key(rows).values():
            filled = None
            for seq, _, t, _, _ in key_rows:
                miss = filled is None or t - filled > ttl
                filled = t if miss else filled
                assert got[(ttl, seq)] == miss


def test_token_bucket_in_chunks_equals_loop(spark):
    rows = events()
    got = sweeps.token_bucket(frame(spark, rows).withColumnRenamed("seq", "request_id"), "key", [(0.05, 3.0)], chunk_rows=16, slot_rows=32)
    got = {r.request_id: r.allowed for r in got.collect()}
    for key_rows in by_key(rows).values():
        tokens, last = 3.0, None
        for seq, _, t, _, _ in key_rows:
            tokens = 3.0 if last is None else min(3.0, tokens + (t - last) * 0.05)
            last = t
            assert got[seq] == (tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0


def test_machines_in_chunks_equal_one_pass(spark):
    df = frame(spark, events()).withColumn("upstream_id", F.concat(F.lit("u"), F.col("key").cast("string"))).select(
        "upstream_id", "ts", "seq", "success"
    )
    circuit = health.CircuitConfig(failure_threshold=2, open_seconds=20, window_seconds=60)
    resilience = health.ResilienceConfig(degraded_after=2, offline_after=3, healthy_after=2)
    for run, cfg in ((health.circuit_timeline, circuit), (health.resilience_timeline, resilience)):
        whole = {r.seq: r for r in run(df, cfg).collect()}
        cut = {r.seq: r for r in run(df, cfg, chunk_rows=16, slot_rows=32).collect()}
        assert whole == cut
        assert len({r.state for r in whole.values()}) == 3


def test_coalescing_ends_with_the_leader(spark):
    rows = [("k", 1, 0, 10.0), ("k", 2, 5, 100.0), ("k", 3, 10, 1.0), ("k", 4, 10, 1.0), ("k", 5, 30, 1.0)]
    log = spark.createDataFrame(rows, "key string, request_id bigint, t bigint, seconds double").withColumn(
        "ts", F.timestamp_seconds("t")
    )
    got = {r.request_id: r.role for r in inflight.coalesce_requests(log, "key", "seconds").collect()}
    assert got == {1: "leader", 2: "waiter", 3: "leader", 4: "waiter", 5: "leader"}


def test_fold_converges_over_many_chunks(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(100)], "key string, at bigint, v int")
    out = folds.keyed_fold(
        df, ["key"], "at", [], ["v"], "total bigint", lambda: [0], lambda s, v: ([s[0] + int(v)], (s[0] + int(v),)), 30, 7
    )
    assert {r.at: r.total for r in out.collect()} == {i: i * (i + 1) // 2 for i in range(100)}


def test_percentile_definitions_differ(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4)], "g string, x double")

    def value(method):
        return percentiles.percentiles(df, ["g"], "x", [0.5], method, slot_rows=1).first()["x"]

    assert (value("nearest_rank"), value("nearest_index"), value("linear")) == (2.0, 3.0, 2.5)


def test_health_rules(spark):
    outcome = [True] * 9 + [False, False, True] + [False] * 3 + [True, True]
    df = spark.createDataFrame([("u", i, s) for i, s in enumerate(outcome)], "upstream_id string, seq bigint, success boolean")
    df = df.withColumn("ts", F.timestamp_seconds("seq"))
    states = [r.state for r in health.health_timeline(df, slot_rows=4).orderBy("seq").collect()]
    assert states[:11] == ["online"] * 11
    assert states[11:] == ["degraded", "online", "online", "offline", "offline", "degraded"]


def test_slots_are_bounded_when_all_rows_share_a_second(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.col("id").alias("seq"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.lit(1).alias("one"))
    light, heavy, n = ordered.light_and_heavy(df, ["key"], 64)
    assert n == 5000 and light.count() == 0
    sizes = [r["count"] for r in ordered.slots(heavy, ["ts", "seq"], 64, n).groupBy("_slot").count().collect()]
    assert max(sizes) <= 64 and sum(sizes) == 5000
    got = ordered_scan(df, ["key"], "ts", ["seq"], 64, running_sum={"n": "one"}, previous={"p": "seq"}).collect()
    assert sorted((r.seq, r.n, r.p) for r in got) == [(i, i + 1, i - 1 if i else None) for i in range(5000)]


def test_null_keys_and_tables_without_keys(spark):
    rows = [(None, 1), (None, 2), ("a", 3), (None, 4), ("a", 5)]
    df = spark.createDataFrame(rows, "key string, v bigint")
    for most in (1, 2, 100):
        got = ordered_scan(df, ["key"], "v", [], most, running_sum={"s": "v"}).collect()
        assert sorted((r.v, r.s) for r in got) == [(1, 1), (2, 3), (3, 3), (4, 7), (5, 8)]
        got = ordered_scan(df, [], "v", [], most, running_sum={"s": "v"}, prior_max={"m": "v"}).collect()
        assert sorted((r.v, r.s, r.m) for r in got) == [(1, 1, None), (2, 3, 1), (3, 6, 2), (4, 10, 3), (5, 15, 4)]
        assert ordered_scan(df.where("false"), ["key"], "v", [], most, running_sum={"s": "v"}).count() == 0


def chain_by_loop(rows, closed):
    """Rows (key, seq, at, until) by a plain loop: seq to (opens, span_at)."""
    out, open_spans = {}, {}
    for key, seq, at, until in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        end, since = open_spans.get(key, (None, None))
        joins = end is not None and (at <= end if closed else at < end)
        if not joins:
            open_spans[key] = until, at
        out[seq] = (not joins, since if joins else at)
    return out


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_renewal_chains_equal_a_loop(spark, closed, seed):
    """A hot key over many slots, ties in time, spans of no length and spans that end before their own row."""
    rng = np.random.default_rng(seed)
    n = 240
    at = np.sort(rng.integers(0, [40, 2000, 150][seed], n))
    length = rng.choice([[-1, 0, 1, 5], [0, 3, 40, 900], [-1, 7, 7, 7]][seed], n)
    rows = [(int(rng.random() > 0.8) * int(rng.integers(1, 4)), i, int(a), int(a + x)) for i, (a, x) in enumerate(zip(at, length))]
    df = spark.createDataFrame(rows, "key bigint, seq bigint, _at bigint, _until bigint")
    want = chain_by_loop(rows, closed)
    for slot_rows in (8, 1 << 20):
        got = renewal.renewal_chain(df, ["key"], "_at", ["seq"], closed, slot_rows).collect()
        assert {r.seq: (r.opens, r.span_at) for r in got} == want


def test_chain_of_slots_that_never_meet_takes_few_rounds(spark, monkeypatch):
    """Two hundred slots and spans of a little more than one row: where a chain stands in a slot depends on all slots before it."""
    n, width = 1600, 8
    rows = [("k", i, 10 * i, 10 * i + 15) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, seq bigint, _at bigint, _until bigint").coalesce(1)
    joined, plain = [], renewal.cut
    monkeypatch.setattr(renewal, "cut", lambda d: joined.append(d.columns) or plain(d))
    got = renewal.renewal_chain(df, ["key"], "_at", ["seq"], False, width).collect()
    assert {r.seq: (r.opens, r.span_at) for r in got} == chain_by_loop(rows, False)
    rounds = sum("next" in c for c in joined) - 1
    assert 8 <= rounds <= 10
