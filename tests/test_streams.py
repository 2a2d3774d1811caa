"""Streams over several batches: restarts, late rows, bounded state."""

import random

import numpy as np
from pyspark.sql import functions as F

from rankloom.operators import cdc
from rankloom.session import numbered_folders, work_dir
from rankloom.sources.cdc import CDC_SCHEMA, read_cdc
from rankloom.streaming.apply import apply_cdc, stored_table
from rankloom.streaming.gaps import OpenGaps, stream_gaps
from rankloom.streaming.runs import drain_append, drain_update
from rankloom.streaming.traffic import stream_stats


def random_changes(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choices(["insert", "remove", "clear", "fetch_start"], [8, 2, 0.3, 1])[0]
        key = "" if kind == "clear" else f"k{rng.randrange(12)}"
        rows.append((i, i, rng.randrange(50), "remove" if kind == "clear" else kind, key, rng.choice(["{}", "{}", "bad"]), "u", "c", rng.choice(["b", "me"]), 0))
    return rows


def write_batches(spark, path, rows, size):
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], CDC_SCHEMA).coalesce(1).write.mode("append").json(path)


def keyed(df):
    return {r.query_key: r.timestamp_ms for r in df.collect()}


def test_reduced_batches_reduce_to_the_whole(spark):
    for seed in range(3):
        df = spark.createDataFrame(random_changes(seed, 300), CDC_SCHEMA)
        parts = [cdc.reduce_cdc(cdc.effective_events(df.filter(F.col("event_id").between(a, a + 99)), "me", 1)) for a in (0, 100, 200)]
        whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
        assert keyed(cdc.stored_entries(cdc.reduce_cdc(whole))) == keyed(cdc.fold_cdc(df, "me", 1))


def test_applied_changes_restart_and_compact(spark):
    rows, path, state = random_changes(4, 120), work_dir(spark, "test-cdc"), work_dir(spark, "test-state")
    write_batches(spark, path, rows[:80], 20)
    got = keyed(apply_cdc(read_cdc(spark, path, files_per_batch=1), "me", 1, state, compact_every=3))
    want = keyed(cdc.fold_cdc(spark.createDataFrame(rows[:80], CDC_SCHEMA), "me", 1))
    assert got == want
    # nothing new: the newest table, and nothing written
    before = numbered_folders(spark, f"{state}/changes", "batch")
    assert keyed(apply_cdc(read_cdc(spark, path, files_per_batch=1), "me", 1, state, compact_every=3)) == want
    assert numbered_folders(spark, f"{state}/changes", "batch") == before
    write_batches(spark, path, rows[80:], 20)
    got = keyed(apply_cdc(read_cdc(spark, path, files_per_batch=1), "me", 1, state, compact_every=3))
    assert got == keyed(cdc.fold_cdc(spark.createDataFrame(rows, CDC_SCHEMA), "me", 1)) == keyed(stored_table(spark, state))
    assert numbered_folders(spark, f"{state}/base", "upto") == [2, 5]
    assert all(n > 2 for n in numbered_folders(spark, f"{state}/changes", "batch"))


def test_a_batch_writes_only_the_keys_it_touches(spark):
    path, state = work_dir(spark, "test-cdc"), work_dir(spark, "test-state")
    many = [(i, i, 1, "insert", f"k{i}", "{}", "u", "c", "b", 0) for i in range(50)]
    last = [(50, 50, 2, "insert", "k7", "{}", "u", "c", "b", 0), (51, 51, 2, "remove", "k8", "", "u", "c", "b", 0)]
    write_batches(spark, path, many, 50)
    write_batches(spark, path, last, 50)
    got = apply_cdc(read_cdc(spark, path, files_per_batch=1), "me", 1, state)
    assert got.count() == 49
    assert sorted(r.query_key for r in spark.read.parquet(f"{state}/changes/batch=1").collect()) == ["k7", "k8"]


def test_open_gaps_equal_the_missing_numbers():
    rng = np.random.default_rng(1)
    for _ in range(200):
        seen = rng.permutation(np.flatnonzero(rng.random(60) < 0.7))
        gaps, at = OpenGaps(), 0
        for part in np.array_split(seen, rng.integers(1, 8)):
            twice = np.r_[part, part[:2]]
            gaps.see(twice, np.arange(at, at + len(twice)))
            at += len(twice)
        held = np.sort(seen)
        assert [g[:2] for g in gaps.gaps] == [[int(a), int(b)] for a, b in zip(held, held[1:]) if b - a > 1]
        ripe = gaps.ripe(at // 2)
        assert all(g[2] <= at // 2 for g in ripe) and all(g[2] > at // 2 for g in gaps.gaps)


MINUTE = 60_000


def gap_rows(spark, batches):
    path = work_dir(spark, "test-gaps")
    for rows in batches:
        made = [(n, n, (t + 1) * MINUTE, "insert", "k", "{}", "u", "c", origin, 0) for origin, n, t in rows]
        spark.createDataFrame(made, CDC_SCHEMA).coalesce(1).write.mode("append").json(path)
    return sorted(tuple(r) for r in drain_append(stream_gaps(read_cdc(spark, path, files_per_batch=1), "10 minutes"), "gaps").collect())


def test_a_late_row_closes_a_gap_and_a_row_too_late_does_not(spark):
    first = [("a", 1, 0), ("a", 2, 1), ("a", 6, 2), ("b", 1, 0), ("b", 3, 1)]
    fill = [("a", 3, 3), ("a", 5, 3), ("b", 2, 1)]
    beat = [("a", None, 60), ("b", None, 60)]
    assert gap_rows(spark, [first, fill, beat]) == [("a", 3, 5, 1)]
    assert gap_rows(spark, [first, beat, [("a", None, 61)], fill]) == [("a", 2, 6, 3), ("b", 1, 3, 1)]
    assert gap_rows(spark, [first]) == []  # still open


def test_late_rows_are_counted_and_closed_windows_leave_the_state(spark):
    path = work_dir(spark, "test-log")
    schema = "request_id bigint, ts timestamp, client_id bigint, upstream_id string, latency_ms double, success boolean, cache_status string, miss_reason string"

    def rows(hours):
        made = [(i, h * 3600, 1, "u", 1.0, True, "hit", None) for i, h in enumerate(hours)]
        df = spark.createDataFrame(made, "request_id bigint, t bigint, client_id bigint, upstream_id string, latency_ms double, success boolean, cache_status string, miss_reason string")
        df.select("request_id", F.timestamp_seconds("t").alias("ts"), *schema_names[2:]).coalesce(1).write.mode("append").parquet(path)

    schema_names = [c.strip().split()[0] for c in schema.split(",")]
    for day in range(6):
        rows([24 * day + h for h in range(24)])
    rows([1, 2, 24 * 6])  # two rows of a window closed long ago
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    table, told = drain_update(stream_stats(log, "1 hour", "2 hours", by=("upstream_id",)), ["window_start", "window_end", "upstream_id"], "windows")
    counted = table.collect()
    assert len(counted) == 6 * 24 + 1 and sum(p["late_rows"] for p in told) == 2
    assert max(p["state_rows"] for p in told) <= 24 + 24 + 4 and told[-1]["state_rows"] <= 5
