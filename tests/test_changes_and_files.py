"""Change events, drift and files."""

import json

from pyspark.sql import functions as F

from rankloom.operators import cdc, drift
from rankloom.session import work_dir
from rankloom.sources import corpus, entry_store, traces
from rankloom.sources.cdc import CDC_SCHEMA, read_cdc
from rankloom.streaming.apply import apply_cdc


def change_rows():
    def e(n, kind, key, ts, origin="b", payload="{}", expiry=0):
        return (n, n, ts, kind, key, payload, "u", "c", origin, expiry)

    return [
        e(1, "insert", "k", 100), e(2, "insert", "k", 100, payload='{"x":1}'), e(3, "insert", "k", 90), e(4, "remove", "k", 5),
        e(5, "insert", "k", 50), e(6, "insert", "k", 40), e(7, "insert", "m", 10, origin="me"), e(8, "insert", "n", 10, expiry=5),
        e(9, "insert", "o", 10), e(10, "remove", "", 1), e(11, "insert", "p", 7), e(12, "insert", "q", 7, payload="bad"),
        e(13, "fetch_start", "p", 8), e(14, "insert", "k", 1),
    ]


def test_fold_and_labels(spark):
    df = spark.createDataFrame(change_rows(), CDC_SCHEMA)
    state = {r.query_key: r.timestamp_ms for r in cdc.fold_cdc(df, "me", 1000).collect()}
    assert state == {"p": 7, "k": 1}
    got = [r.result for r in cdc.label_cdc(df, "me", 1000, slot_rows=3).orderBy("event_id").collect()]
    assert got == [
        "applied", "stale", "stale", "applied", "applied", "stale", "echo", "expired", "applied", "applied", "applied",
        "bad_payload", "ignored", "applied",
    ]


def test_stream_in_several_batches_equals_fold(spark):
    df = spark.createDataFrame(change_rows(), CDC_SCHEMA)
    path = work_dir(spark, "test-cdc")
    for low, high in ((1, 5), (6, 10), (11, 14)):
        df.filter(F.col("event_id").between(low, high)).coalesce(1).write.mode("append").json(path)
    got = apply_cdc(read_cdc(spark, path, files_per_batch=1), "me", 1000)
    assert {r.query_key: r.timestamp_ms for r in got.collect()} == {"p": 7, "k": 1}


def test_drift_levels(spark):
    schema = "query_id bigint, id string, score double"
    old = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.5), (3, "a", 0.9)], schema)
    new = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (4, "a", 0.5), (3, "a", 0.1)], schema)
    got = {r.query_id: r.level for r in drift.detect_drift(old, new).collect()}
    assert got == {1: "none", 2: "major", 4: "major", 3: "significant"}
    assert {r.level for r in drift.detect_drift(old, old).collect()} == {"none"}


GOLDEN = """# tides of May

## Metadata

- **Context:** `coast`
- **Upstream:** `pool-2`
- **Hash:** `77aa01bc`
- **Cached at:** `2024-05-06T07:08:09.000000000Z`

## Response

```json
{
  "extra": {
    "a": [
      1,
      2.5
    ]
  },
  "key": "ü",
  "ok": true,
  "results": []
}
```
"""


def test_entry_documents(spark):
    rows = [
        ("tides of May", "coast", "pool-2", "77aa01bc", 1714979289, 0, '{"results":[],"ok":true,"key":"ü","extra":{"a":[1,2.5]}}'),
        ("", "coast", "pool-2", "ffff0000", 1700000000, 2, "not json"),
    ]
    df = spark.createDataFrame(
        rows, "query string, context_id string, upstream_id string, norm_key string, t bigint, extended_count int, response_json string"
    ).withColumn("cached_at", F.timestamp_seconds("t"))
    got = {r.norm_key: r for r in entry_store.distill_documents(df).collect()}
    assert got["77aa01bc"].body == GOLDEN and got["77aa01bc"].file_name == "tides-of-may-77aa01bc.md"
    other = got["ffff0000"]
    assert other.file_name == "ffff0000.md"
    assert other.body.startswith("# <empty>\n") and "- **TTL extensions:** 2\n" in other.body and "not json" in other.body
    out = work_dir(spark, "test-distill")
    entry_store.distill_sink(df, out)
    assert spark.read.json(f"{out}/entries").count() == 2 == spark.read.json(f"{out}/index").count()


def test_text_sources(spark):
    path = work_dir(spark, "test-lines")
    lines = ["  plain text ", "1\t second field\tthird", "", "   "]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    assert sorted(r.query for r in corpus.read_query_texts(spark, path).collect()) == ["plain text", "second field"]
    path = work_dir(spark, "test-trace")
    lines = [json.dumps({"query": "a", "cluster_id": 3}), json.dumps({"query": "b"}), "", json.dumps({"cluster_id": 1}), "broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, bad = traces.read_trace(spark, path)
    assert {r.key for r in good.collect()} == {"a", "b"} and bad.count() == 2
