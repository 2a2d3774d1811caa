"""Queries on cached entries and on the sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog.base import query
from rankloom.catalog.ctes import CTE, compose
from rankloom.functions.text import query_key
from rankloom.operators import entries as en
from rankloom.operators.ordered import ordered_scan
from rankloom.sources import backend_hits, corpus, entry_store, traces
from rankloom.session import work_dir

FRESH, STALE = 3600.0, 7200.0
NOW = fx.NOW


def cache_entries(spark, sf):
    """The last event of every context and key as an entry; its results are the documents of the key."""
    log = fx.request_log(spark, sf)
    last = log.groupBy("context_id", "key").agg(
        F.max_by(F.struct("ts", "upstream_id", "latency_ms"), F.struct("ts", "request_id")).alias("x"),
        (F.count("*") - 1).alias("extended_count"),
    )
    docs = (
        fx.table(spark, sf, "documents")
        .groupBy(F.pmod("doc_id", F.lit(100)).alias("key"))
        .agg(F.count("*").alias("n_results"), F.sum("n_chars").alias("bytes"))
    )
    text = F.concat(F.lit("key "), F.col("key").cast("string"))
    return (
        last.join(docs, "key", "left")
        .select(
            query_key(text, "context_id").alias("norm_key"),
            text.alias("query"),
            "context_id",
            F.col("x.upstream_id").alias("upstream_id"),
            F.col("x.ts").alias("cached_at"),
            F.coalesce("n_results", F.lit(0)).alias("n_results"),
            F.coalesce("bytes", F.lit(0)).alias("bytes"),
            "extended_count",
            F.to_json(F.struct(F.col("key"), F.floor("x.latency_ms").alias("took_ms"))).alias("response_json"),
        )
    )


CTE["entries"] = (
    ("log",),
    """SELECT sha256('ctx:' || context_id || ':key ' || key) AS norm_key, 'key ' || key AS query, context_id, upstream_id, ts AS cached_at,
    coalesce(n, 0) AS n_results, CAST(coalesce(b, 0) AS BIGINT) AS bytes, c - 1 AS extended_count, key,
    epoch_us(TIMESTAMP '2024-01-31 00:00:00' - ts) / 1e6 AS age, CAST(floor(latency_ms) AS BIGINT) AS took_ms,
    3600 + floor(3600 * (CAST('0x' || sha256('ctx:' || context_id || ':key ' || key)[1:2] AS BIGINT) / 255.0) * 0.1) AS jf
    FROM (SELECT *, count(*) OVER (PARTITION BY context_id, key) AS c FROM log
          QUALIFY row_number() OVER (PARTITION BY context_id, key ORDER BY ts DESC, request_id DESC) = 1)
    LEFT JOIN (SELECT doc_id % 100 AS key, count(*) AS n, sum(n_chars) AS b FROM documents GROUP BY ALL) USING (key)""",
)
CLASS = """CASE WHEN age < jf THEN 'fresh' WHEN age < jf + 7200 THEN 'stale' WHEN age < 86400 THEN 'frozen' ELSE 'expired' END"""


@query("classify_freshness", compose(f"SELECT norm_key, {CLASS} AS freshness FROM entries", "entries"))
def _(spark, sf):
    return en.classify_freshness(cache_entries(spark, sf), FRESH, STALE, NOW).select("norm_key", "freshness")


@query(
    "cache_stats",
    compose(
        """SELECT upstream_id, count(*) AS total, count(*) FILTER (age < 3600) AS fresh,
        count(*) FILTER (age >= 3600 AND age < 10800) AS stale, count(*) FILTER (age >= 10800) AS expired,
        CAST(sum(bytes) AS BIGINT) AS bytes, round(count(*) / 1000, 6) AS utilisation FROM entries GROUP BY ROLLUP (upstream_id)""",
        "entries",
    ),
)
def _(spark, sf):
    return en.cache_stats(cache_entries(spark, sf), FRESH, STALE, 1000, NOW)


@query(
    "entries_summary",
    compose(
        f"SELECT norm_key, query[1:120] AS query, upstream_id, context_id, cached_at, n_results, {CLASS} AS freshness FROM entries",
        "entries",
    ),
)
def _(spark, sf):
    return en.entries_summary(cache_entries(spark, sf), FRESH, STALE, NOW)


@query(
    "evict_plan",
    compose(
        """SELECT e.norm_key, context_id, CASE WHEN x.norm_key IS NULL THEN 'keep' ELSE 'evict' END AS action FROM entries e
        LEFT JOIN (SELECT norm_key FROM entries WHERE context_id = 'c1' AND starts_with(lower(query), 'key 1') AND age >= 10000
        ORDER BY cached_at, norm_key LIMIT 7) x USING (norm_key)""",
        "entries",
    ),
)
def _(spark, sf):
    plan = en.evict_plan(cache_entries(spark, sf), NOW, context="c1", prefix="KEY 1", older_than=10_000, max_entries=7)
    return plan.select("norm_key", "context_id", "action")


@query(
    "enforce_cap",
    compose(
        """SELECT norm_key, upstream_id, cached_at FROM entries
        QUALIFY row_number() OVER (PARTITION BY upstream_id ORDER BY cached_at DESC, norm_key) > 20""",
        "entries",
    ),
)
def _(spark, sf):
    return en.enforce_cap(cache_entries(spark, sf), 20).select("norm_key", "upstream_id", "cached_at")


@query("purge_expired", compose("SELECT norm_key, cached_at FROM entries WHERE age < 86400", "entries"))
def _(spark, sf):
    return en.purge_expired(cache_entries(spark, sf), NOW).select("norm_key", "cached_at")


@query("refresh_list", compose("SELECT norm_key, upstream_id FROM entries WHERE age >= jf AND age < jf + 7200", "entries"))
def _(spark, sf):
    return en.refresh_list(cache_entries(spark, sf), FRESH, STALE, NOW)


@query(
    "warm_plan",
    compose(
        """SELECT CAST(c AS INTEGER) AS concurrency, w AS wanted, h AS already_cached, w - h AS to_warm,
        CAST(ceil((w - h) / c) * 20 AS DOUBLE) AS estimated_ms FROM
        (SELECT count(*) AS w, count(e.norm_key) AS h FROM (SELECT DISTINCT sha256('ctx:' || context_id || ':key ' || key) AS norm_key
         FROM log) LEFT JOIN (SELECT norm_key FROM entries WHERE age < 86400) e USING (norm_key)), (VALUES (1), (4), (8)) AS v(c)""",
        "log", "entries",
    ),
)
def _(spark, sf):
    entries = cache_entries(spark, sf)
    return en.warm_plan(entries, en.purge_expired(entries, NOW), 20)


@query(
    "warm_entries",
    compose(
        """SELECT context_id, position, norm_key, place FROM (SELECT context_id, key AS position, norm_key,
            row_number() OVER (PARTITION BY context_id ORDER BY key, norm_key) AS place FROM entries WHERE n_results > 0 AND key <> 13)
        LEFT JOIN (SELECT context_id, count(*) AS used FROM entries WHERE age < 10800 GROUP BY context_id) USING (context_id)
        WHERE place <= 30 - coalesce(used, 0)""",
        "entries",
    ),
)
def _(spark, sf):
    entries = cache_entries(spark, sf)
    key = F.substring_index("query", " ", -1).cast("bigint")
    invalid = entries.filter((F.col("n_results") == 0) | (key == 13))
    existing = entries.filter(en.age_seconds(NOW) < 10_800)
    plan = entries.select("context_id", key.alias("position"), "norm_key")
    return en.warm_entries(plan, invalid, existing, 30)


@query(
    "entry_store_context",
    compose("SELECT norm_key, query, upstream_id, cached_at, extended_count FROM entries WHERE context_id = 'c2'", "entries"),
)
def _(spark, sf):
    """Written per context, read back for one."""
    path = work_dir(spark, "entries")
    entry_store.write_cache_entries(cache_entries(spark, sf), path)
    back = entry_store.read_cache_entries(spark, path, "c2")
    return back.select("norm_key", "query", "upstream_id", "cached_at", "extended_count")


@query(
    "distill",
    compose(
        """SELECT norm_key, context_id, cached_at FROM entries WHERE age <= 86400 AND age <= jf
        ORDER BY cached_at, norm_key LIMIT 100""",
        "entries",
    ),
)
def _(spark, sf):
    return entry_store.distill(cache_entries(spark, sf), NOW, FRESH, limit=100).select("norm_key", "context_id", "cached_at")


@query(
    "distill_documents",
    compose(
        """SELECT 'key-' || key || '-' || norm_key[1:8] || '.md' AS file_name, context_id,
        '# ' || query || chr(10) || chr(10) || '## Metadata' || chr(10) || chr(10) || '- **Context:** `' || context_id || '`' || chr(10)
        || '- **Upstream:** `' || upstream_id || '`' || chr(10) || '- **Hash:** `' || norm_key || '`' || chr(10) || '- **Cached at:** `'
        || strftime(cached_at, '%Y-%m-%dT%H:%M:%S.%f') || '000Z`' || chr(10)
        || CASE WHEN extended_count > 0 THEN '- **TTL extensions:** ' || extended_count || chr(10) ELSE '' END || chr(10)
        || '## Response' || chr(10) || chr(10) || '```json' || chr(10) || '{' || chr(10) || '  "key": ' || key || ',' || chr(10) || '  "took_ms": ' || took_ms || chr(10) || '}'
        || chr(10) || '```' || chr(10) AS body FROM entries WHERE age <= 86400""",
        "entries",
    ),
)
def _(spark, sf):
    chosen = entry_store.distill(cache_entries(spark, sf), NOW, FRESH, include_stale=True)
    return entry_store.distill_documents(chosen).select("file_name", "context_id", "body")


@query(
    "read_corpus",
    "SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, source AS category, lang AS topic FROM documents",
)
def _(spark, sf):
    """The documents written as JSON lines and read back with the fixed schema."""
    path = work_dir(spark, "corpus")
    fx.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("category"),
        F.col("lang").alias("topic"),
    ).write.json(path)
    return corpus.read_corpus(spark, path).select("id", "content", "category", "topic")


@query(
    "read_query_texts",
    """SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query FROM conversations
    WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""",
)
def _(spark, sf):
    """Messages as lines: user turns behind a tab-separated id, the others padded."""
    path = work_dir(spark, "lines")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    line = F.when(F.col("role") == "user", F.concat(F.col("conv_id").cast("string"), F.lit("\t"), flat)).otherwise(
        F.concat(F.lit("  "), flat, F.lit(" "))
    )
    fx.table(spark, sf, "conversations").select(line.alias("value")).write.text(path)
    return corpus.read_query_texts(spark, path)


@query(
    "read_trace",
    """SELECT 'q' || json_extract_string(props, '$.k') AS key, CASE WHEN event_type = 'view'
        THEN CAST('0x' || sha256('q' || json_extract_string(props, '$.k'))[1:15] AS BIGINT) ELSE user_id END AS cluster_id
    FROM events WHERE event_type <> 'error'""",
)
def _(spark, sf):
    """Events as JSON lines; errors lack the query, views lack the cluster."""
    path = work_dir(spark, "trace")
    kind = F.col("event_type")
    body = F.to_json(
        F.struct(
            F.when(kind != "error", F.concat(F.lit("q"), F.get_json_object("props", "$.k"))).alias("query"),
            F.when(kind != "view", F.col("user_id")).alias("cluster_id"),
        )
    )
    fx.table(spark, sf, "events").select(body.alias("value")).write.text(path)
    return traces.read_trace(spark, path)[0]


#: Bytes of text from which a response is cut into pages, and what a hit has besides its text.
PAGE_BYTES, HIT_BYTES = 1 << 20, 256


def _raw_responses(spark, sf, backend):
    """Raw responses per source, in pages: its documents in order of their ids as hits in the backend's shape."""
    d = fx.table(spark, sf, "documents")
    score = F.round(1 / (1 + F.col("n_chars") / 1000), 6)
    lang = F.col("lang")
    named = [
        F.when(lang == "en", F.col("text")).alias("content"),
        F.when(lang == "fr", F.col("text")).alias("text"),
        F.when(~lang.isin("en", "fr"), F.col("text")).alias("body"),
    ]
    # metadata of every JSON type
    extra = ["lang", F.col("n_chars").alias("size"), (F.col("doc_id") % 2 == 0).alias("even"), F.struct(F.array("doc_id").alias("ids")).alias("ref")]
    if backend == "elasticsearch":
        hit = F.struct(F.col("doc_id").cast("string").alias("_id"), score.alias("_score"), F.struct(*named, *extra).alias("_source"))
    elif backend == "meilisearch":
        hit = F.struct(F.when(lang != "de", F.col("doc_id")).alias("id"),
                       F.when(lang == "de", F.concat(F.lit("u"), F.col("doc_id").cast("string"))).alias("uid"),
                       score.alias("_rankingScore"), *named, *extra)
    elif backend == "milvus":
        hit = F.struct(F.col("doc_id").alias("id"), (1 - score).alias("distance"), F.struct(*named, *extra, F.array(score).alias("vector")).alias("entity"))
    else:
        hit = F.struct(F.col("doc_id").alias("id"), score.alias("score"), F.struct(*named, *extra).alias("payload"))
    hits = _paged(d.select("source", "doc_id", hit.alias("h"), score.alias("score"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")))
    listed = F.transform("hs", lambda x: x["h"])
    if backend == "elasticsearch":
        body = F.struct(F.struct(F.col("top").alias("max_score"), listed.alias("hits")).alias("hits"))
    else:
        body = F.struct(listed.alias({"meilisearch": "hits", "milvus": "data", "qdrant": "result"}[backend]))
    return hits.select(F.col("source").alias("query_id"), "offset", F.to_json(body).alias("response"))


def _paged(hits):
    """source, offset, top, hs: the hits of a source in order, in pages of about PAGE_BYTES; ``top`` is the best score of the whole source."""
    sized = hits.withColumn("bytes", F.col("bytes") + HIT_BYTES)
    ids = sized.groupBy(F.col("source").alias("_s"), F.col("doc_id").alias("_d")).agg(F.count("*").alias("_n"), F.sum("bytes").alias("_b"))
    upto = ordered_scan(ids, ["_s"], "_d", [], running_sum={"_rows": "_n", "_bytes": "_b"})
    starts = upto.select("_s", "_d", (F.col("_rows") - F.col("_n")).alias("_rows"), (F.col("_bytes") - F.col("_b")).alias("_bytes"))
    tops = sized.groupBy(F.col("source").alias("_t")).agg(F.max("score").alias("top"))
    joined = sized.join(starts, F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    ties = Window.partitionBy("_s", "_d").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = joined.select(
        "source", "h", (F.col("_rows") + F.count("*").over(ties) - 1).alias("pos"),
        F.floor((F.col("_bytes") + F.sum("bytes").over(ties) - F.col("bytes")) / PAGE_BYTES).alias("page"),
    )
    pages = placed.groupBy("source", "page").agg(F.min("pos").alias("offset"), F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("hs"))
    return pages.join(tops, F.col("source").eqNullSafe(F.col("_t"))).drop("_t")


PARSED = """SELECT source AS query_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank, {id} AS id,
    {score} AS score, text AS content, '{{"even":' || (doc_id % 2 = 0)::VARCHAR || ',"lang":"' || lang || '","ref":{{"ids":[' || doc_id || ']}},"size":'
    || n_chars || {uid} || '}}' AS metadata FROM (SELECT *, round(1 / (1 + n_chars / 1000), 6) AS s FROM documents)"""
BACKENDS = {
    "elasticsearch": ("doc_id::VARCHAR", "round(s / max(s) OVER (PARTITION BY source), 6)", "''"),
    "meilisearch": (
        "CASE WHEN lang = 'de' THEN 'u' || doc_id ELSE doc_id::VARCHAR END", "s",
        "CASE WHEN lang = 'de' THEN ',\"uid\":\"u' || doc_id || '\"' ELSE '' END",
    ),
    "milvus": ("doc_id::VARCHAR", "s", "''"),
    "qdrant": ("doc_id::VARCHAR", "s", "''"),
}


def _parsed(backend):
    return lambda spark, sf: backend_hits.parse_hits(_raw_responses(spark, sf, backend), backend)


for backend, (i, s, m) in BACKENDS.items():
    query(f"parse_{backend}", PARSED.format(id=i, score=s, uid=m))(_parsed(backend))
