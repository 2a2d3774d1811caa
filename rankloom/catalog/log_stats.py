"""Queries on the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog.base import query
from rankloom.catalog.ctes import CTE, compose
from rankloom.operators import inflight, logstats, percentiles

CTE["qstats"] = (
    ("log",),
    """SELECT key AS query_key, count(*) AS requests, count(*) FILTER (cache_status = 'hit') AS hits,
    count(*) FILTER (cache_status <> 'hit') AS misses, round(count(*) FILTER (cache_status = 'hit') / count(*), 6) AS hit_rate,
    round(floor(sum(us) / count(*)) / 1000, 6) AS avg_ms, max(us) / 1000 AS max_ms, min(us) / 1000 AS min_ms,
    min(ts) AS first_seen, max(ts) AS last_seen FROM (SELECT *, CAST(round(latency_ms * 1000) AS BIGINT) AS us FROM log) GROUP BY key""",
)


def stats(spark, sf):
    return logstats.query_stats(fx.request_log(spark, sf))


@query("query_stats", compose("SELECT * FROM qstats", "qstats"))
def _(spark, sf):
    return stats(spark, sf)


@query("query_stats_hashed", compose("SELECT sha256(query_key::VARCHAR) AS query_key, requests, hit_rate FROM qstats", "qstats"))
def _(spark, sf):
    return logstats.query_stats(fx.request_log(spark, sf), hash_only=True).select("query_key", "requests", "hit_rate")


@query("top_queries", compose("SELECT * FROM qstats ORDER BY requests DESC, query_key LIMIT 10", "qstats"))
def _(spark, sf):
    return logstats.top_queries(stats(spark, sf))


@query("slowest_queries", compose("SELECT * FROM qstats ORDER BY avg_ms DESC, query_key LIMIT 10", "qstats"))
def _(spark, sf):
    return logstats.top_queries(stats(spark, sf), by="avg_ms")


@query(
    "low_hit_rate",
    compose("SELECT * FROM qstats WHERE requests > 1 AND hit_rate < 0.4 ORDER BY hit_rate, query_key LIMIT 10", "qstats"),
)
def _(spark, sf):
    return logstats.low_hit_rate(stats(spark, sf), 0.4)


@query(
    "overall_stats",
    compose(
        """SELECT count(DISTINCT key) AS unique_queries, count(*) AS requests, count(*) FILTER (cache_status = 'hit') AS hits,
        round(count(*) FILTER (cache_status = 'hit') / count(*), 6) AS hit_rate,
        round(floor(sum(CAST(round(latency_ms * 1000) AS BIGINT)) / count(*)) / 1000, 6) AS avg_ms FROM log""",
        "log",
    ),
)
def _(spark, sf):
    return logstats.overall_stats(fx.request_log(spark, sf))


@query(
    "audit_stats",
    compose(
        """SELECT count(*) AS total, round(count(*) FILTER (success) / count(*), 6) AS success_rate,
        round(count(*) FILTER (cache_status = 'hit') / count(*), 6) AS hit_rate,
        CAST(floor(sum(CAST(floor(latency_ms) AS BIGINT)) / count(*)) AS BIGINT) AS avg_latency_ms FROM log""",
        "log",
    ),
)
def _(spark, sf):
    return logstats.audit_stats(fx.request_log(spark, sf))


@query(
    "audit_text",
    """SELECT doc_id, CASE WHEN strlen(text) > 200 THEN text[1:list_max(list_filter(range(0, 201), lambda i: strlen(text[1:i]) <= 200))] || '...'
        ELSE text END AS query FROM documents""",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", logstats.audit_text("text").alias("query"))


AUDIT = "request_id, ts, client_id, upstream_id, latency_ms, success"


@query("audit_failures", compose(f"SELECT {AUDIT} FROM log WHERE NOT success", "log"))
def _(spark, sf):
    return logstats.audit_select(fx.request_log(spark, sf), failures=True).select(*AUDIT.split(", "))


@query("audit_slow", compose(f"SELECT {AUDIT} FROM log WHERE latency_ms > 400", "log"))
def _(spark, sf):
    return logstats.audit_select(fx.request_log(spark, sf), slower_than_ms=400).select(*AUDIT.split(", "))


@query("audit_client", compose(f"SELECT {AUDIT} FROM log WHERE client_id = 8", "log"))
def _(spark, sf):
    return logstats.audit_select(fx.request_log(spark, sf), client_id=8).select(*AUDIT.split(", "))


@query("audit_recent", compose(f"SELECT {AUDIT} FROM log ORDER BY ts DESC, request_id DESC LIMIT 50", "log"))
def _(spark, sf):
    return logstats.audit_select(fx.request_log(spark, sf), recent=50).select(*AUDIT.split(", "))


TRAFFIC = """count(*) AS total, count(*) FILTER (cache_status = 'hit') AS hits, count(*) FILTER (cache_status = 'stale') AS stale,
    count(*) FILTER (cache_status = 'miss') AS misses, count(*) FILTER (miss_reason = 'not_in_cache') AS not_in_cache,
    count(*) FILTER (miss_reason = 'upstream_error') AS upstream_errors,
    round(count(*) FILTER (cache_status = 'hit') / count(*), 6) AS hit_rate,
    round(count(*) FILTER (miss_reason = 'upstream_error') / count(*), 6) AS error_rate,
    round(floor(sum(CAST(round(latency_ms * 1000) AS BIGINT)) / count(*)) / 1000, 6) AS avg_ms,
    min(latency_ms) AS min_ms, max(latency_ms) AS max_ms"""


@query(
    "traffic_snapshot",
    compose(f"SELECT context_id, upstream_id, {TRAFFIC} FROM log GROUP BY ROLLUP (context_id, upstream_id)", "log"),
)
def _(spark, sf):
    return logstats.traffic_snapshot(fx.request_log(spark, sf), ["context_id", "upstream_id"])


PS = "(VALUES (0.5), (0.9), (0.95), (0.99)) AS v(p)"
RANKED = """SELECT upstream_id, latency_ms, row_number() OVER (PARTITION BY upstream_id ORDER BY latency_ms) AS r,
    count(*) OVER (PARTITION BY upstream_id) AS n FROM log"""
PERCENTILES = {
    "nearest_rank": f"""SELECT upstream_id, CAST(p AS DOUBLE) AS p, latency_ms FROM r, {PS}
        WHERE r = greatest(1, least(n, ceil(CAST(p AS DOUBLE) * n)))""",
    "nearest_index": f"""SELECT upstream_id, CAST(p AS DOUBLE) AS p, latency_ms FROM r, {PS}
        WHERE r = least(n, floor((n - 1) * CAST(p AS DOUBLE) + 0.5) + 1)""",
    "linear": f"""SELECT upstream_id, CAST(p AS DOUBLE) AS p, round(quantile_cont(latency_ms, CAST(p AS DOUBLE)), 6) AS latency_ms
        FROM (SELECT upstream_id, 0.5 AS p, latency_ms FROM log) GROUP BY ALL""",
}
PERCENTILES["linear"] = " UNION ALL ".join(
    f"SELECT upstream_id, CAST({p} AS DOUBLE) AS p, round(quantile_cont(latency_ms, {p}), 6) AS latency_ms FROM log GROUP BY upstream_id"
    for p in (0.5, 0.9, 0.95, 0.99)
)


def _percentiles(method):
    def run(spark, sf):
        return percentiles.percentiles(
            fx.request_log(spark, sf), ["upstream_id"], "latency_ms", [0.5, 0.9, 0.95, 0.99], method
        )

    return run


for method, sql in PERCENTILES.items():
    query(f"percentiles_{method}", compose(sql, "log", r=RANKED))(_percentiles(method))


@query(
    "adaptive_timeout",
    compose(
        """SELECT upstream_id, p99_ms, round(least(30000.0, greatest(100.0, p99_ms * 2)), 6) AS timeout_ms FROM
        (SELECT upstream_id, latency_ms AS p99_ms FROM (SELECT upstream_id, latency_ms,
            row_number() OVER (PARTITION BY upstream_id ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY upstream_id) AS n
            FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY upstream_id ORDER BY ts DESC, request_id DESC) <= 1000))
            WHERE r = ceil(0.99 * n))""",
        "log",
    ),
)
def _(spark, sf):
    return percentiles.adaptive_timeout(fx.request_log(spark, sf))


@query(
    "context_stats",
    compose(
        """SELECT context_id, count(*) AS queries, count(*) FILTER (cache_status = 'hit') AS hits,
        count(*) FILTER (cache_status <> 'hit') AS misses, round(count(*) FILTER (cache_status = 'hit') / count(*), 6) AS hit_rate
        FROM log GROUP BY context_id""",
        "log",
    ),
)
def _(spark, sf):
    return logstats.context_stats(fx.request_log(spark, sf))


@query(
    "agent_usage",
    compose(
        """SELECT client_id, count(*) AS requests, count(*) FILTER (cache_status = 'hit') AS hits,
        count(*) FILTER (cache_status = 'miss') AS misses, count(*) FILTER (latency_ms > 450) AS rate_limited,
        count(*) FILTER (client_id % 3 <> 0 AND context_id NOT IN ('c0', 'c2')) AS context_denied FROM log GROUP BY client_id""",
        "log",
    ),
)
def _(spark, sf):
    log = fx.request_log(spark, sf).withColumn("rate_limited", F.col("latency_ms") > 450)
    everywhere = F.pmod("client_id", F.lit(3)) == 0
    agents = log.select("client_id").distinct().withColumn(
        "allowed", F.when(everywhere, F.array().cast("array<string>")).otherwise(F.array(F.lit("c0"), F.lit("c2")))
    )
    return logstats.agent_usage(log, agents)


@query(
    "mutation_stats",
    compose(
        """SELECT mutation, reason, context_id, count(*) AS mutations, CAST(sum(entries_affected) AS BIGINT) AS entries FROM
        (SELECT CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'evict' WHEN 'purchase' THEN 'invalidate' ELSE 'warmup' END
            AS mutation, CASE WHEN event_type = 'error' THEN CASE client_id % 4 WHEN 0 THEN 'ttl' WHEN 1 THEN 'capacity'
            WHEN 2 THEN 'manual' ELSE 'version_drift' END ELSE 'none' END AS reason, context_id, 1 + request_id % 3 AS entries_affected
         FROM log) GROUP BY GROUPING SETS ((mutation, reason), (context_id), ())""",
        "log",
    ),
)
def _(spark, sf):
    kind, who = F.col("event_type"), F.pmod("client_id", F.lit(4))
    log = fx.request_log(spark, sf).select(
        F.when(kind == "signup", "insert").when(kind == "error", "evict").when(kind == "purchase", "invalidate")
        .otherwise("warmup").alias("mutation"),
        F.when(kind != "error", "none").when(who == 0, "ttl").when(who == 1, "capacity").when(who == 2, "manual")
        .otherwise("version_drift").alias("reason"),
        "context_id",
        (1 + F.pmod("request_id", F.lit(3))).alias("entries_affected"),
    )
    return logstats.mutation_stats(log)


@query(
    "embed_stats",
    compose(
        """SELECT count(*) AS lookups, count(*) FILTER (s = 'cached') AS hits, count(*) FILTER (s = 'computed') AS computed,
        count(*) FILTER (s = 'coalesced') AS coalesced, round(count(*) FILTER (s = 'cached') / count(*), 6) AS hit_rate FROM
        (SELECT CASE cache_status WHEN 'hit' THEN 'cached' WHEN 'stale' THEN 'coalesced' ELSE 'computed' END AS s FROM log)""",
        "log",
    ),
)
def _(spark, sf):
    status = F.col("cache_status")
    return logstats.embed_stats(
        fx.request_log(spark, sf).withColumn(
            "source", F.when(status == "hit", "cached").when(status == "stale", "coalesced").otherwise("computed")
        )
    )


@query(
    "upstream_rates",
    compose(
        """SELECT upstream_id, count(*) AS requests, count(*) FILTER (NOT success) AS failures,
        round(count(*) FILTER (NOT success) / count(*), 6) AS failure_rate, round(count(*) / (SELECT count(*) FROM log), 6) AS share
        FROM log GROUP BY upstream_id""",
        "log",
    ),
)
def _(spark, sf):
    return logstats.upstream_rates(fx.request_log(spark, sf))


LEADERS = """WITH RECURSIVE r AS (SELECT event_type, ts, request_id, epoch_us(ts) AS t0,
    epoch_us(ts) + CAST(round(latency_ms * 10 * 1000000) AS BIGINT) AS until FROM log),
    chain AS (SELECT event_type, arg_min(t0, {'a': t0, 'b': request_id}) AS t0, arg_min(until, {'a': t0, 'b': request_id}) AS until
    FROM r GROUP BY event_type UNION ALL SELECT r.event_type, arg_min(r.t0, {'a': r.t0, 'b': r.request_id}),
    arg_min(r.until, {'a': r.t0, 'b': r.request_id}) FROM chain JOIN r ON r.event_type = chain.event_type AND r.t0 >= chain.until
    GROUP BY r.event_type) """
COALESCED = """SELECT request_id, event_type, CASE WHEN l.t0 IS NULL THEN 'waiter' ELSE 'leader' END AS role,
    max(l.t0) OVER (PARTITION BY event_type ORDER BY r.t0, request_id) AS leader_us FROM r LEFT JOIN chain l USING (event_type, t0)"""


def _recursive(body: str) -> str:
    """The log fragment and the recursion in one WITH clause."""
    return LEADERS.replace("WITH RECURSIVE", f"WITH RECURSIVE log AS ({CTE['log'][1]}),") + body


def _coalesced(spark, sf):
    """Requests of one kind as one key: ten times the latency keeps many in flight."""
    log = fx.request_log(spark, sf).select(
        "request_id", "ts", "event_type", (F.col("latency_ms") * 10).alias("seconds")
    )
    return inflight.coalesce_requests(log, "event_type", "seconds")


@query("coalesce_requests", _recursive(COALESCED))
def _(spark, sf):
    return _coalesced(spark, sf).select("request_id", "event_type", "role", F.unix_micros("leader_at").alias("leader_us"))


@query(
    "dedup_factor",
    _recursive(
        f"""SELECT count(*) AS requests, count(*) FILTER (role = 'leader') AS leaders,
        round(count(*) / count(*) FILTER (role = 'leader'), 6) AS factor FROM ({COALESCED})"""
    ),
)
def _(spark, sf):
    return inflight.dedup_factor(_coalesced(spark, sf))


SPANS = """SELECT query_key, origin_node_id AS origin, timestamp_ms AS start_ms, nt AS end_ms, CASE WHEN ne IS NULL THEN 'open'
        WHEN ne = 'insert' THEN 'inserted' WHEN ne = 'fetch_cancel' THEN 'cancelled' ELSE 'replaced' END AS outcome FROM
        (SELECT *, lead(event_type) OVER w AS ne, lead(timestamp_ms) OVER w AS nt FROM cdc
         WHERE event_type IN ('fetch_start', 'fetch_cancel', 'insert')
         WINDOW w AS (PARTITION BY query_key ORDER BY timestamp_ms, origin_node_id, sequence)) WHERE event_type = 'fetch_start'"""


@query(
    "fetch_spans",
    compose(
        SPANS,
        "cdc",
    ),
)
def _(spark, sf):
    return inflight.fetch_spans(fx.cdc_events(spark, sf))


@query(
    "wait_for_fetches",
    compose(
        """SELECT request_id, CASE WHEN NOT w THEN 'proceed' WHEN e - at_ms <= 600000 THEN 'served' ELSE 'timed_out' END AS outcome,
        CAST(CASE WHEN NOT w THEN 0 WHEN e - at_ms <= 600000 THEN e - at_ms ELSE 600000 END AS BIGINT) AS waited_ms FROM
        (SELECT *, open IS NOT NULL AND coalesce(open.e > at_ms, true) AND open.o <> node AS w, open.e AS e FROM
        (SELECT *, last_value(span IGNORE NULLS) OVER (PARTITION BY query_key ORDER BY at_ms, r, node, request_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM
        (SELECT request_id, key::VARCHAR AS query_key, 'n' || (client_id % 3) AS node, epoch_us(ts) // 1000 AS at_ms, 1 AS r, NULL AS span FROM log
         UNION ALL SELECT NULL, query_key, origin, start_ms, 0, {'o': origin, 'e': end_ms} FROM spans)) WHERE r = 1)""",
        "log", "cdc", spans=SPANS,
    ),
)
def _(spark, sf):
    """Every logged request as one of its node, against the fetches in the change stream; ten minutes at most."""
    requests = fx.request_log(spark, sf).select(
        "request_id", F.col("key").cast("string").alias("query_key"),
        F.concat(F.lit("n"), F.pmod("client_id", F.lit(3)).cast("string")).alias("node_id"), F.unix_millis("ts").alias("at_ms"),
    )
    return inflight.wait_for_fetches(requests, inflight.fetch_spans(fx.cdc_events(spark, sf)), 600_000)
