"""Queries on sweeps, token buckets and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog.base import query
from rankloom.catalog.ctes import compose
from rankloom.catalog.fusion import local_and_remote
from rankloom.operators import sweeps


@query(
    "cascade_sweep",
    compose(
        """SELECT query_id, CAST(t AS DOUBLE) AS threshold, any_value(u) FILTER (r = hit) AS chosen,
        string_agg(u, ',' ORDER BY r) FILTER (r <= coalesce(hit, n)) AS tried, coalesce(any_value(hit) > 1, false) AS cascaded,
        round(sum(latency) FILTER (r <= coalesce(hit, n)), 6) AS total_latency_ms FROM (SELECT *,
            min(r) FILTER (score >= t AND results >= 2) OVER (PARTITION BY query_id, t) AS hit, count(*) OVER (PARTITION BY query_id, t) AS n
            FROM p, (VALUES (0.1), (0.3), (0.5), (0.8)) AS v(t)) GROUP BY query_id, t""",
        p="""SELECT event_id // 5 AS query_id, 'leg' || (event_id % 5) AS u, value / 500 AS score, user_id % 7 AS results, value AS latency,
            row_number() OVER (PARTITION BY event_id // 5 ORDER BY user_id % 3, 'leg' || (event_id % 5)) AS r FROM events QUALIFY r <= 3""",
    ),
)
def _(spark, sf):
    probes = fx.table(spark, sf, "events").select(
        F.expr("event_id div 5").alias("query_id"),
        F.concat(F.lit("leg"), F.pmod("event_id", F.lit(5)).cast("string")).alias("upstream_id"),
        F.pmod("user_id", F.lit(3)).alias("priority"),
        (F.col("value") / 500).alias("best_score"),
        F.pmod("user_id", F.lit(7)).alias("result_count"),
        F.col("value").alias("latency_ms"),
    )
    return sweeps.cascade_sweep(probes, [0.1, 0.3, 0.5, 0.8], min_results=2, max_depth=3)


@query(
    "federated_sweep",
    compose(
        """SELECT query_id, w AS weight, count(*) FILTER (side = 0) AS local_count, count(*) FILTER (side = 1) AS remote_count,
        arg_min(id, r) AS top_id, string_agg(id, ',' ORDER BY r) AS ordered_ids FROM (SELECT *, CAST(t AS DOUBLE) AS w,
            row_number() OVER (PARTITION BY query_id, t ORDER BY round(score * CASE side WHEN 0 THEN CAST(t AS DOUBLE)
            ELSE 1 - CAST(t AS DOUBLE) END, 6) DESC, side, id) AS r FROM both_, (VALUES (0.3), (0.5), (0.7)) AS v(t)) WHERE r <= 6 GROUP BY query_id, w""",
        "both_",
    ),
)
def _(spark, sf):
    _, local, remote = local_and_remote(spark, sf)
    hits = local.withColumn("source", F.lit("local")).unionByName(remote.withColumn("source", F.lit("remote")))
    return sweeps.federated_sweep(hits.drop("rank"), top_k=6)


RATES = [(1 / 3600, 1.0), (1 / 7200, 5.0)]
BUCKET = """WITH RECURSIVE a AS (SELECT event_id AS request_id, user_id AS client_id, epoch_us(ts) AS t,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    g(rps, burst) AS (VALUES (1 / CAST(3600 AS DOUBLE), CAST(1 AS DOUBLE)), (1 / CAST(7200 AS DOUBLE), CAST(5 AS DOUBLE))),
    st AS (SELECT request_id, client_id, t, r, rps, burst, true AS allowed, burst - 1 AS tokens FROM a, g WHERE r = 1 UNION ALL
        SELECT request_id, client_id, t, r, rps, burst, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END FROM
        (SELECT a.request_id, a.client_id, a.t, a.r, rps, burst, least(burst, tokens + (a.t - st.t) / 1000000 * rps) AS have
         FROM st JOIN a ON a.client_id = st.client_id AND a.r = st.r + 1))
    SELECT request_id, client_id, round(rps, 6) AS rps, burst, allowed, round(tokens, 6) AS tokens FROM st"""


@query("token_bucket", BUCKET)
def _(spark, sf):
    arrivals = fx.request_log(spark, sf).select("request_id", "client_id", "ts")
    out = sweeps.token_bucket(arrivals, "client_id", RATES)
    return out.select("request_id", "client_id", F.round("rps", 6).alias("rps"), "burst", "allowed", "tokens")


def daily_runs(spark, sf):
    """One run per kind of event and day; quiet days lack a parameter, busy ones have an extra metric."""
    log = fx.request_log(spark, sf)
    day = F.dayofmonth("ts")
    runs = log.groupBy(F.col("event_type").alias("session_id"), day.alias("seq")).agg(
        F.count("*").alias("n"), F.max("key").alias("k"), F.countDistinct("client_id").alias("u")
    )
    s = F.col("n").cast("string")
    busy = F.pmod("seq", F.lit(3)) == 0
    return runs.select(
        "session_id",
        F.concat("session_id", F.lit("-"), F.col("seq").cast("string")).alias("run_id"),
        "seq",
        (F.pmod("seq", F.lit(4)) == 1).alias("selected"),
        F.map_filter(F.create_map(F.lit("max_key"), F.col("k").cast("string"), F.lit("users"), F.when(busy, F.col("u").cast("string"))),
                     lambda _, v: v.isNotNull()).alias("params"),
        F.create_map(F.lit("requests"), s).alias("metrics"),
    )


RUNS = """SELECT event_type AS session_id, event_type || '-' || day(ts) AS run_id, day(ts) AS seq, day(ts) % 4 = 1 AS selected,
    max(key)::VARCHAR AS max_key, CASE WHEN day(ts) % 3 = 0 THEN count(DISTINCT client_id)::VARCHAR END AS users, count(*)::VARCHAR AS requests
    FROM log GROUP BY event_type, day(ts)"""


@query(
    "compare_runs",
    compose(
        """SELECT * FROM (SELECT a, b, part, key, max(va) AS value_a, max(vb) AS value_b FROM (
            SELECT x.run_id AS a, y.run_id AS b, unnest([{'part': 'params', 'key': 'max_key', 'va': x.max_key, 'vb': y.max_key},
                {'part': 'params', 'key': 'users', 'va': x.users, 'vb': y.users},
                {'part': 'metrics', 'key': 'requests', 'va': x.requests, 'vb': y.requests}], recursive := true)
            FROM r x JOIN r y ON x.session_id = y.session_id AND y.seq = x.nseq) GROUP BY ALL) WHERE value_a IS DISTINCT FROM value_b""",
        "log", r0=RUNS, r="SELECT *, lead(seq) OVER (PARTITION BY session_id ORDER BY seq) AS nseq FROM r0",
    ),
)
def _(spark, sf):
    runs = daily_runs(spark, sf)
    return sweeps.compare_runs(runs, sweeps.consecutive_runs(runs))


@query(
    "selected_run",
    compose("SELECT session_id, arg_max(run_id, {'a': selected, 'b': seq}) AS run_id FROM r GROUP BY session_id", "log", r=RUNS),
)
def _(spark, sf):
    return sweeps.selected_run(daily_runs(spark, sf))
