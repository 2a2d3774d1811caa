"""Queries on drift, versions, health and performance history."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog import scoping  # noqa: F401  (adds the hit fragments)
from rankloom.catalog.base import query
from rankloom.catalog.ctes import CTE, bm25, compose
from rankloom.operators import drift, health, perf
from rankloom.operators.search_text import text_search


def snapshots(spark, sf):
    """Hits before and after the documents of low quality were taken out of the corpus."""
    docs, q = fx.corpus(spark, sf), fx.benchmark_queries(spark, sf)
    bad = fx.table(spark, sf, "labels").filter("quality = 0").select(F.col("doc_id").alias("id"))
    kept = docs.join(bad, "id", "left_anti")
    return text_search(q, docs, top_k=10), text_search(q, kept, top_k=10)


CTE["docs_new"] = (("docs",), "SELECT * FROM docs WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
bm25("n_", "qtext", "docs_new")
CTE["hits_new"] = (
    ("n_bm",),
    """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score
    FROM n_bm QUALIFY rank <= 10""",
)
LEVEL = """CASE WHEN n_old = 0 AND n_new = 0 THEN 'none' WHEN n_old = 0 OR n_new = 0 THEN 'major'
    WHEN overlap >= 0.9 AND score_change < 0.05 THEN 'none' WHEN overlap >= 0.7 AND score_change < 0.15 THEN 'minor'
    WHEN overlap >= 0.5 AND score_change < 0.3 THEN 'moderate' WHEN overlap >= 0.3 THEN 'significant' ELSE 'major' END"""


@query(
    "detect_drift",
    compose(
        f"""SELECT *, {LEVEL} AS level FROM (SELECT query_id, count(o.score) AS n_old, count(n.score) AS n_new,
            round(count(o.score + n.score) / greatest(count(o.score), count(n.score)), 6) AS overlap,
            round(coalesce(avg(abs(o.score - n.score)), 1), 6) AS score_change
            FROM hits10 o FULL JOIN hits_new n USING (query_id, id) GROUP BY query_id)""",
        "hits10", "hits_new",
    ),
)
def _(spark, sf):
    return drift.detect_drift(*snapshots(spark, sf))


OBS = """SELECT upstream_id, ts, request_id AS seq, CASE event_type WHEN 'view' THEN 'none' WHEN 'click' THEN 'minor'
    WHEN 'purchase' THEN 'moderate' WHEN 'signup' THEN 'significant' ELSE 'major' END AS level FROM log"""


def drift_observations(spark, sf):
    """Events as drift levels of their upstream."""
    kind = F.col("event_type")
    return fx.request_log(spark, sf).select(
        "upstream_id", "ts", F.col("request_id").alias("seq"),
        F.when(kind == "view", "none").when(kind == "click", "minor").when(kind == "purchase", "moderate")
        .when(kind == "signup", "significant").otherwise("major").alias("level"),
    )


@query(
    "drift_window",
    compose(
        """SELECT upstream_id, ts, seq, level, count(*) OVER w AS total, count(*) FILTER (i = 0) OVER w AS n_none,
        count(*) FILTER (i = 1) OVER w AS n_minor, count(*) FILTER (i = 2) OVER w AS n_moderate, count(*) FILTER (i = 3) OVER w AS n_significant,
        count(*) FILTER (i = 4) OVER w AS n_major, round(avg(i) OVER w, 6) AS mean_level, count(*) FILTER (i > 2) OVER w >= 45 AS alert,
        ['none', 'minor', 'moderate', 'significant', 'major'][max(i) OVER w + 1] AS max_level
        FROM (SELECT *, list_position(['none', 'minor', 'moderate', 'significant', 'major'], level) - 1 AS i FROM o)
        WINDOW w AS (PARTITION BY upstream_id ORDER BY ts, seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
        "log", o=OBS,
    ),
)
def _(spark, sf):
    return drift.drift_window(drift_observations(spark, sf), alert_count=45)


@query(
    "version_changes",
    compose(
        """SELECT upstream_id, observed_at, version, doc_count, coalesce(abs(doc_count - lag(doc_count) OVER w) >
            floor(greatest(doc_count, lag(doc_count) OVER w) * 0.01), false) OR coalesce(version <> lag(version) OVER w, false) AS changed
        FROM (SELECT upstream_id, CAST(d AS INTEGER) AS observed_at, CASE WHEN d % 5 <> 0 THEN 'w' || (d // 7) END AS version,
              CAST(sum(n) OVER (PARTITION BY upstream_id ORDER BY d) AS BIGINT) AS doc_count
              FROM (SELECT upstream_id, day(ts) AS d, count(*) AS n FROM log GROUP BY ALL))
        WINDOW w AS (PARTITION BY upstream_id ORDER BY observed_at)""",
        "log",
    ),
)
def _(spark, sf):
    """One poll per upstream and day; the document count is that of all events so far."""
    from pyspark.sql import Window

    days = fx.request_log(spark, sf).groupBy("upstream_id", F.dayofmonth("ts").alias("observed_at")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("upstream_id").orderBy("observed_at")
    d = F.col("observed_at")
    polls = days.select(
        "upstream_id", "observed_at",
        F.when(F.pmod(d, F.lit(5)) != 0, F.concat(F.lit("w"), F.floor(d / 7).cast("string"))).alias("version"),
        F.lit(None).cast("string").alias("corpus_hash"),
        F.sum("n").over(so_far).alias("doc_count"),
        F.lit(None).cast("bigint").alias("last_modified"),
    )
    return drift.version_changes(polls).select("upstream_id", "observed_at", "version", "doc_count", "changed")


def outcomes(spark, sf):
    return fx.request_log(spark, sf).select("upstream_id", "ts", F.col("request_id").alias("seq"), "success")


HEALTH = """SELECT upstream_id, ts, seq, success, fs AS failure_streak, ss AS success_streak, CASE WHEN last_value(flag IGNORE NULLS) OVER
    (PARTITION BY upstream_id ORDER BY ts, seq) = 1 THEN 'offline' WHEN n >= 10 AND fs = 0 AND failed / n > 0.1 THEN 'degraded' ELSE 'online' END
    AS state FROM (SELECT *, CASE WHEN NOT success AND fs >= 3 THEN 1 WHEN success AND ss >= 2 THEN 0 END AS flag FROM
    (SELECT *, n - coalesce(max(n) FILTER (success) OVER v, 0) AS fs, n - coalesce(max(n) FILTER (NOT success) OVER v, 0) AS ss FROM
    (SELECT upstream_id, ts, request_id AS seq, success, row_number() OVER u AS n, count(*) FILTER (NOT success) OVER u AS failed FROM log
     WINDOW u AS (PARTITION BY upstream_id ORDER BY ts, request_id)) WINDOW v AS (PARTITION BY upstream_id ORDER BY n)))"""


@query("health_timeline", compose(HEALTH, "log"))
def _(spark, sf):
    return health.health_timeline(outcomes(spark, sf))


@query(
    "fleet_summary",
    compose(
        """SELECT state, count(*) AS upstreams FROM (SELECT upstream_id, arg_max(state, {'a': ts, 'b': seq}) AS state FROM h
        WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY upstream_id) GROUP BY state""",
        "log", h=HEALTH,
    ),
)
def _(spark, sf):
    return health.fleet_summary(health.health_timeline(outcomes(spark, sf)), "2024-01-15 12:00:00")


# Gaps between the requests of an upstream are minutes, so the durations are hours here.
CIRCUIT = health.CircuitConfig(failure_threshold=3, open_seconds=1800, window_seconds=7200)
STEPS = """o AS (SELECT upstream_id, ts, request_id AS seq, success, epoch_us(ts) AS t,
    row_number() OVER (PARTITION BY upstream_id ORDER BY ts, request_id) AS r FROM log)"""
CIRCUIT_SQL = f"""WITH RECURSIVE log AS ({CTE['log'][1]}), {STEPS},
    s AS (SELECT upstream_id, seq, t, r, CAST(CASE WHEN success THEN 0 ELSE 1 END AS BIGINT) AS fails, CAST(0 AS BIGINT) AS trials,
        CAST(NULL AS BIGINT) AS opened, t AS since, 'closed' AS state, true AS admitted FROM o WHERE r = 1
    UNION ALL SELECT upstream_id, seq, t, r,
        CASE WHEN q = 'closed' THEN CASE WHEN success THEN 0 WHEN t - since >= 7200000000 THEN 1 ELSE fails + 1 END
             WHEN q = 'half_open' AND success AND tr + 1 >= 2 THEN 0 ELSE fails END,
        CASE WHEN q = 'half_open' THEN CASE WHEN success AND tr + 1 < 2 THEN tr + 1 ELSE 0 END WHEN q = 'open' THEN tr ELSE 0 END,
        CASE WHEN q = 'closed' AND NOT success AND CASE WHEN t - since >= 7200000000 THEN 1 ELSE fails + 1 END >= 3 THEN t
             WHEN q = 'half_open' AND NOT success THEN t WHEN q = 'half_open' AND tr + 1 >= 2 THEN NULL ELSE opened END,
        CASE WHEN q = 'closed' AND NOT success AND t - since >= 7200000000 THEN t
             WHEN q = 'half_open' AND success AND tr + 1 >= 2 THEN t ELSE since END,
        CASE WHEN q = 'open' THEN 'open' WHEN q = 'half_open' THEN CASE WHEN NOT success THEN 'open' WHEN tr + 1 >= 2 THEN 'closed' ELSE 'half_open' END
             WHEN NOT success AND CASE WHEN t - since >= 7200000000 THEN 1 ELSE fails + 1 END >= 3 THEN 'open' ELSE 'closed' END,
        q <> 'open'
    FROM (SELECT o.upstream_id, o.seq, o.t, o.r, o.success, s.fails, s.opened, s.since,
            CASE WHEN s.state = 'open' AND o.t - s.opened >= 1800000000 THEN 0 ELSE s.trials END AS tr,
            CASE WHEN s.state = 'open' AND o.t - s.opened >= 1800000000 THEN 'half_open' ELSE s.state END AS q
          FROM s JOIN o ON o.upstream_id = s.upstream_id AND o.r = s.r + 1))
    SELECT upstream_id, seq, state, admitted FROM s"""


@query("circuit_timeline", CIRCUIT_SQL)
def _(spark, sf):
    return health.circuit_timeline(outcomes(spark, sf), CIRCUIT).select("upstream_id", "seq", "state", "admitted")


RESILIENCE = health.ResilienceConfig(degraded_after=3, offline_after=4, healthy_after=3, window_seconds=7200)
RESILIENCE_SQL = f"""WITH RECURSIVE log AS ({CTE['log'][1]}), {STEPS},
    s AS (SELECT upstream_id, seq, t, r, CAST(CASE WHEN success THEN 0 ELSE 1 END AS BIGINT) AS fails,
        CAST(CASE WHEN success THEN 0 ELSE 1 END AS BIGINT) AS bad, CAST(CASE WHEN success THEN 1 ELSE 0 END AS BIGINT) AS good, t AS since,
        CAST(10 AS DOUBLE) AS rps, 'healthy' AS state FROM o WHERE r = 1
    UNION ALL SELECT upstream_id, seq, t, r,
        CASE WHEN success THEN 0 WHEN state = 'healthy' THEN CASE WHEN nf >= 3 THEN 0 ELSE nf END ELSE fails END,
        CASE WHEN success THEN 0 ELSE bad + 1 END,
        CASE WHEN NOT success THEN 0 WHEN state = 'offline' THEN 0 WHEN state = 'degraded' AND good + 1 >= 3 THEN 0 ELSE good + 1 END,
        CASE WHEN success AND state = 'degraded' AND good + 1 >= 3 THEN t WHEN NOT success AND state = 'healthy' AND t - since >= 7200000000 THEN t
             ELSE since END,
        CASE WHEN success AND state = 'degraded' AND good + 1 < 3 THEN least(1000.0, rps + 5) WHEN success AND state IN ('degraded', 'offline') THEN 10
             WHEN NOT success AND state = 'healthy' AND nf >= 3 THEN 10 ELSE rps END,
        CASE WHEN success THEN CASE WHEN state = 'offline' THEN 'degraded' WHEN state = 'degraded' AND good + 1 >= 3 THEN 'healthy' ELSE state END
             ELSE CASE WHEN state = 'healthy' AND nf >= 3 THEN 'degraded' WHEN state = 'degraded' AND bad + 1 >= 4 THEN 'offline' ELSE state END END
    FROM (SELECT o.upstream_id, o.seq, o.t, o.r, o.success, s.fails, s.bad, s.good, s.since, s.rps, s.state,
            CASE WHEN o.t - s.since >= 7200000000 THEN 1 ELSE s.fails + 1 END AS nf
          FROM s JOIN o ON o.upstream_id = s.upstream_id AND o.r = s.r + 1))
    SELECT upstream_id, seq, state, CASE state WHEN 'healthy' THEN 3.4028234663852886e38 WHEN 'degraded' THEN rps ELSE 0 END AS rps_limit FROM s"""


@query("resilience_timeline", RESILIENCE_SQL)
def _(spark, sf):
    out = health.resilience_timeline(outcomes(spark, sf), RESILIENCE)
    return out.select("upstream_id", "seq", "state", "rps_limit")


def bench_runs(spark, sf):
    """Mean value per kind of event and day as a benchmark history."""
    log = fx.request_log(spark, sf)
    return log.groupBy(F.col("event_type").alias("bench"), F.dayofmonth("ts").alias("run")).agg(
        F.round(F.avg("latency_ms"), 6).alias("mean"),
        F.round(F.stddev("latency_ms") / F.sqrt(F.count("*")), 6).alias("se"),
    )


RUNS = """SELECT event_type AS bench, CAST(day(ts) AS INTEGER) AS run, round(avg(latency_ms), 6) AS mean,
    round(stddev(latency_ms) / sqrt(count(*)), 6) AS se FROM log GROUP BY event_type, day(ts)"""
JUDGED = """SELECT bench, run, mean, round(pct, 6) AS change_pct, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high,
    CASE WHEN pct IS NULL THEN 'no_main' WHEN lo >= {limit} THEN 'regression' WHEN hi <= -{limit} THEN 'improvement' WHEN lo IS NOT NULL
    THEN 'inconclusive' WHEN pct >= {limit} THEN 'regression' WHEN pct <= -{limit} THEN 'improvement' ELSE 'ok' END AS status FROM
    (SELECT *, (mean - bm) / bm * 100 AS pct, (mean - bm - 1.96 * sqrt(se * se + bs * bs)) / bm * 100 AS lo,
            (mean - bm + 1.96 * sqrt(se * se + bs * bs)) / bm * 100 AS hi FROM joined WHERE bm IS NULL OR bm > 0)"""


def _against_previous(spark, sf, limit):
    """Every run judged against the run before it, run and bench together as the bench."""
    r = bench_runs(spark, sf)

    def named(shift):
        return r.select(
            F.concat_ws("@", "bench", (F.col("run") + shift).cast("string")).alias("bench"), "mean", "se"
        )

    out = perf.regressions(named(0), named(1), limit)
    parts = F.split("bench", "@")
    return out.withColumns({"run": parts[1].cast("int"), "bench": parts[0]})


JOINED = "SELECT a.*, b.mean AS bm, b.se AS bs FROM runs a LEFT JOIN runs b ON b.bench = a.bench AND b.run = a.run - 1"


@query(
    "regressions",
    compose(
        "SELECT bench, run, mean, change_pct, ci_low, ci_high, status FROM j",
        "log", runs=RUNS, joined=JOINED, j=JUDGED.format(limit=15),
    ),
)
def _(spark, sf):
    return _against_previous(spark, sf, 15.0)


TREND = """SELECT bench, run, mean, prev_mean, round((mean - prev_mean) / prev_mean * 100, 6) AS change_pct FROM
    (SELECT *, lag(mean) OVER (PARTITION BY bench ORDER BY run) AS prev_mean FROM runs) WHERE prev_mean > 0"""


@query("trend", compose(f"SELECT bench, run, mean, prev_mean, change_pct FROM ({TREND})", "log", runs=RUNS))
def _(spark, sf):
    return perf.trend(bench_runs(spark, sf))


@query(
    "top_movers",
    compose(
        """SELECT run, arg_max(bench, {'a': abs(change_pct), 'b': bench}) AS bench, arg_max(change_pct, {'a': abs(change_pct), 'b': bench})
        AS change_pct FROM t GROUP BY run""",
        "log", runs=RUNS, t=TREND,
    ),
)
def _(spark, sf):
    return perf.top_movers(perf.trend(bench_runs(spark, sf)))


@query(
    "chronic",
    compose(
        """SELECT bench, run, change_pct, 3 AS consecutive_runs FROM (SELECT *, lag(change_pct, 1) OVER w AS p1, lag(change_pct, 2) OVER w AS p2
        FROM (SELECT * FROM j WHERE status <> 'no_main') WINDOW w AS (PARTITION BY bench ORDER BY run)) WHERE status = 'regression' AND p1 > 0 AND p2 > 0""",
        "log", runs=RUNS, joined=JOINED, j=JUDGED.replace("1.96", "0.1").format(limit=1),
    ),
)
def _(spark, sf):
    """Rises beyond a tenth of the error as regressions, since the means move little from day to day."""
    runs = bench_runs(spark, sf)
    named = [
        runs.select(F.concat_ws("@", "bench", (F.col("run") + s).cast("string")).alias("bench"), "mean", "se") for s in (0, 1)
    ]
    judged = perf.regressions(named[0], named[1], 1.0, width=0.1).filter(F.col("status") != "no_main")
    parts = F.split("bench", "@")
    return perf.chronic(judged.withColumns({"run": parts[1].cast("int"), "bench": parts[0]}))
