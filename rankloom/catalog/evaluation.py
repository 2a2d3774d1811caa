"""Queries on evaluation and tuning jobs."""

from __future__ import annotations


from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog.base import query
from rankloom.catalog.ctes import CTE, NOT_WORD, SPACE, compose
from rankloom.catalog.health import snapshots
from rankloom.catalog.scoping import hits_with_content
from rankloom.operators import evaluation as ev
from rankloom.operators.search_text import text_search
from rankloom.operators.text_index import build_text_index
from rankloom.plans import tuning

MOVES = """SELECT query_id, id, CASE WHEN b.rank IS NULL THEN 'new' WHEN t.rank IS NULL THEN 'evicted' WHEN t.rank < b.rank THEN 'up'
    WHEN t.rank > b.rank THEN 'down' ELSE 'stable' END AS status, b.rank AS baseline_rank, t.rank AS tuned_rank,
    coalesce(b.score, 0) AS baseline_score, coalesce(t.score, 0) AS tuned_score, round(coalesce(t.score, 0) - coalesce(b.score, 0), 6) AS score_delta
    FROM (SELECT * FROM {base} WHERE rank <= {k}) b FULL JOIN (SELECT * FROM {tuned} WHERE rank <= {k}) t USING (query_id, id)"""
VERDICTS = """SELECT *, CASE WHEN evicted > 0 THEN 'degraded' WHEN new > 0 AND overlap > 0 THEN 'improved' WHEN new > 0 THEN 'changed'
    ELSE 'unchanged' END AS verdict FROM (SELECT query_id, count(*) FILTER (status = 'evicted') AS evicted, count(*) FILTER (status = 'new')
    AS new, count(*) FILTER (status NOT IN ('new', 'evicted')) AS overlap FROM mv GROUP BY query_id)"""


@query("movements", compose(MOVES.format(base="hits10", tuned="hits_new", k=8), "hits10", "hits_new"))
def _(spark, sf):
    return ev.movements(*snapshots(spark, sf), 8)


@query("verdicts", compose(VERDICTS, "hits10", "hits_new", mv=MOVES.format(base="hits10", tuned="hits_new", k=8)))
def _(spark, sf):
    return ev.verdicts(ev.movements(*snapshots(spark, sf), 8))


def answers(spark, sf):
    """Benchmark passages as answers; their five best documents are expected."""
    q, docs = fx.benchmark_queries(spark, sf), fx.corpus(spark, sf)
    expected = text_search(q, docs, top_k=5).select("query_id", "id")
    return q.select("query_id", F.col("query").alias("answer")), expected, docs


CTE["docscores"] = (
    ("hits5", "qtext", "docs", "kterms", "kphrases"),
    f"""SELECT query_id, id, round(got / total, 6) AS confidence FROM (SELECT query_id, id,
        CASE WHEN contains(a, title) THEN 3.0 WHEN len(lw) > 0 AND len(list_filter(lw, lambda w: contains(a, w))) / len(lw) >= 0.6
            THEN 3 * 0.67 ELSE 0 END + 2.0 * len(list_filter(ph, lambda w: contains(a, w))) + len(list_filter(tags, lambda w: contains(a, w)
            OR contains(a, replace(w, '-', ' ')))) + 0.5 * len(list_filter(terms, lambda w: contains(a, w))) AS got,
        3.0 + 2.0 * len(ph) + len(tags) + 0.5 * len(terms) AS total
        FROM (SELECT h.query_id, h.id, lower(q.query) AS a, lower(d.title) AS title, [d.topic, d.corpus] AS tags,
            list_filter(string_split_regex(lower(d.title), '{SPACE}'), lambda w: strlen(w) > 3) AS lw, coalesce(p.ph, []) AS ph, coalesce(t.terms, []) AS terms
            FROM hits5 h JOIN qtext q USING (query_id) JOIN docs d USING (id)
            LEFT JOIN (SELECT id, list(lower(phrase) ORDER BY phrase)[1:5] AS ph FROM kphrases GROUP BY id) p USING (id)
            LEFT JOIN (SELECT id, list(term ORDER BY term)[1:10] AS terms FROM kterms GROUP BY id) t USING (id)))""",
)


@query("answer_confidence", compose("SELECT query_id, id, confidence, confidence >= 0.3 AS matched FROM docscores", "docscores"))
def _(spark, sf):
    return ev.score_answers(*answers(spark, sf))[0]


@query(
    "answer_recall",
    compose(
        """SELECT q.query_id, count(id) AS expected_count, count(*) FILTER (confidence >= 0.3) AS matched_count,
        round(CASE WHEN count(id) > 0 THEN count(*) FILTER (confidence >= 0.3) / count(id) ELSE 1 END, 6) AS recall
        FROM qtext q LEFT JOIN docscores USING (query_id) GROUP BY q.query_id""",
        "qtext", "docscores",
    ),
)
def _(spark, sf):
    return ev.score_answers(*answers(spark, sf))[1]


def results(spark, sf):
    """Logged requests as evaluated queries: contexts as verticals, kinds as strategies."""
    return fx.request_log(spark, sf).select(
        F.col("context_id").alias("vertical"), F.col("event_type").alias("strategy"), "success",
        (F.pmod("key", F.lit(11)) / 10).alias("recall"), (F.pmod("key", F.lit(7)) / 6).alias("confidence"), F.col("latency_ms").alias("time_ms"),
    )


RESULTS = """SELECT context_id AS vertical, event_type AS strategy, success, key % 11 / 10 AS recall, key % 7 / 6 AS confidence,
    latency_ms AS time_ms FROM log"""


@query(
    "eval_report",
    compose(
        """SELECT vertical, count(*) AS queries, count(*) FILTER (success) AS succeeded, round(avg(recall) FILTER (success), 6) AS mean_recall,
        round(avg(confidence) FILTER (success), 6) AS mean_confidence, round(avg(time_ms), 6) AS mean_ms, min(time_ms) AS min_ms,
        round(quantile_cont(time_ms, 0.95), 6) AS p95_ms, round(quantile_cont(time_ms, 0.97), 6) AS p97_ms, round(quantile_cont(time_ms, 0.99), 6) AS p99_ms
        FROM r GROUP BY vertical""",
        "log", r=RESULTS,
    ),
)
def _(spark, sf):
    return ev.eval_report(results(spark, sf))


VERTICALS = ["c0", "c1", "c2", "c3"]


@query(
    "strategy_matrix",
    compose(
        "SELECT strategy, "
        + ", ".join(
            f"""round(avg(recall) FILTER (vertical = '{v}'), 6) AS {v}_recall, count(*) FILTER (vertical = '{v}') AS {v}_queries,
            round(avg(recall) FILTER (vertical = '{v}'), 6) >= 0.5 AS {v}_pass"""
            for v in VERTICALS
        )
        + " FROM r GROUP BY strategy",
        "log", r=RESULTS,
    ),
)
def _(spark, sf):
    return ev.strategy_matrix(results(spark, sf), VERTICALS)


@query(
    "best_verticals",
    compose(
        """SELECT strategy, arg_min(vertical, {'a': -m, 'b': vertical}) AS best_vertical, max(m) AS recall FROM
        (SELECT strategy, vertical, round(avg(recall), 6) AS m FROM r GROUP BY ALL) GROUP BY strategy""",
        "log", r=RESULTS,
    ),
)
def _(spark, sf):
    return ev.best_verticals(results(spark, sf))


@query(
    "expected_topic_check",
    compose(
        """SELECT q.query_id, count(h.id) AS n_hits, count(*) FILTER (d.topic = 'en') AS on_topic, count(*) FILTER (d.topic = 'en') >= 5 AS passed
        FROM qtext q LEFT JOIN hits5 h USING (query_id) LEFT JOIN docs d USING (id) GROUP BY q.query_id""",
        "hits5", "qtext", "docs",
    ),
)
def _(spark, sf):
    q, docs = fx.benchmark_queries(spark, sf), fx.corpus(spark, sf)
    expected = q.select("query_id", F.lit("en").alias("expected_topic"), F.lit(5).alias("min_results"))
    return ev.expected_topic_check(text_search(q, docs, top_k=5), docs, expected)


@query(
    "partition_queries",
    """SELECT 'c' || (r - 1) AS vertical, strategy, query_id FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY query_id) AS r
    FROM (SELECT item_id AS query_id, CASE WHEN length(text) < 160 THEN 'fts' WHEN length(text) < 240 THEN 'vector' ELSE 'cascade' END AS strategy
    FROM benchmark)) WHERE r <= 4""",
)
def _(spark, sf):
    n = F.length("text")
    q = fx.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("item_id").alias("position"),
        F.when(n < 160, "fts").when(n < 240, "vector").otherwise("cascade").alias("strategy"),
    )
    verticals = spark.createDataFrame([(v, i + 1) for i, v in enumerate(VERTICALS)], "vertical string, index int")
    return ev.partition_queries(q, verticals)


MATRIX = [("east", "en"), ("east", "fr"), ("west", "en"), ("west", "de"), ("north", "es")]


@query(
    "backend_sets",
    """SELECT b AS backend, doc_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
    (VALUES ('east'), ('west'), ('north')) AS v(b) WHERE r <= 10 OR (b, lang) IN (("""
    + "), (".join(f"'{b}', '{c}'" for b, c in MATRIX)
    + "))",
)
def _(spark, sf):
    docs = fx.corpus(spark, sf).withColumn("corpus", F.col("topic"))
    matrix = spark.createDataFrame(MATRIX, "backend string, corpus string")
    return ev.backend_sets(docs, matrix, ["east", "west", "north"])


@query(
    "corpus_summary",
    "SELECT source AS corpus, count(*) AS entries, string_agg(DISTINCT lang, ',' ORDER BY lang) AS topics FROM documents GROUP BY source",
)
def _(spark, sf):
    return ev.corpus_summary(fx.corpus(spark, sf))


RUN_ROWS = [
    ("s1", "s1-a", 1, False, {"mode": "boost"}),
    ("s1", "s1-b", 2, True, {"mode": "rerank", "scope_weight": "0.3"}),
    ("s1", "s1-c", 3, False, {"mode": "filter", "min_similarity": "0.5"}),
]


def _benchmark_run(spark, sf):
    runs = spark.createDataFrame(RUN_ROWS, "session_id string, run_id string, seq int, selected boolean, params map<string,string>")
    phrases = fx.scope_phrases(spark).withColumn("run_id", F.lit("s1-b"))
    return tuning.benchmark_run(hits_with_content(spark, sf), runs, "s1", phrases, 6)


TUNED = """SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, id) AS INTEGER) AS rank
    FROM (SELECT query_id, id, rank AS old, round(0.7 * score + 0.3 * least(1.0, best_weighted / 2.0), 6) AS score FROM signals)"""


@query("benchmark_run", compose(MOVES.format(base="normhits", tuned="tuned", k=6), "signals", "normhits", tuned=TUNED))
def _(spark, sf):
    return _benchmark_run(spark, sf)[0]


@query(
    "benchmark_verdicts",
    compose(VERDICTS, "signals", "normhits", tuned=TUNED, mv=MOVES.format(base="normhits", tuned="tuned", k=6)),
)
def _(spark, sf):
    return _benchmark_run(spark, sf)[1]


def _workflow(spark, sf):
    """Benchmark passages are searched in titles and swept."""
    q, docs = fx.benchmark_queries(spark, sf), fx.corpus(spark, sf)

    def search(qs):
        return text_search(qs, docs, fields=("title",), top_k=5, normalized=True)

    return tuning.tune_workflow(q, search, docs, fx.scope_phrases(spark), [0.25, 0.5])


CTE["titlehits"] = (
    ("qt", "tok", "dfreq", "fstat", "dlen"),
    """SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM
    (SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
     FROM qt JOIN tok USING (token) JOIN dfreq USING (field, token) JOIN fstat USING (field) JOIN dlen USING (id, field)
     WHERE field = 'title' GROUP BY query_id, id) QUALIFY rank <= 5""",
)


@query(
    "tune_workflow",
    compose(
        f"""SELECT query_id, CAST(t AS DOUBLE) AS threshold, count(*) FILTER (k) AS n_kept, count(*) FILTER (NOT k) AS n_dropped,
        coalesce(string_agg(id, ',' ORDER BY rank) FILTER (k), '') AS kept_ids, coalesce(string_agg(id, ',' ORDER BY rank) FILTER (NOT k), '') AS dropped_ids
        FROM (SELECT query_id, rank, id, t, coalesce(bool_or(sim >= coalesce(floor, t)), false)
              AND coalesce(max(sim) FILTER (sim >= coalesce(floor, t)), 0) >= t AS k
              FROM (SELECT query_id, rank, id, floor, round(least(1.0, len(list_intersect(pw, cw)) / len(pw)
                + CASE WHEN contains(cl, lower(text)) THEN 0.3 ELSE 0 END), 6) AS sim FROM
                (SELECT h.*, list_distinct(list_filter(string_split_regex(lower(d.content), '{SPACE}'), lambda w: w <> '')) AS cw,
                    lower(d.content) AS cl FROM titlehits h JOIN docs d USING (id)),
                (SELECT *, list_distinct(string_split_regex(lower(text), ' ')) AS pw FROM phrases)),
              (VALUES (0.25), (0.5)) AS v(t) GROUP BY query_id, rank, id, t) GROUP BY query_id, t""",
        "titlehits", "docs", "phrases",
    ),
)
def _(spark, sf):
    return _workflow(spark, sf)[0]


@query(
    "queries_without_hits",
    compose("SELECT query_id, 'no_hits' AS error FROM qtext WHERE query_id NOT IN (SELECT query_id FROM titlehits)", "qtext", "titlehits"),
)
def _(spark, sf):
    return _workflow(spark, sf)[1]


@query(
    "workflow_misses",
    compose(
        f"""SELECT query_id, 'no_hits' AS error FROM mq WHERE query_id NOT IN (SELECT query_id FROM (SELECT query_id,
            unnest(string_split_regex(lower(query), '{NOT_WORD}')) AS token FROM mq) JOIN es USING (token))""",
        "docs",
        mq="""SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT -1 - conv_id * 1000 - turn, text FROM conversations""",
        es=f"SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(lower(title), '{NOT_WORD}')) AS token FROM docs WHERE topic = 'es') WHERE token <> ''",
    ),
)
def _(spark, sf):
    """Benchmark passages and messages that share no word with any Spanish title."""
    docs = fx.corpus(spark, sf).filter(F.col("topic") == "es")
    said = fx.table(spark, sf, "conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    bench = fx.benchmark_queries(spark, sf).select("query_id", "query")
    q = bench.unionByName(said).withColumn("context_id", F.lit("bench"))
    index = build_text_index(docs, ("title",))
    return tuning.tune_workflow(q, lambda qs: text_search(qs, index, top_k=5, normalized=True), docs, fx.scope_phrases(spark), [0.25])[1]
