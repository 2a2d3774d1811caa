"""Queries on cascades, fusion, federated merges, batches and the whole life of a query."""

from __future__ import annotations

from dataclasses import replace
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog import scoping  # noqa: F401  (adds the scope fragments)
from rankloom.catalog.base import query
from rankloom.catalog.ctes import CTE, SPACE, bm25, compose
from rankloom.catalog.health import OBS, drift_observations
from rankloom.catalog.log_stats import TRAFFIC
from rankloom.catalog.retrieval import bow_sql
from rankloom.functions.text import query_key
from rankloom.operators import drift, federated
from rankloom.operators.batch import batch_search
from rankloom.operators.cascade import CascadeConfig, Leg, cascade, order_legs
from rankloom.operators.embed import embed_texts
from rankloom.operators.fusion import fuse_rrf
from rankloom.operators.logstats import metrics_snapshot
from rankloom.operators.ordered import top_rows
from rankloom.operators.search_text import text_search
from rankloom.operators.search_vector import vector_search
from rankloom.operators.text_index import build_text_index
from rankloom.plans.answer import AnswerConfig, answer_queries
from rankloom.session import cut


def search_legs(spark, sf):
    """English lexical search first, then lexical search in the other languages and vectors over all; as many hits as a query's top_k."""
    docs = fx.corpus(spark, sf)
    made = {}

    def lexical(name, part):
        def search(q):
            # One index serves every step and query that asks the leg.
            if name not in made:
                made[name] = build_text_index(part)
            return text_search(q, made[name], top_k="top_k")

        return search

    def nearest(q):
        # Both sides are read several times by the search, so they are computed once.
        if "vectors" not in made:
            made["vectors"] = cut(embed_texts(docs.select("id", "content"), "content").select("id", "embedding"))
        qv = cut(embed_texts(q.select("query_id", "query", "top_k"), "query").select("query_id", "top_k", "embedding"))
        return vector_search(qv, made["vectors"], top_k="top_k")

    return [
        Leg("fts_en", "fts", 1, lexical("en", docs.filter(F.col("topic") == "en"))),
        Leg("fts_intl", "fts", 2, lexical("intl", docs.filter(F.col("topic") != "en"))),
        Leg("vec_all", "vector", 2, nearest),
    ]


def content_keys(spark, sf):
    return fx.corpus(spark, sf).select("id", F.sha2("content", 256).alias("content_key"))


CTE["docs_en"] = (("docs",), "SELECT * FROM docs WHERE topic = 'en'")
CTE["docs_intl"] = (("docs",), "SELECT * FROM docs WHERE topic <> 'en'")
CTE["dbow"] = (("docs",), bow_sql("docs", text="content"))
CTE["dnorm"] = (("dbow",), "SELECT id, sqrt(sum(n * n)) AS norm FROM dbow GROUP BY id")


#: As many results as a query's own top_k, null for the usual number.
OWN_K = "least(coalesce(top_k, 10), 1000)"


def add_legs(prefix: str, queries: str, failed: str | None = None) -> None:
    """Fragments of the three legs for a query table: ``{prefix}leghits`` and ``{prefix}legstat``; ``failed`` names (query_id, upstream_id)."""
    p = prefix
    up = f"WHERE (query_id, upstream_id) NOT IN (SELECT (query_id, upstream_id) FROM {failed})" if failed else ""
    errored = f"(q.query_id, l.upstream_id) IN (SELECT (query_id, upstream_id) FROM {failed})" if failed else "false"
    bm25(f"{p}en_", queries, "docs_en")
    bm25(f"{p}intl_", queries, "docs_intl")
    CTE[f"{p}qbow"] = ((queries,), bow_sql(queries, "query_id", "query"))
    CTE[f"{p}vec"] = (
        (f"{p}qbow", "dbow", "dnorm"),
        f"""SELECT query_id, id, round(sum(q.n * d.n) / (any_value(qn.norm) * any_value(dn.norm)), 6) AS score
        FROM {p}qbow q JOIN dbow d USING (axis) JOIN dnorm dn USING (id)
        JOIN (SELECT query_id, sqrt(sum(n * n)) AS norm FROM {p}qbow GROUP BY query_id) qn USING (query_id)
        GROUP BY query_id, id""",
    )
    # A vector leg lists every document, also those without a common axis.
    CTE[f"{p}leghits"] = (
        (f"{p}en_bm", f"{p}intl_bm", f"{p}vec", queries, *([failed] if failed else [])),
        f"""SELECT * EXCLUDE (top_k) FROM (SELECT step, upstream_id, query_id, CAST(row_number() OVER (PARTITION BY upstream_id, query_id
        ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM (SELECT 0 AS step, 'fts_en' AS upstream_id, * FROM {p}en_bm UNION ALL
        SELECT 1, 'fts_intl', * FROM {p}intl_bm UNION ALL SELECT 2, 'vec_all', * FROM {p}vec) {up})
        JOIN (SELECT query_id, top_k FROM {queries}) USING (query_id) WHERE rank <= {OWN_K}""",
    )
    CTE[f"{p}legstat"] = (
        (f"{p}leghits", queries),
        f"""SELECT q.query_id, l.step, l.upstream_id, coalesce(max(score), 0) AS max_score, count(id) AS n, {errored} AS errored,
        round(CASE WHEN l.step < 2 THEN least(1.0, coalesce(max(score), 0) / 100) ELSE greatest(0.0, least(1.0, coalesce(max(score), 0)))
        END, 6) AS normalized FROM {queries} q CROSS JOIN (VALUES (0, 'fts_en'), (1, 'fts_intl'), (2, 'vec_all')) AS l(step, upstream_id)
        LEFT JOIN {p}leghits h ON h.query_id = q.query_id AND h.upstream_id = l.upstream_id
        GROUP BY q.query_id, l.step, l.upstream_id""",
    )


def add_outcome(prefix: str, threshold: float, depth: int) -> None:
    p = prefix
    CTE[f"{p}outcome"] = (
        (f"{p}legstat",),
        f"""SELECT query_id, met IS NOT NULL AS ok, coalesce(met, best) AS final_step, coalesce(met, {depth - 1}) AS last_step, down
        FROM (SELECT query_id, min(step) FILTER (NOT errored AND normalized >= {threshold} AND n >= 1) AS met,
              arg_min(step, {{'a': -normalized, 'b': step}}) FILTER (NOT errored) AS best, bool_and(errored) AS down
              FROM {p}legstat WHERE step < {depth} GROUP BY query_id)""",
    )


add_legs("", "qtext")
add_outcome("", 0.7, 3)
NAMES = "CASE {} WHEN 0 THEN 'fts_en' WHEN 1 THEN 'fts_intl' WHEN 2 THEN 'vec_all' END"
TRIED = "CASE {} WHEN 0 THEN 'fts_en' WHEN 1 THEN 'fts_en,fts_intl' ELSE 'fts_en,fts_intl,vec_all' END"


@query(
    "cascade_hits",
    compose(
        """SELECT query_id, rank, id, score, upstream_id FROM leghits JOIN outcome USING (query_id) WHERE step = final_step""",
        "leghits", "outcome",
    ),
)
def _(spark, sf):
    return cascade(fx.benchmark_queries(spark, sf), search_legs(spark, sf))[0]


@query(
    "cascade_outcome",
    compose(
        f"""SELECT query_id, CASE WHEN ok THEN 'threshold_met' ELSE 'all_exhausted' END AS stop_reason,
        {NAMES.format('final_step')} AS final_leg, {TRIED.format('last_step')} AS tried, CAST(last_step + 1 AS INTEGER) AS depth FROM outcome""",
        "outcome",
    ),
)
def _(spark, sf):
    return cascade(fx.benchmark_queries(spark, sf), search_legs(spark, sf))[1]


add_legs("d_", "qtext")
add_outcome("d_", 0.95, 2)


@query(
    "cascade_depth_limit",
    compose(
        f"""SELECT query_id, CASE WHEN ok THEN 'threshold_met' ELSE 'max_depth_reached' END AS stop_reason,
        {NAMES.format('final_step')} AS final_leg, {TRIED.format('last_step')} AS tried, CAST(last_step + 1 AS INTEGER) AS depth
        FROM d_outcome""",
        "d_outcome",
    ),
)
def _(spark, sf):
    return cascade(fx.benchmark_queries(spark, sf), search_legs(spark, sf), CascadeConfig(threshold=0.95, max_depth=2))[1]


@query(
    "cascade_leg_scores",
    compose(
        """SELECT query_id, upstream_id, max_score, normalized, n, CAST(step AS INTEGER) AS step FROM legstat JOIN outcome
        USING (query_id) WHERE step <= last_step""",
        "legstat", "outcome",
    ),
)
def _(spark, sf):
    return cascade(fx.benchmark_queries(spark, sf), search_legs(spark, sf))[2].drop("errored")


FUSED = f"""SELECT * EXCLUDE (top_k) FROM (SELECT query_id, id, score, upstream_id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY rrf_score DESC, id) AS INTEGER) AS rank FROM (SELECT query_id, content, round(sum(1 / (60 + rank)), 6) AS rrf_score,
    unnest(arg_min({{{{'id': h.id, 'score': score, 'upstream_id': upstream_id}}}}, {{{{'s': -score, 'i': h.id, 'u': upstream_id}}}}))
    FROM {{hits}} h JOIN docs d ON d.id = h.id WHERE {{where}} GROUP BY query_id, content))
    JOIN (SELECT query_id, top_k FROM {{queries}}) USING (query_id) WHERE rank <= {{k}}"""


def _fused(spark, sf, q, max_results):
    """All three legs fused, whatever they scored."""
    lists = None
    for leg in search_legs(spark, sf):
        found = leg.search(q).withColumn("upstream_id", F.lit(leg.upstream_id))
        lists = found if lists is None else lists.unionByName(found)
    keyed = lists.join(content_keys(spark, sf), "id").join(q.select("query_id", "top_k"), "query_id")
    return fuse_rrf(keyed, max_results=max_results)


@query("fuse_rrf", compose(FUSED.format(where="true", k=10, hits="leghits", queries="qtext"), "leghits", "docs", "qtext"))
def _(spark, sf):
    return _fused(spark, sf, fx.benchmark_queries(spark, sf), 10)


CTE["fused"] = (("leghits", "docs", "qtext"), FUSED.format(where="step > 0", k=OWN_K, hits="leghits", queries="qtext"))
CTE["rrf_outcome"] = (
    ("legstat", "fused"),
    """SELECT query_id, a.norm >= 0.7 AND a.n >= 1 AS met0, b.norm >= 0.7 AND coalesce(f.n, 0) >= 1 AS met1,
    coalesce(b.norm, 0) > a.norm AND f.n IS NOT NULL AS later_better
    FROM (SELECT query_id, normalized AS norm, n FROM legstat WHERE step = 0) a
    JOIN (SELECT query_id, max(normalized) FILTER (n > 0) AS norm FROM legstat WHERE step > 0 GROUP BY query_id) b USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS n FROM fused GROUP BY query_id) f USING (query_id)""",
)


def _rrf(spark, sf):
    cfg = CascadeConfig(fusion="rrf", content_keys=content_keys(spark, sf))
    return cascade(fx.benchmark_queries(spark, sf), search_legs(spark, sf), cfg)


@query(
    "cascade_rrf",
    compose(
        """SELECT query_id, CASE WHEN met0 OR met1 THEN 'threshold_met' ELSE 'all_exhausted' END AS stop_reason,
        CASE WHEN met0 THEN 'fts_en' WHEN met1 THEN NULL WHEN later_better THEN 'fts_intl' ELSE 'fts_en' END AS final_leg,
        CASE WHEN met0 THEN 'fts_en' ELSE 'fts_en,fts_intl,vec_all' END AS tried, CASE WHEN met0 THEN 1 ELSE 3 END AS depth FROM rrf_outcome""",
        "rrf_outcome",
    ),
)
def _(spark, sf):
    return _rrf(spark, sf)[1]


@query(
    "cascade_rrf_hits",
    compose(
        """SELECT query_id, rank, id, score, upstream_id FROM leghits JOIN rrf_outcome USING (query_id)
        WHERE step = 0 AND (met0 OR NOT (met1 OR later_better)) UNION ALL
        SELECT query_id, rank, id, score, upstream_id FROM fused JOIN rrf_outcome USING (query_id)
        WHERE NOT met0 AND (met1 OR later_better)""",
        "leghits", "fused", "rrf_outcome",
    ),
)
def _(spark, sf):
    return _rrf(spark, sf)[0]


@query(
    "cascade_targeted",
    compose(
        f"""SELECT query_id, CASE WHEN t.query_id IS NOT NULL OR ok THEN 'threshold_met' ELSE 'all_exhausted' END AS stop_reason,
        CASE WHEN t.query_id IS NOT NULL THEN 'fts_intl' ELSE {NAMES.format('final_step')} END AS final_leg,
        CASE WHEN t.query_id IS NOT NULL THEN 'fts_intl' ELSE {TRIED.format('last_step')} END AS tried,
        CAST(CASE WHEN t.query_id IS NOT NULL THEN 1 ELSE last_step + 1 END AS INTEGER) AS depth
        FROM outcome LEFT JOIN (SELECT DISTINCT query_id FROM leghits JOIN qtext USING (query_id)
            WHERE upstream_id = 'fts_intl' AND length(query) >= 240) t USING (query_id)""",
        "outcome", "qtext",
    ),
)
def _(spark, sf):
    """Long queries name the international leg, medium ones a leg that does not exist."""
    n = F.length("query")
    q = fx.benchmark_queries(spark, sf).withColumn(
        "upstream_id", F.when(n >= 240, "fts_intl").when(n >= 160, "gone")
    )
    return cascade(q, search_legs(spark, sf), targeted=True)[1]


@query(
    "order_legs",
    compose(
        """SELECT event_id AS query_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY
            NOT coalesce(contains(kind, p) OR contains(u, p), false), prio, u) AS INTEGER) AS position, u AS upstream_id
        FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'intl' END AS p FROM events),
        (VALUES ('fts_en', 'fts', 1), ('fts_intl', 'fts', 2), ('vec_all', 'vector', 2)) AS l(u, kind, prio)"""
    ),
)
def _(spark, sf):
    legs = spark.createDataFrame(
        [("fts_en", "fts", 1), ("fts_intl", "fts", 2), ("vec_all", "vector", 2)],
        "upstream_id string, upstream_type string, priority int",
    )
    kind = F.col("event_type")
    q = fx.table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"), F.when(kind == "view", "vector").when(kind == "click", "intl").alias("preferred")
    )
    return order_legs(q, legs)


def local_and_remote(spark, sf):
    """English lexical hits on the local side, vector hits over everything on the remote side."""
    q = fx.benchmark_queries(spark, sf)
    en, _, vec = search_legs(spark, sf)
    docs = fx.corpus(spark, sf).filter(F.col("topic") == "en")
    return q, text_search(q, docs, top_k=5, normalized=True, min_score=0.3), vec.search(q)


CTE["local"] = (
    ("leghits",),
    """SELECT * FROM (SELECT query_id, rank, id, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0
    THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score FROM leghits WHERE step = 0) WHERE score >= 0.3""",
)
CTE["remote"] = (("leghits",), "SELECT query_id, rank, id, score FROM leghits WHERE step = 2")


@query(
    "federated_decision",
    compose(
        """SELECT query_id, reason, reason <> 'local_sufficient' AS query_remote FROM (SELECT q.query_id,
        CASE WHEN count(id) = 0 THEN 'empty_local' WHEN count(id) < 3 THEN 'below_min_results' WHEN max(score) < 0.7 THEN 'low_confidence'
        ELSE 'local_sufficient' END AS reason FROM qtext q LEFT JOIN local USING (query_id) GROUP BY q.query_id)""",
        "local",
    ),
)
def _(spark, sf):
    q, local, _ = local_and_remote(spark, sf)
    return federated.federated_decision(q, local)


KEPT = {
    "local_only_fallback": ("SELECT * FROM both_ WHERE side = 0 OR query_id NOT IN (SELECT query_id FROM local)", "rank, id"),
    "local_priority": (
        "SELECT * FROM both_ WHERE side = 0 OR (query_id, id) NOT IN (SELECT (query_id, id) FROM local)", "side, rank, id",
    ),
    "remote_priority": (
        "SELECT * FROM both_ WHERE side = 1 OR (query_id, id) NOT IN (SELECT (query_id, id) FROM remote)", "-side, rank, id",
    ),
    "interleave": (
        "SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, side, rank) = 1",
        "score DESC, side, rank, id",
    ),
}
CTE["both_"] = (("local", "remote"), "SELECT *, 0 AS side FROM local UNION ALL SELECT *, 1 AS side FROM remote")


def _merge(mode):
    def run(spark, sf):
        _, local, remote = local_and_remote(spark, sf)
        return federated.federated_merge(local, remote, mode, 8)[0]

    return run


def _merge_stats(mode):
    def run(spark, sf):
        _, local, remote = local_and_remote(spark, sf)
        return federated.federated_merge(local, remote, mode, 8)[1]

    return run


for mode, (kept, order) in KEPT.items():
    query(
        f"merge_{mode}",
        compose(
            f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS rank, id, score,
            CASE side WHEN 0 THEN 'local' ELSE 'remote' END AS source FROM
            kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {order}) <= 8""",
            "both_", kept=kept,
        ),
    )(_merge(mode))

for mode in ("local_priority", "interleave"):
    query(
        f"merge_{mode}_stats",
        compose(
            """SELECT query_id, lc AS local_count, rc AS remote_count, least(k, 8) AS merged_count, lc + rc - k AS duplicates_removed,
            rc > 0 AS remote_queried FROM (SELECT query_id, count(*) FILTER (side = 0) AS lc, count(*) FILTER (side = 1) AS rc
            FROM both_ GROUP BY query_id) JOIN (SELECT query_id, count(*) AS k FROM kept GROUP BY query_id) USING (query_id)""",
            "both_", kept=KEPT[mode][0],
        ),
    )(_merge_stats(mode))


@query(
    "top_k",
    compose(
        """SELECT * FROM (SELECT event_type, event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id)
        AS INTEGER) AS rank FROM events) WHERE rank <= 10"""
    ),
)
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_type", "event_id", "value")
    return top_rows(e, ["event_type"], [F.desc("value"), F.asc("event_id")], 10)


def _batch(spark, sf):
    """Messages as a batch: a conversation's turns share its id, so longer ones are duplicates."""
    b = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"),
        F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("query"),
        F.lit(5).alias("top_k"),
    )
    docs = fx.corpus(spark, sf)
    return batch_search(
        b.unionByName(fx.benchmark_queries(spark, sf).select((-1 - F.col("query_id")).alias("query_id"), "query", "top_k")),
        lambda q: text_search(q, docs, top_k=5),
    )


bm25("b_", "bvalid", "docs")
CTE["bq"] = (
    (),
    """SELECT conv_id AS query_id, CASE WHEN role = 'system' THEN '' ELSE text END AS query FROM conversations UNION ALL
    SELECT -1 - item_id, text FROM benchmark""",
)
CTE["bcode"] = (
    ("bq",),
    f"""SELECT query_id, CASE WHEN count(*) > 1 THEN 'duplicate_id' WHEN regexp_replace(any_value(query), '{SPACE}', '', 'g') = ''
    THEN 'empty_query' WHEN strlen(any_value(query)) > 10000 THEN 'query_too_long' END AS error_code FROM bq GROUP BY query_id""",
)
CTE["bvalid"] = (("bq", "bcode"), "SELECT * FROM bq WHERE query_id IN (SELECT query_id FROM bcode WHERE error_code IS NULL)")
CTE["bstatus"] = (
    ("bcode", "b_bm"),
    """SELECT query_id, error_code IS NULL AS success, error_code, least(coalesce(n, 0), 5) AS result_count FROM bcode
    LEFT JOIN (SELECT query_id, count(*) AS n FROM b_bm GROUP BY query_id) USING (query_id)""",
)


@query("batch_status", compose("SELECT * FROM bstatus", "bstatus"))
def _(spark, sf):
    return _batch(spark, sf)[1]


@query(
    "batch_summary",
    compose(
        """SELECT count(*) AS total, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed,
        true AS complete FROM bstatus""",
        "bstatus",
    ),
)
def _(spark, sf):
    return _batch(spark, sf)[2]


# --- the whole life of a query ---

ANSWER = AnswerConfig(fresh_seconds=6 * 3600, stale_seconds=6 * 3600, tau=0.92)


def _flagship(spark, sf, own_k=False, cfg=ANSWER):
    bench = fx.table(spark, sf, "benchmark")
    talk = fx.table(spark, sf, "conversations")
    ctx = F.lit("bench").alias("context_id")
    item = F.col("item_id")
    # Two askers of one question want different numbers.
    k, other_k = (fx.own_k(item), fx.own_k(item + 1)) if own_k else (F.lit(5), F.lit(5))
    questions = (
        bench.select((item * 2).alias("query_id"), F.col("text").alias("query"), ctx, k.alias("top_k"))
        .unionByName(
            bench.select(
                (item * 2 + 1).alias("query_id"),
                F.concat(F.lit(" "), F.translate("text", ascii_lowercase, ascii_uppercase)).alias("query"), ctx, other_k.alias("top_k"),
            )
        )
        .unionByName(
            talk.filter(F.col("role") == "user").select(
                (1_000_000 + F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), ctx, F.lit(5).alias("top_k")
            )
        )
    )
    docs = fx.corpus(spark, sf)
    entries = fx.benchmark_queries(spark, sf).select(
        "query_id",
        query_key("query", "context_id").alias("norm_key"),
        "context_id",
        "query",
        (F.lit(fx.NOW).cast("timestamp") - F.make_dt_interval(hours=F.pmod(F.col("query_id") * 37, F.lit(36)).cast("int"))).alias(
            "cached_at"
        ),
    )
    hits = text_search(fx.benchmark_queries(spark, sf), docs, top_k=5, normalized=True)
    entry_hits = hits.join(entries.select("query_id", "norm_key"), "query_id").select("norm_key", "rank", "id", "score")
    responses, audit = answer_queries(
        questions, entries.drop("query_id"), entry_hits, search_legs(spark, sf), docs, fx.scope_phrases(spark), fx.NOW, cfg
    )
    return responses, audit


NORM_KEY = f"""sha256(regexp_replace(lower(regexp_replace('ctx:bench:' || query, '^{SPACE}|{SPACE}$', '', 'g')), '{SPACE}', ' ', 'g'))"""
CTE["fentries"] = (
    ("qtext",),
    f"""SELECT item, norm_key, age, CASE WHEN age < jf THEN 'fresh' WHEN age < jf + 21600 THEN 'stale' WHEN age < 86400 THEN 'frozen'
    ELSE 'expired' END AS freshness, query FROM (SELECT query_id AS item, query, {NORM_KEY} AS norm_key, (query_id * 37 % 36) * 3600 AS age,
    21600 + floor(21600 * (CAST('0x' || {NORM_KEY}[1:2] AS BIGINT) / 255.0) * 0.1) AS jf FROM qtext)""",
)
def _fwords(e: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({e}), '{SPACE}'), lambda w: w <> ''))"


CTE["fentryq"] = (("fentries",), "SELECT norm_key AS id, 'ctx:bench:' || query AS query FROM fentries")
CTE["fentrybow"] = (("fentryq",), bow_sql("fentryq", "id", "query"))
CTE["fentryhits"] = (
    ("hits5", "fentries"),
    """SELECT norm_key, rank, id, round(least(1.0, score / max(score) OVER (PARTITION BY query_id)), 6) AS score
    FROM hits5 JOIN fentries ON item = query_id""",
)


ITEM_K = "CASE ({}) % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 20 END"


def add_answer(p: str, own_k: bool = False, semantic: bool = True, failed: str | None = None) -> None:
    """Fragments of the whole life of the questions, up to ``{p}keyhits``, the results of every different question."""
    k, other_k = (ITEM_K.format("item_id"), ITEM_K.format("item_id + 1")) if own_k else ("5", "5")
    CTE[f"{p}q"] = (
        (),
        f"""SELECT *, {NORM_KEY} AS norm_key FROM (SELECT item_id * 2 AS query_id, text AS query, {k} AS top_k FROM benchmark UNION ALL
        SELECT item_id * 2 + 1, ' ' || translate(text, '{ascii_lowercase}', '{ascii_uppercase}'), {other_k} FROM benchmark UNION ALL
        SELECT 1000000 + conv_id * 1000 + turn, text, 5 FROM conversations WHERE role = 'user')""",
    )
    CTE[f"{p}asked"] = (
        (f"{p}q", "fentries"),
        f"""SELECT f.norm_key, f.leader, f.query, f.top_k, e.freshness FROM (SELECT norm_key, min(query_id) AS leader,
        arg_min(query, query_id) AS query, max({OWN_K}) AS top_k FROM {p}q GROUP BY norm_key) f LEFT JOIN fentries e USING (norm_key)""",
    )
    CTE[f"{p}rest"] = (
        (f"{p}asked",),
        f"""SELECT norm_key AS query_id, leader, 'ctx:bench:' || query AS query, query AS raw, freshness, top_k FROM {p}asked
        WHERE freshness IS NULL OR freshness NOT IN ('fresh', 'stale')""",
    )
    CTE[f"{p}restbow"] = ((f"{p}rest",), bow_sql(f"{p}rest", "query_id", "query"))
    CTE[f"{p}match"] = (
        (f"{p}restbow", "fentrybow", "fentries"),
        f"""SELECT query_id, id AS matched_key FROM (SELECT query_id, id, round(sum(a.n * b.n) / (any_value(an) * any_value(bn)), 6) AS sim
        FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY query_id)) AS an FROM {p}restbow) a
        JOIN (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY id)) AS bn FROM fentrybow) b USING (axis) GROUP BY query_id, id
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) = 1) WHERE sim >= {0.92 if semantic else 2}
        AND id IN (SELECT norm_key FROM fentries WHERE freshness <> 'expired')""",
    )
    CTE[f"{p}miss"] = (
        (f"{p}rest", f"{p}match"),
        f"""SELECT leader AS query_id, query_id AS norm_key, raw AS query, freshness, top_k FROM {p}rest
        WHERE query_id NOT IN (SELECT query_id FROM {p}match)""",
    )
    add_legs(f"{p}_", f"{p}miss", failed)
    add_outcome(f"{p}_", 0.7, 3)
    CTE[f"{p}found"] = (
        (f"{p}_leghits", f"{p}_outcome"),
        f"SELECT query_id, rank, id, score FROM {p}_leghits JOIN {p}_outcome USING (query_id) WHERE step = final_step",
    )
    CTE[f"{p}scoped"] = (
        (f"{p}found", "phrases", "docs", f"{p}miss"),
        f"""SELECT m.norm_key, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS INTEGER) AS rank, id, score
        FROM (SELECT query_id, rank, id, score FROM (SELECT query_id, rank, id, score, floor, round(least(1.0,
            len(list_intersect(pw, cw)) / len(pw) + CASE WHEN contains(cl, lower(text)) THEN 0.3 ELSE 0 END), 6) AS sim
            FROM (SELECT h.*, {_fwords('d.content')} AS cw, lower(d.content) AS cl FROM {p}found h JOIN docs d USING (id)),
            (SELECT *, {_fwords('text')} AS pw FROM phrases)) WHERE sim >= coalesce(floor, 0.25)
            GROUP BY query_id, rank, id, score HAVING max(sim) >= 0.25) JOIN {p}miss m USING (query_id)""",
    )
    CTE[f"{p}keyhits"] = (
        (f"{p}asked", f"{p}match", "fentryhits", f"{p}scoped", f"{p}_outcome"),
        f"""SELECT a.norm_key, rank, id, score FROM {p}asked a JOIN fentryhits USING (norm_key) WHERE freshness IN ('fresh', 'stale')
        UNION ALL SELECT query_id, rank, id, score FROM {p}match JOIN fentryhits ON norm_key = matched_key
        UNION ALL SELECT a.norm_key, rank, id, score FROM {p}asked a JOIN {p}_outcome o ON o.query_id = a.leader JOIN fentryhits USING (norm_key)
        WHERE down AND freshness = 'frozen' UNION ALL SELECT * FROM {p}scoped""",
    )


def answers(p: str) -> str:
    """What every asker gets."""
    return compose(
        f"SELECT query_id, rank, id, score FROM {p}q JOIN {p}keyhits USING (norm_key) WHERE rank <= {OWN_K}", f"{p}q", f"{p}keyhits"
    )


def audits(p: str) -> str:
    """One audit row per question."""
    return compose(
        f"""SELECT q.query_id, CASE freshness WHEN 'fresh' THEN 'hit' WHEN 'stale' THEN 'stale'
            ELSE CASE WHEN matched_key IS NOT NULL THEN 'hit' WHEN down AND freshness = 'frozen' THEN 'frozen' ELSE 'miss' END END AS cache_status,
        CASE WHEN freshness IN ('fresh', 'stale') THEN 'exact' WHEN matched_key IS NOT NULL THEN 'semantic'
             WHEN down AND freshness = 'frozen' THEN 'exact' ELSE 'search' END AS tier,
        CASE WHEN freshness IN ('fresh', 'stale') OR matched_key IS NOT NULL THEN NULL WHEN down THEN 'upstream_error'
             WHEN freshness IS NULL THEN 'not_in_cache' ELSE 'expired' END AS miss_reason,
        {NAMES.format('final_step')} AS final_leg, CASE WHEN ok THEN 'threshold_met' WHEN NOT ok THEN 'all_exhausted' END AS stop_reason,
        CASE WHEN q.query_id = leader THEN 'leader' ELSE 'waiter' END AS role, least(coalesce(n, 0), least(coalesce(q.top_k, 10), 1000)) AS result_count,
        CAST(NULL AS VARCHAR) AS error_code
        FROM {p}q q JOIN {p}asked a USING (norm_key) LEFT JOIN {p}match m ON m.query_id = q.norm_key
        LEFT JOIN {p}_outcome o ON o.query_id = a.leader
        LEFT JOIN (SELECT norm_key, count(*) AS n FROM {p}keyhits GROUP BY norm_key) USING (norm_key)""",
        f"{p}q", f"{p}asked", f"{p}match", f"{p}_outcome", f"{p}keyhits",
    )


add_answer("f")


@query("answer_queries", answers("f"))
def _(spark, sf):
    return _flagship(spark, sf)[0]


@query("answer_audit", audits("f"))
def _(spark, sf):
    return _flagship(spark, sf)[1]


# --- as many results as each query asks for ---

CTE["kq"] = ((), f"SELECT item_id AS query_id, text AS query, {ITEM_K.format('item_id')} AS top_k, 'bench' AS context_id FROM benchmark")
add_legs("k_", "kq")
add_outcome("k_", 0.7, 3)
CTE["k_fused"] = (("k_leghits", "docs", "kq"), FUSED.format(where="true", k=OWN_K, hits="k_leghits", queries="kq"))


def _own_k(spark, sf):
    q = fx.benchmark_queries(spark, sf)
    return q.withColumn("top_k", fx.own_k(F.col("query_id")))


@query(
    "text_search_own_k",
    compose(
        f"""SELECT query_id, rank, id, score FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)
        AS INTEGER) AS rank, id, score FROM bm) JOIN kq USING (query_id) WHERE rank <= {OWN_K}""",
        "bm", "kq",
    ),
)
def _(spark, sf):
    return text_search(_own_k(spark, sf), fx.corpus(spark, sf), top_k="top_k")


@query(
    "cascade_hits_own_k",
    compose(
        "SELECT query_id, rank, id, score, upstream_id FROM k_leghits JOIN k_outcome USING (query_id) WHERE step = final_step",
        "k_leghits", "k_outcome",
    ),
)
def _(spark, sf):
    return cascade(_own_k(spark, sf), search_legs(spark, sf))[0]


@query("fuse_rrf_own_k", compose("SELECT * FROM k_fused", "k_fused"))
def _(spark, sf):
    return _fused(spark, sf, _own_k(spark, sf), "top_k")


add_answer("kf", own_k=True)


@query("answer_own_k", answers("kf"))
def _(spark, sf):
    return _flagship(spark, sf, own_k=True)[0]


# --- legs that fail ---

CTE["failed"] = (
    (),
    """SELECT query_id, upstream_id FROM (SELECT CAST(trunc(value) AS BIGINT) % 400 AS query_id, CASE user_id % 3 WHEN 0 THEN 'fts_en'
    WHEN 1 THEN 'fts_intl' ELSE 'vec_all' END AS upstream_id, arg_max(event_type, event_id) AS last FROM events GROUP BY ALL)
    WHERE last NOT IN ('view', 'purchase')""",
)
add_legs("e_", "qtext", "failed")
add_outcome("e_", 0.7, 3)


@query(
    "cascade_failed",
    compose(
        f"""SELECT query_id, CASE WHEN ok THEN 'threshold_met' ELSE 'all_exhausted' END AS stop_reason,
        {NAMES.format('final_step')} AS final_leg, {TRIED.format('last_step')} AS tried, CAST(last_step + 1 AS INTEGER) AS depth FROM e_outcome""",
        "e_outcome",
    ),
)
def _(spark, sf):
    return cascade(fx.benchmark_queries(spark, sf), search_legs(spark, sf), CascadeConfig(failed=fx.failed_legs(spark, sf)))[1]


@query(
    "cascade_targeted_failed",
    compose(
        f"""SELECT query_id, CASE WHEN t.query_id IS NOT NULL OR ok THEN 'threshold_met' ELSE 'all_exhausted' END AS stop_reason,
        CASE WHEN t.query_id IS NOT NULL THEN 'fts_intl' ELSE {NAMES.format('final_step')} END AS final_leg,
        CASE WHEN t.query_id IS NOT NULL THEN 'fts_intl' ELSE {TRIED.format('last_step')} END AS tried,
        CAST(CASE WHEN t.query_id IS NOT NULL THEN 1 ELSE last_step + 1 END AS INTEGER) AS depth
        FROM e_outcome LEFT JOIN (SELECT DISTINCT query_id FROM e_leghits WHERE upstream_id = 'fts_intl') t USING (query_id)""",
        "e_outcome", "e_leghits",
    ),
)
def _(spark, sf):
    """Every query names the international leg; where that has failed, the cascade goes on without it."""
    q = fx.benchmark_queries(spark, sf).withColumn("upstream_id", F.lit("fts_intl"))
    return cascade(q, search_legs(spark, sf), CascadeConfig(failed=fx.failed_legs(spark, sf)), targeted=True)[1]


add_answer("x", semantic=False, failed="failed")


def _failing(spark, sf):
    """No semantic tier, and legs that fail: frozen entries serve, or the question ends as an error."""
    down = replace(ANSWER, tau=None, cascade=CascadeConfig(failed=fx.failed_legs(spark, sf)))
    return _flagship(spark, sf, cfg=down)


@query("answer_failed", answers("x"))
def _(spark, sf):
    return _failing(spark, sf)[0]


@query("answer_failed_audit", audits("x"))
def _(spark, sf):
    return _failing(spark, sf)[1]


# --- one snapshot of everything counted ---


@query(
    "metrics_snapshot",
    compose(
        f"""SELECT t.*, c.*, d.* FROM (SELECT {TRAFFIC} FROM log) t,
        (SELECT count(*) AS cascade_total, count(*) FILTER (ok) AS cascade_met, count(*) FILTER (NOT ok) AS cascade_exhausted,
            CAST(0 AS BIGINT) AS cascade_depth_limited, round(avg(last_step + 1), 6) AS cascade_avg_depth FROM outcome) c,
        (SELECT count(*) FILTER (level = 'none') AS drift_none, count(*) FILTER (level = 'minor') AS drift_minor,
            count(*) FILTER (level = 'moderate') AS drift_moderate, count(*) FILTER (level = 'significant') AS drift_significant,
            count(*) FILTER (level = 'major') AS drift_major, count(*) FILTER (alert AND NOT coalesce(before, false)) AS drift_alerts
         FROM (SELECT *, lag(alert) OVER (PARTITION BY upstream_id ORDER BY ts, seq) AS before FROM
            (SELECT *, count(*) FILTER (level IN ('significant', 'major')) OVER (PARTITION BY upstream_id ORDER BY ts, seq
                ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) >= 45 AS alert FROM o))) d""",
        "log", "outcome", o=OBS,
    ),
)
def _(spark, sf):
    outcome = cascade(fx.benchmark_queries(spark, sf), search_legs(spark, sf))[1]
    levels = drift.drift_window(drift_observations(spark, sf), alert_count=45)
    return metrics_snapshot(fx.request_log(spark, sf), outcome, levels.select("upstream_id", "ts", "seq", "level", "alert"))
