"""Queries on scope phrases and characteristic terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog import retrieval  # noqa: F401  (adds the hit fragments)
from rankloom.catalog.base import query
from rankloom.catalog.ctes import CTE, NOT_WORD, SPACE, compose
from rankloom.functions.scores import round6
from rankloom.operators import phrases as ph
from rankloom.operators import scope as sc
from rankloom.operators.search_text import text_search


def hits_with_content(spark, sf, top_k=10):
    """Best-normalised benchmark hits with their contents, in the benchmark context."""
    docs = fx.corpus(spark, sf)
    hits = text_search(fx.benchmark_queries(spark, sf), docs, top_k=top_k, normalized=True)
    return hits.join(docs.select("id", "content"), "id").withColumn("context_id", F.lit("bench"))


def _words(e: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({e}), '{SPACE}'), lambda w: w <> ''))"


CTE["normhits"] = (
    ("hits10",),
    """SELECT query_id, rank, id, round(CASE WHEN m > 0 THEN least(1.0, score / m) ELSE 0 END, 6) AS score
    FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM hits10)""",
)
CTE["phrases"] = (
    (),
    "SELECT phrase_id, text, CASE WHEN weight >= 0 THEN weight ELSE 1 END AS weight, CAST(floor AS DOUBLE) AS floor FROM (VALUES "
    + ", ".join(f"({i}, '{t}', {w}, {'NULL' if f is None else f})" for i, t, w, f in fx.PHRASES)
    + ") AS v(phrase_id, text, weight, floor)",
)
CTE["sims"] = (
    ("normhits", "phrases", "docs"),
    f"""SELECT query_id, rank, id, score, phrase_id, weight, floor, round(CASE WHEN len(pw) > 0 AND len(cw) > 0 THEN
        least(1.0, len(list_intersect(pw, cw)) / len(pw) + CASE WHEN contains(cl, lower(text)) THEN 0.3 ELSE 0 END) ELSE 0 END, 6)
        AS sim FROM (SELECT h.*, {_words('d.content')} AS cw, lower(d.content) AS cl FROM normhits h JOIN docs d USING (id)) h,
        (SELECT *, {_words('text')} AS pw FROM phrases) p""",
)
CTE["signals"] = (
    ("sims",),
    """SELECT query_id, rank, id, score, coalesce(max(sim) FILTER (sim >= coalesce(floor, 0.25)), 0) AS best_sim,
    round(coalesce(max(sim * weight) FILTER (sim >= coalesce(floor, 0.25)), 0), 6) AS best_weighted,
    coalesce(bool_or(sim >= coalesce(floor, 0.25)), false) AS any_phrase FROM sims GROUP BY ALL""",
)


@query("scope_signals", compose("SELECT query_id, id, best_sim, best_weighted, any_phrase FROM signals", "signals"))
def _(spark, sf):
    s = sc.scope_signals(hits_with_content(spark, sf), fx.scope_phrases(spark))
    return s.select("query_id", "id", "best_sim", "best_weighted", "any_phrase")


SCOPED = {
    "filter": """SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS INTEGER) AS rank
        FROM signals WHERE any_phrase AND best_sim >= 0.25""",
    "rerank": """SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old, id) AS INTEGER)
        AS rank FROM (SELECT query_id, id, rank AS old, round(0.7 * score + 0.3 * least(1.0, best_weighted / 2.0), 6) AS score
        FROM signals)""",
    "boost": """SELECT query_id, id, CASE WHEN any_phrase AND best_sim >= 0.25 THEN
        round(score * (1 + 0.3 * least(1.0, best_weighted / 2.0)), 6) ELSE score END AS score, rank FROM signals""",
}


def _scoped(mode):
    def run(spark, sf):
        out = sc.scope(hits_with_content(spark, sf), fx.scope_phrases(spark), mode)
        return out.select("query_id", "id", "score", "rank")

    return run


for mode, sql in SCOPED.items():
    query(f"scope_{mode}", compose(sql, "signals"))(_scoped(mode))


@query(
    "scope_stats",
    compose(
        """SELECT query_id, count(*) AS n_in, count(*) FILTER (k) AS n_out, count(*) FILTER (NOT k) AS filtered,
        round(coalesce(avg(best_sim) FILTER (k), 0), 6) AS mean_sim
        FROM (SELECT *, any_phrase AND best_sim >= 0.25 AS k FROM signals) GROUP BY query_id""",
        "signals",
    ),
)
def _(spark, sf):
    return sc.scope_stats(hits_with_content(spark, sf), fx.scope_phrases(spark))


@query(
    "scope_discards",
    compose(
        """SELECT query_id, id, best_sim AS similarity, CAST(0.25 AS DOUBLE) AS threshold FROM signals
        WHERE NOT (any_phrase AND best_sim >= 0.25)""",
        "signals",
    ),
)
def _(spark, sf):
    return sc.scope_discards(hits_with_content(spark, sf), fx.scope_phrases(spark))


@query(
    "scope_sweep",
    compose(
        """SELECT query_id, threshold, count(*) FILTER (k) AS n_kept, count(*) FILTER (NOT k) AS n_dropped,
        coalesce(string_agg(id, ',' ORDER BY rank) FILTER (k), '') AS kept_ids,
        coalesce(string_agg(id, ',' ORDER BY rank) FILTER (NOT k), '') AS dropped_ids
        FROM (SELECT query_id, rank, id, CAST(t AS DOUBLE) AS threshold,
              coalesce(bool_or(sim >= coalesce(floor, t)), false) AND coalesce(max(sim) FILTER (sim >= coalesce(floor, t)), 0) >= t AS k
              FROM sims, (VALUES (0.1), (0.25), (0.5), (0.75)) AS v(t) GROUP BY query_id, rank, id, t) GROUP BY ALL""",
        "sims",
    ),
)
def _(spark, sf):
    return sc.scope_sweep(hits_with_content(spark, sf), fx.scope_phrases(spark), [0.1, 0.25, 0.5, 0.75])


@query(
    "suggest_phrases",
    compose(
        f"""SELECT phrase, tf, df, round(tf * (greatest(0.0, ln(n / df)) + 1), 6) AS score, CAST(1 AS DOUBLE) AS weight FROM
        (SELECT token AS phrase, count(*) AS tf, count(DISTINCT doc_id) AS df FROM
            (SELECT doc_id, unnest(string_split_regex(lower(text), '{NOT_WORD}')) AS token FROM documents)
            WHERE strlen(token) >= 3 AND token NOT IN ({", ".join(f"'{w}'" for w in ph.SUGGEST_STOP)}) GROUP BY token),
        (SELECT count(*) AS n FROM documents) ORDER BY score DESC, phrase LIMIT 8"""
    ),
)
def _(spark, sf):
    return ph.suggest_phrases(fx.table(spark, sf, "documents").select("doc_id", "text"))


CTE["kterms"] = (
    ("docs",),
    f"""SELECT id, term FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM (SELECT DISTINCT id, term FROM
        (SELECT id, unnest(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}_-]+')) AS term FROM docs UNION ALL
         SELECT id, unnest(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}_-]+')) AS term FROM docs)
        WHERE strlen(term) > 3 AND term NOT IN ({", ".join(f"'{w}'" for w in ph.TERM_STOP)}))) WHERE df <= 2""",
)
CTE["kphrases"] = (
    ("docs",),
    r"""SELECT DISTINCT id, ca || ' ' || cb AS phrase FROM (SELECT id,
        regexp_replace(a, '^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$', '', 'g') AS ca,
        regexp_replace(b, '^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$', '', 'g') AS cb FROM
        (SELECT id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM (SELECT id, list_filter(string_split_regex(content, '"""
    + SPACE
    + r"""'), lambda x: x <> '') AS w FROM docs)) WHERE strlen(a) > 3 AND strlen(b) > 3
        AND (regexp_matches(a, '^\p{Lu}|[-_]') OR regexp_matches(b, '^\p{Lu}|[-_]'))) WHERE ca <> '' AND cb <> ''""",
)


@query("key_terms", compose("SELECT id, term FROM kterms", "kterms"))
def _(spark, sf):
    return ph.key_terms(fx.corpus(spark, sf))


@query(
    "key_phrases",
    compose("SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY phrase) AS INTEGER) AS pos, phrase FROM kphrases", "kphrases"),
)
def _(spark, sf):
    return ph.key_phrases(fx.corpus(spark, sf)).select("id", F.posexplode("phrases").alias("p", "phrase")).select(
        "id", (F.col("p") + 1).alias("pos"), "phrase"
    )


@query(
    "hybrid_sim",
    compose(
        """SELECT a.id, a.label, round(CASE WHEN lex >= 0.1 AND lex < 0.55 THEN 0.5 * lex
            + 0.5 * greatest(0.0, least(1.0, list_cosine_similarity(a.embedding, b.c))) ELSE lex END, 6) AS sim FROM
        (SELECT *, label / 10.0 AS lex FROM vecs) a JOIN (SELECT label, arg_min(embedding, id) AS c FROM vecs GROUP BY label) b
        USING (label)""",
        "vecs",
    ),
)
def _(spark, sf):
    v = fx.vectors(spark, sf)
    anchor = v.groupBy("label").agg(F.min_by("embedding", "id").alias("anchor"))
    sim = sc.hybrid_sim(F.col("label") / 10, F.col("embedding"), F.col("anchor"), sc.ScopeConfig())
    return v.join(anchor, "label").select("id", "label", round6(sim).alias("sim"))
