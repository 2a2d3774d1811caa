"""Named SQL fragments that the SQL twins are composed of."""

from __future__ import annotations

SPACE = r"[\s\x0B\x85\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}]+"

# name -> (fragments it needs, select)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "qtext": ((), "SELECT item_id AS query_id, text AS query, 5 AS top_k, 'bench' AS context_id FROM benchmark"),
    "docs": (
        (),
        f"""SELECT doc_id AS id, text AS content, source AS corpus, lang AS topic,
            array_to_string(list_filter(string_split_regex(text, '{SPACE}'), lambda w: w <> '')[1:5], ' ') AS title
            FROM documents""",
    ),
    "log": (
        (),
        """SELECT event_id AS request_id, ts, user_id AS client_id, 'c' || (user_id % 4) AS context_id,
            'u' || (user_id % 5) AS upstream_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS key,
            event_type, value AS latency_ms, event_type <> 'error' AS success,
            CASE WHEN event_type IN ('view','click') THEN 'hit' WHEN event_type = 'purchase' THEN 'stale'
                 ELSE 'miss' END AS cache_status,
            CASE event_type WHEN 'signup' THEN 'not_in_cache' WHEN 'error' THEN 'upstream_error' END AS miss_reason
            FROM events""",
    ),
    "trace": (("log",), "SELECT request_id AS seq, ts, key, key % 30 AS cluster_id, context_id FROM log"),
    "changes": (("log",), "SELECT key % 30 AS cluster_id, ts FROM log WHERE event_type = 'purchase'"),
    "vecs": ((), "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings"),
}


def compose(body: str, *names: str, **extra: str) -> str:
    """``body`` behind a WITH clause of the named fragments, their needs first; ``extra`` comes last."""
    done: list[str] = []

    def visit(n: str):
        for need in CTE[n][0]:
            visit(need)
        if n not in done:
            done.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTE[n][1]})" for n in done] + [f"{n} AS ({s})" for n, s in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def bm25(prefix: str, queries: str, docs: str) -> None:
    """Add the fragments of a BM25 search of ``queries`` over ``docs``; ``{prefix}bm`` has its scores."""
    p = prefix

    def split(e: str) -> str:
        return f"unnest(string_split_regex(lower({e}), '{NOT_WORD}')) AS token"

    CTE[f"{p}tok"] = (
        (docs,),
        f"""SELECT id, field, token, count(*) AS tf FROM (SELECT id, 'content' AS field, {split('content')} FROM {docs}
        UNION ALL SELECT id, 'title', {split('title')} FROM {docs}) WHERE token <> '' GROUP BY ALL""",
    )
    CTE[f"{p}dlen"] = ((f"{p}tok",), f"SELECT id, field, sum(tf) AS dl FROM {p}tok GROUP BY ALL")
    CTE[f"{p}fstat"] = (
        (f"{p}dlen",), f"SELECT field, count(*) AS n, avg(dl) AS avgdl FROM {p}dlen GROUP BY field",
    )
    CTE[f"{p}dfreq"] = ((f"{p}tok",), f"SELECT field, token, count(*) AS df FROM {p}tok GROUP BY ALL")
    CTE[f"{p}qt"] = (
        (queries,),
        f"""SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, {split('query')} FROM {queries})
        WHERE token <> '' GROUP BY ALL""",
    )
    CTE[f"{p}bm"] = (
        (f"{p}qt", f"{p}tok", f"{p}dfreq", f"{p}fstat", f"{p}dlen"),
        f"""SELECT query_id, id, round(max(s), 6) AS score FROM (SELECT query_id, id, field,
        sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
        FROM {p}qt JOIN {p}tok USING (token) JOIN {p}dfreq USING (field, token) JOIN {p}fstat USING (field)
        JOIN {p}dlen USING (id, field) GROUP BY ALL) GROUP BY query_id, id""",
    )


bm25("", "qtext", "docs")

CTE["cdc"] = (
    (),
    """SELECT event_id, origin_node_id, timestamp_ms, event_type, query_key, payload, upstream_id, context_id, absolute_expiry_ms,
    sequence FROM (SELECT event_id, value, 'n' || (user_id % 3) AS origin_node_id, (epoch_us(ts) // 1000) - (event_id * 7919) % 600000 AS timestamp_ms,
    CASE WHEN event_type IN ('signup', 'view') THEN 'insert' WHEN event_type = 'error' THEN 'remove'
         WHEN event_type = 'purchase' THEN 'fetch_start' ELSE 'fetch_cancel' END AS event_type,
    CASE WHEN event_type = 'error' AND value > 470 THEN '' ELSE json_extract_string(props, '$.k') END AS query_key,
    CASE WHEN value < 5 THEN '' ELSE 'json' END AS payload, 'u' || (user_id % 5) AS upstream_id, 'c' || (user_id % 4) AS context_id,
    CASE WHEN user_id % 2 = 0 THEN 0 ELSE (epoch_us(ts) // 1000) + 86400000 END AS absolute_expiry_ms,
    row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS sequence FROM events) WHERE value <= 480""",
)
