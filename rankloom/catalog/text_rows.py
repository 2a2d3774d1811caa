"""Queries on texts, keys, checks and scores of single rows."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog.base import query
from rankloom.catalog.ctes import SPACE, compose
from rankloom.functions import scores, text, ttl, vectors
from rankloom.operators import fingerprint, keys, staleness, validation
from rankloom.session import small


def norm(e: str) -> str:
    return f"regexp_replace(lower(regexp_replace({e}, '^{SPACE}|{SPACE}$', '', 'g')), '{SPACE}', ' ', 'g')"



def messages(spark, sf):
    """Every message three times: as it is, in capitals, and padded with other white space."""
    variant = F.explode(
        F.array(
            F.struct(F.lit(0).alias("v"), F.col("text").alias("query")),
            F.struct(F.lit(1).alias("v"), F.translate("text", ascii_lowercase, ascii_uppercase).alias("query")),
            F.struct(F.lit(2).alias("v"), F.concat(F.lit("\u00a0\t"), F.regexp_replace("text", " ", "  ")).alias("query")),
        )
    )
    base = fx.table(spark, sf, "conversations").select("conv_id", "turn", "role", variant.alias("m"))
    return base.select(
        "conv_id",
        "turn",
        F.col("m.v").alias("variant"),
        F.col("m.query").alias("query"),
        F.col("role").alias("context_id"),
        (F.col("m.v") * 1_000_000_000 + F.col("conv_id") * 1000 + F.col("turn")).cast("bigint").alias("seq"),
    )


MESSAGES = f"""SELECT conv_id, turn, v AS variant, role AS context_id,
    CASE v WHEN 0 THEN text WHEN 1 THEN translate(text, '{ascii_lowercase}', '{ascii_uppercase}') ELSE chr(160) || chr(9) || replace(text, ' ', '  ') END AS query,
    CAST(v * 1000000000 + conv_id * 1000 + turn AS BIGINT) AS seq
    FROM conversations, (VALUES (0), (1), (2)) AS t(v)"""


@query(
    "normalize_query",
    compose(f"SELECT seq, {norm('query')} AS normalized FROM m", m=MESSAGES),
)
def _(spark, sf):
    return messages(spark, sf).select("seq", text.normalize_query("query").alias("normalized"))


KEYED = f"""SELECT *, sha256({norm("'ctx:' || context_id || ':' || query")}) AS norm_key,
    sha256(query) AS exact_key FROM m"""


@query("query_keys", compose("SELECT seq, norm_key, exact_key FROM k", m=MESSAGES, k=KEYED))
def _(spark, sf):
    return messages(spark, sf).select(
        "seq", text.query_key("query", "context_id").alias("norm_key"), text.exact_key("query").alias("exact_key")
    )


@query(
    "key_collapse",
    compose(
        """SELECT seq, context_id, norm_key,
            CASE WHEN row_number() OVER (PARTITION BY norm_key, exact_key ORDER BY seq) > 1 THEN 'exact'
                 WHEN row_number() OVER (PARTITION BY norm_key ORDER BY seq) > 1 THEN 'normalized'
                 ELSE 'miss' END AS hit_kind FROM k""",
        m=MESSAGES, k=KEYED,
    ),
)
def _(spark, sf):
    return keys.key_collapse(messages(spark, sf))


@query(
    "collapse_counts",
    compose(
        "SELECT norm_key, count(DISTINCT exact_key) AS exact_keys, count(*) AS accesses FROM k GROUP BY norm_key",
        m=MESSAGES, k=KEYED,
    ),
)
def _(spark, sf):
    return keys.collapse_counts(messages(spark, sf))


@query(
    "slugify",
    "SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug"
    " FROM documents",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.slugify("text").alias("slug"))


@query("apply_prefix", "SELECT item_id, 'release notes' || ' ' || text AS query FROM benchmark")
def _(spark, sf):
    return fx.table(spark, sf, "benchmark").select("item_id", text.apply_prefix("text", "release notes").alias("query"))


@query(
    "validate_queries",
    compose(
        f"""SELECT query_id, CASE WHEN regexp_replace(query, '^{SPACE}|{SPACE}$', '', 'g') = '' THEN 'empty_query'
            WHEN strlen(query) > 10000 THEN 'query_too_long'
            WHEN regexp_matches(query, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F]') THEN 'control_char'
            WHEN top_k > 1000 THEN 'top_k_too_large' END AS error_code,
            CAST(least(coalesce(top_k, 10), 1000) AS INTEGER) AS effective_top_k FROM q""",
        q="""SELECT doc_id AS query_id, CASE lang WHEN 'de' THEN text || chr(1) WHEN 'es' THEN chr(160) || ' '
            ELSE text END AS query, CASE WHEN lang = 'fr' THEN NULL ELSE 900 + n_chars % 200 END AS top_k FROM documents""",
    ),
)
def _(spark, sf):
    lang = F.col("lang")
    rows = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("query_id"),
        F.when(lang == "de", F.concat("text", F.lit("\x01"))).when(lang == "es", "\u00a0 ").otherwise(F.col("text")).alias(
            "query"
        ),
        F.when(lang != "fr", 900 + F.pmod("n_chars", F.lit(200))).cast("int").alias("top_k"),
    )
    return validation.validate_queries(rows).select("query_id", "error_code", "effective_top_k")


def responses(spark, sf):
    """One response per source and language: its documents in order of their ids."""
    d = fx.table(spark, sf, "documents")
    return d.select(
        F.concat_ws("/", "source", "lang").alias("query_id"),
        F.col("doc_id").alias("rank"),
        F.col("doc_id").alias("id"),
        F.when(F.pmod("n_chars", F.lit(97)) == 0, float("nan")).otherwise(F.col("n_chars") / 1000).alias("score"),
        F.when(F.pmod("n_chars", F.lit(89)) == 0, F.concat("text", F.lit("\x7f"))).otherwise(F.col("text")).alias("content"),
        F.concat(F.lit('{"source":"'), "source", F.lit('"}')).alias("metadata"),
        "lang",
    )


RESPONSES = """SELECT source || '/' || lang AS query_id, doc_id AS rank, doc_id AS id,
    CASE WHEN n_chars % 97 = 0 THEN 'nan'::DOUBLE ELSE n_chars / 1000 END AS score,
    CASE WHEN n_chars % 89 = 0 THEN text || chr(127) ELSE text END AS content,
    '{"source":"' || source || '"}' AS metadata, lang FROM documents"""


@query(
    "validate_responses",
    compose(
        """SELECT query_id, CASE WHEN count(*) > 1000 THEN 'too_many_results'
            WHEN min(rank) FILTER (code IS NOT NULL) IS NOT NULL THEN arg_min(code, rank) FILTER (code IS NOT NULL)
            WHEN sum(strlen(id::VARCHAR) + strlen(content) + 32 + strlen(metadata)) > 10485760 THEN 'response_too_large' END
            AS error_code,
            CASE WHEN count(*) <= 1000 THEN (arg_min(id, rank) FILTER (code IS NOT NULL))::VARCHAR END AS bad_result_id
            FROM (SELECT *, CASE WHEN isnan(score) THEN 'invalid_score' WHEN strlen(content) > 100000 THEN 'content_too_long'
                WHEN regexp_matches(content, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]') THEN 'content_control_char'
                END AS code FROM r) GROUP BY query_id""",
        r=RESPONSES,
    ),
)
def _(spark, sf):
    return validation.validate_responses(responses(spark, sf))


@query(
    "check_timestamps",
    """SELECT event_id, CASE WHEN g > 1706400000000 + 5000 THEN 'future' WHEN g < 1706400000000 - 864000000 THEN 'too_old'
        ELSE 'ok' END AS time_check FROM
        (SELECT event_id, CASE WHEN event_type <> 'signup' THEN epoch_ms(ts) END AS g FROM events)""",
)
def _(spark, sf):
    rows = fx.table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") != "signup", F.unix_millis(F.col("ts").cast("timestamp"))).alias("generated_at"),
    )
    return validation.check_timestamps(rows, 864_000_000, 1_706_400_000_000, 5000).select("event_id", "time_check")


def _hash_sql(content: str) -> str:
    return f"""SELECT query_id, lang, sha256(concat_ws(':', count(*), bit_xor(x0), bit_xor(x1), bit_xor(x2), bit_xor(x3)))
        AS content_hash FROM (SELECT query_id, lang, CAST('0x' || d[1:15] AS BIGINT) AS x0, CAST('0x' || d[16:30] AS BIGINT)
        AS x1, CAST('0x' || d[31:45] AS BIGINT) AS x2, CAST('0x' || d[46:60] AS BIGINT) AS x3 FROM
        (SELECT query_id, lang, sha256(concat_ws(chr(1), rank, id, CAST(round(score * 1e6) AS BIGINT), {content}, metadata))
        AS d FROM c)) GROUP BY query_id, lang"""


CLEAN = "SELECT * EXCLUDE (score), CASE WHEN isnan(score) THEN 0 ELSE score END AS score FROM r"


def _clean(spark, sf):
    r = responses(spark, sf)
    return r.withColumn("score", F.when(F.isnan("score"), 0.0).otherwise(F.col("score")))


@query("content_hash", compose("SELECT query_id, content_hash FROM h", r=RESPONSES, c=CLEAN, h=_hash_sql("content")))
def _(spark, sf):
    return validation.content_hash(_clean(spark, sf), ["query_id"])


def hashed_entries(spark, sf):
    """Responses with the hash stored at insertion: English ones altered since, German ones without hash."""
    rows = _clean(spark, sf)
    lang = F.col("lang")
    stored = validation.content_hash(rows, ["query_id", "lang"]).select(
        "query_id", F.when(lang != "de", F.col("content_hash")).alias("stored_hash")
    )
    altered = rows.withColumn("content", F.when(lang == "en", F.upper("content")).otherwise(F.col("content")))
    return validation.content_hash(altered, ["query_id"]).join(stored, "query_id")


HASHED = dict(
    r=RESPONSES, c=CLEAN, h0=_hash_sql("content"),
    h1=_hash_sql("CASE WHEN lang = 'en' THEN upper(content) ELSE content END"),
    e="""SELECT h1.query_id, h1.content_hash, CASE WHEN h0.lang <> 'de' THEN h0.content_hash END AS stored_hash
        FROM h1 JOIN h0 USING (query_id)""",
)


@query(
    "integrity_report",
    compose(
        """SELECT count(*) AS total, count(*) FILTER (stored_hash = content_hash) AS valid,
        count(*) FILTER (stored_hash <> content_hash) AS invalid, count(*) FILTER (stored_hash IS NULL) AS missing FROM e""",
        **HASHED,
    ),
)
def _(spark, sf):
    return validation.integrity_report(hashed_entries(spark, sf))


@query(
    "drop_corrupted",
    compose("SELECT query_id, content_hash, stored_hash FROM e WHERE stored_hash IS NULL OR stored_hash = content_hash", **HASHED),
)
def _(spark, sf):
    return validation.drop_corrupted(hashed_entries(spark, sf))


@query(
    "schema_fingerprint",
    """SELECT id, CASE WHEN label % 4 = 3 THEN 128 ELSE dims END AS embedding_dims,
        CASE WHEN label % 4 IN (0, 2) THEN 'm' || label END AS model_hint,
        CASE WHEN label % 4 = 0 THEN 'v' || label END AS schema_version
        FROM (SELECT vec_id AS id, label, CAST(len(embedding) AS BIGINT) AS dims FROM embeddings)""",
)
def _(spark, sf):
    v = fx.vectors(spark, sf)
    label = F.col("label")
    n = F.size("embedding")
    model = F.concat(F.lit("m"), label.cast("string"))
    shape = F.pmod(label, F.lit(4))
    body = (
        F.when(
            shape == 0,
            F.to_json(
                F.struct(F.lit("x").alias("embedding_dims"), n.alias("dim"), model.alias("model"),
                         F.concat(F.lit("v"), label.cast("string")).alias("api_version"))
            ),
        )
        .when(shape == 1, F.to_json(F.struct(F.array(F.struct(F.col("id"), F.col("embedding").alias("vector"))).alias("results"))))
        .when(shape == 2, F.to_json(F.struct(F.struct(n.alias("dimensions"), model.alias("embedding_model")).alias("meta"))))
        .otherwise(F.to_json(F.struct(F.lit(128).alias("vector_size"), label.alias("model"))))
    )
    return fingerprint.schema_fingerprint(v.select("id", body.alias("body")), "body").drop("body")


OBSERVED = """SELECT upstream_id, ts, request_id AS seq, CASE event_type WHEN 'view' THEN 64 WHEN 'purchase' THEN 128 END AS dims,
    CASE WHEN event_type <> 'error' THEN 'm' || CAST(day(ts) AS BIGINT) // 7 END AS model FROM log"""


@query(
    "schema_changes",
    compose(
        """SELECT * FROM (SELECT *, lag(dims) OVER w AS prev_dims, lag(model) OVER w AS prev_model FROM o
        WINDOW w AS (PARTITION BY upstream_id ORDER BY ts, seq)) WHERE dims <> prev_dims OR model <> prev_model""",
        "log", o=OBSERVED,
    ),
)
def _(spark, sf):
    kind = F.col("event_type")
    obs = fx.request_log(spark, sf).select(
        "upstream_id",
        "ts",
        F.col("request_id").alias("seq"),
        F.when(kind == "view", 64).when(kind == "purchase", 128).alias("dims"),
        F.when(kind != "error", F.concat(F.lit("m"), F.floor(F.dayofmonth("ts") / 7).cast("string"))).alias("model"),
    )
    return fingerprint.schema_changes(obs)


@query(
    "stale_content",
    compose(
        """SELECT cluster_id, seq, content, content_version, version AS latest_version FROM
        (SELECT cluster_id, seq, 'cluster ' || cluster_id || ' v' || day(ts) AS content, CAST(day(ts) AS BIGINT) AS content_version
         FROM trace) JOIN (SELECT cluster_id, CAST(max(day(ts)) - 7 AS BIGINT) AS version FROM changes GROUP BY cluster_id)
         USING (cluster_id) WHERE content_version < version""",
        "trace", "changes",
    ),
)
def _(spark, sf):
    hits = fx.trace(spark, sf).select(
        "cluster_id",
        "seq",
        F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"), F.lit(" v"), F.dayofmonth("ts").cast("string")).alias(
            "content"
        ),
    )
    latest = fx.content_changes(spark, sf).groupBy("cluster_id").agg(
        (F.max(F.dayofmonth("ts")) - 7).cast("bigint").alias("version")
    )
    return staleness.stale_content(hits, latest, "cluster_id")


@query(
    "normalize_scores",
    """SELECT event_id, round(CASE WHEN m > 0 THEN greatest(0, least(1, value / m)) ELSE 0 END, 6) AS by_max,
        round(1 - d, 6) AS cosine, round(1 / (1 + d), 6) AS l2, round(-d, 6) AS ip, round(greatest(0.0, least(1.0, 1 - d)), 6)
        AS clamped, round(greatest(0.0, least(1.0, value / 100)), 6) AS fts, round(greatest(0.0, least(1.0, value)), 6) AS degenerate
        FROM (SELECT event_id, value, value / 100 AS d, max(value) OVER (PARTITION BY event_type) AS m FROM events)""",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    top = e.groupBy("event_type").agg(F.max("value").alias("m"))
    d, v = F.col("value") / 100, F.col("value")
    low, high = (F.lit(x) for x in scores.LEG_RANGE["fts"])
    return e.join(small(top), "event_type").select(
        "event_id",
        scores.round6(scores.by_max_score(v, F.col("m"))).alias("by_max"),
        *[scores.round6(scores.from_distance(d, k)).alias(a) for k, a in
          (("cosine", "cosine"), ("l2", "l2"), ("ip", "ip"), ("clamped_cosine", "clamped"))],
        scores.round6(scores.leg_normalized(v, low, high)).alias("fts"),
        scores.round6(scores.leg_normalized(v, F.lit(1.0), F.lit(1.0))).alias("degenerate"),
    )


@query(
    "l2_normalize",
    compose(
        """SELECT id, pos, round(x / sqrt(n), 6) AS component FROM (SELECT id, unnest(embedding) AS x,
        CAST(generate_subscripts(embedding, 1) AS INTEGER) - 1 AS pos, list_sum(list_transform(embedding, lambda y: y * y)) AS n
        FROM vecs)""",
        "vecs",
    ),
)
def _(spark, sf):
    v = fx.vectors(spark, sf)
    unit = v.select("id", F.posexplode(vectors.l2_normalize("embedding")).alias("pos", "x"))
    return unit.select("id", "pos", scores.round6("x").alias("component"))


@query(
    "label_cosine",
    compose(
        """SELECT id, label, round(list_cosine_similarity(embedding, c), 6) AS sim FROM vecs JOIN
        (SELECT label, arg_min(embedding, id) AS c FROM vecs GROUP BY label) USING (label)""",
        "vecs",
    ),
)
def _(spark, sf):
    v = fx.vectors(spark, sf)
    anchor = v.groupBy("label").agg(F.min_by("embedding", "id").alias("anchor"))
    return v.join(anchor, "label").select("id", "label", scores.round6(vectors.cosine("embedding", "anchor")).alias("sim"))


@query(
    "jittered_ttl",
    compose(
        """SELECT seq, CAST(300 + floor(300 * (CAST('0x' || exact_key[1:2] AS BIGINT) / 255.0) * 0.1) AS DOUBLE) AS ttl
        FROM k""",
        m=MESSAGES, k=KEYED,
    ),
)
def _(spark, sf):
    return messages(spark, sf).select("seq", ttl.jittered_ttl(300, text.exact_key("query")).alias("ttl"))
