"""Queries on text and vector search, semantic matches and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import fixtures as fx
from rankloom.catalog.base import query
from rankloom.catalog.ctes import CTE, compose
from rankloom.functions.scores import round6
from rankloom.operators import embed, search_text, search_vector
from rankloom.operators.vector_index import VectorIndex, semantic_match_indexed
from rankloom.session import cut, work_dir

HITS = """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score
    FROM bm QUALIFY rank <= {k}"""
CTE["hits5"] = (("bm",), HITS.format(k=5))
CTE["hits10"] = (("bm",), HITS.format(k=10))


@query("text_search", compose("SELECT * FROM hits5", "hits5"))
def _(spark, sf):
    return search_text.text_search(fx.benchmark_queries(spark, sf), fx.corpus(spark, sf), top_k=5)


@query(
    "text_search_min_score",
    compose(
        """SELECT * FROM (SELECT query_id, rank, id, round(CASE WHEN m > 0 THEN least(1.0, score / m) ELSE 0 END, 6) AS score
        FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM hits10)) WHERE score >= 0.5""",
        "hits10",
    ),
)
def _(spark, sf):
    return search_text.text_search(
        fx.benchmark_queries(spark, sf), fx.corpus(spark, sf), top_k=10, normalized=True, min_score=0.5
    )


@query(
    "corpus_statistics",
    compose("SELECT field, token, df, n, avgdl AS avg_length FROM dfreq JOIN fstat USING (field)", "dfreq", "fstat"),
)
def _(spark, sf):
    return search_text.corpus_statistics(fx.corpus(spark, sf), ("content", "title"))


def _nearest(sim: str) -> str:
    return compose(
        f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score
        FROM (SELECT a.id AS query_id, b.id, round({sim}, 6) AS score FROM vecs a JOIN vecs b ON a.id <> b.id)
        QUALIFY rank <= 5""",
        "vecs",
    )


def _self_search(metric):
    def run(spark, sf):
        v = fx.vectors(spark, sf)
        return search_vector.vector_search(
            v.withColumnRenamed("id", "query_id"), v, metric=metric, top_k=5, skip_same=True
        )

    return run


for metric, sim in (
    ("cosine", "list_cosine_similarity(a.embedding, b.embedding)"),
    ("l2", "1 / (1 + list_distance(a.embedding, b.embedding))"),
    ("ip", "list_inner_product(a.embedding, b.embedding)"),
):
    query(f"vector_search_{metric}", _nearest(sim))(_self_search(metric))


BUCKETS = """SELECT id, embedding, t, sum(CASE WHEN dotp >= 0 THEN 1 << CAST(b AS BIGINT) ELSE 0 END) AS bucket FROM (
    SELECT id, embedding, t, b, list_inner_product(embedding, list_transform(range(1, 65),
        lambda i: sin((t * 4.0 + b + 1) * (t * 4.0 + b + 1) + 7 * (t * 4.0 + b + 1) * i + i * i))) AS dotp
    FROM vecs, range(0, 8) AS tt(t), range(0, 4) AS bb(b)) GROUP BY ALL"""
LSH = """SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score
    FROM (SELECT DISTINCT a.id AS query_id, b.id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score
    FROM buck a JOIN buck b ON a.t = b.t AND a.bucket = b.bucket AND a.id <> b.id) QUALIFY rank <= 5"""


def _lsh(spark, sf):
    v = fx.vectors(spark, sf)
    return search_vector.vector_search_lsh(v.withColumnRenamed("id", "query_id"), v, dim=64, top_k=5, skip_same=True)


query("vector_search_lsh", compose(LSH, "vecs", buck=BUCKETS))(_lsh)


@query(
    "lsh_recall",
    compose(
        """SELECT e.query_id, round(count(f.id) / count(*), 6) AS recall FROM e LEFT JOIN f USING (query_id, id)
        GROUP BY e.query_id""",
        "vecs", buck=BUCKETS, f=LSH,
        e=_nearest("list_cosine_similarity(a.embedding, b.embedding)"),
    ),
)
def _(spark, sf):
    return search_vector.recall(_lsh(spark, sf), _self_search("cosine")(spark, sf))


@query(
    "semantic_match",
    compose(
        """SELECT v.id AS query_id, CASE WHEN sim >= 0.35 THEN key END AS matched_key, sim, coalesce(sim >= 0.35, false) AS hit
        FROM vecs v LEFT JOIN (SELECT a.id AS query_id, b.id AS key,
            round(list_cosine_similarity(a.embedding, b.embedding), 6) AS sim
            FROM vecs a JOIN vecs b ON a.label = b.label AND a.id <> b.id
            QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY sim DESC, b.id) = 1) ON query_id = v.id""",
        "vecs",
    ),
)
def _(spark, sf):
    v = fx.vectors(spark, sf)
    return search_vector.semantic_match(
        v.withColumnRenamed("id", "query_id"), v, tau=0.35, within=("label",), skip_same=True
    )


def texts(spark, sf):
    """All documents, benchmark passages and messages as one table of texts."""
    return (
        fx.table(spark, sf, "documents")
        .select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
        .unionByName(
            fx.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
        )
        .unionByName(
            fx.table(spark, sf, "conversations").select(
                F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"),
                "text",
            )
        )
    )


TEXTS = """SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark
    UNION ALL SELECT 'm' || conv_id || '.' || turn, text FROM conversations"""


def bow_sql(source: str, columns: str = "id", text: str = "text") -> str:
    """(columns, axis, n): token counts per hash axis of a table of texts."""
    from rankloom.catalog.ctes import NOT_WORD

    return f"""SELECT {columns}, CAST('0x' || md5(token)[1:8] AS BIGINT) % 128 AS axis, CAST(count(*) AS DOUBLE) AS n FROM
        (SELECT {columns}, unnest(string_split_regex(lower({text}), '{NOT_WORD}')) AS token FROM {source})
        WHERE token <> '' GROUP BY ALL"""


@query(
    "embed_texts",
    compose(
        """SELECT id, CAST(axis AS INTEGER) AS axis, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS component
        FROM bow""",
        t=TEXTS, bow=bow_sql("t"),
    ),
)
def _(spark, sf):
    vectors = embed.embed_texts(texts(spark, sf), "text")
    long = vectors.select("id", F.posexplode("embedding").alias("axis", "x"))
    return long.filter(F.col("x") != 0).select("id", "axis", round6("x").alias("component"))


@query(
    "embed_missing",
    compose("SELECT lang, count(*) AS rows, count(DISTINCT text) AS computed FROM t GROUP BY lang",
            t="SELECT lang, text FROM documents WHERE text NOT IN (SELECT text FROM benchmark)"),
)
def _(spark, sf):
    """Rows and texts to compute per language when the benchmark passages are embedded already."""
    docs = fx.table(spark, sf, "documents").withColumn("text_key", F.sha2("text", 256))
    known = fx.table(spark, sf, "benchmark").select(F.sha2("text", 256).alias("text_key"))
    return (
        docs.join(known, "text_key", "left_anti")
        .groupBy("lang", "text_key")
        .agg(F.count("*").alias("n"))
        .groupBy("lang")
        .agg(F.sum("n").alias("rows"), F.count("*").alias("computed"))
    )


@query(
    "embed_texts_known",
    compose(
        """SELECT id, CAST(axis AS INTEGER) AS axis, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS component
        FROM bow""",
        t=TEXTS, bow=bow_sql("t"),
    ),
)
def _(spark, sf):
    """All texts, with the vectors of the documents from an earlier run."""
    store = embed.VectorStore(spark, work_dir(spark, "vectors"))
    store.embed(fx.table(spark, sf, "documents"), "text")
    vectors = embed.embed_texts(texts(spark, sf), "text", known=store.known())
    long = vectors.select("id", F.posexplode("embedding").alias("axis", "x"))
    return long.filter(F.col("x") != 0).select("id", "axis", round6("x").alias("component"))


@query(
    "vector_store_runs",
    compose(
        r"""SELECT 1 AS run, count(*) AS rows, (SELECT count(DISTINCT text) FROM benchmark WHERE text SIMILAR TO '(.|\n)*[\p{L}\p{N}](.|\n)*') AS computed FROM benchmark
        UNION ALL SELECT 2, count(*), count(DISTINCT text) FILTER (text SIMILAR TO '(.|\n)*[\p{L}\p{N}](.|\n)*' AND text NOT IN (SELECT text FROM benchmark)) FROM t
        UNION ALL SELECT 3, count(*), 0 FROM t""",
        t=TEXTS,
    ),
)
def _(spark, sf):
    """Three runs of one store: the benchmark, everything, everything again."""
    store = embed.VectorStore(spark, work_dir(spark, "vectors"))
    bench, every = fx.table(spark, sf, "benchmark").select("text"), texts(spark, sf).select("text")
    told = []
    for run, rows in enumerate((bench, every, every), 1):
        found, computed = store.embed(rows, "text")
        told.append(found.agg(F.lit(run).alias("run"), F.count("embedding").alias("rows"), F.lit(computed).cast("bigint").alias("computed")))
    return told[0].unionByName(told[1]).unionByName(told[2])


@query(
    "semantic_index_recall",
    compose(
        "SELECT lang, count(*) FILTER (sim >= 0.99) AS matches, true AS reached FROM pairs GROUP BY lang",
        dbow_=bow_sql("documents", "doc_id, lang", "text"),
        dv="""SELECT d.doc_id AS seq, any_value(d.lang) AS lang, list(coalesce(b.n, 0.0) ORDER BY x.axis) AS v,
        greatest(sqrt(sum(coalesce(b.n, 0.0) ** 2)), 1e-9) AS norm FROM documents d CROSS JOIN range(0, 128) x(axis)
        LEFT JOIN dbow_ b ON b.doc_id = d.doc_id AND b.axis = x.axis GROUP BY d.doc_id""",
        pairs="""SELECT a.seq, max(round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 6)) AS sim, any_value(a.lang) AS lang FROM dv a
        JOIN dv b ON a.lang = b.lang AND a.seq <> b.seq GROUP BY a.seq""",
    ),
)
def _(spark, sf):
    """Per language, documents with another one nearer than 0.99, and whether the index finds nine tenths of them or more."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    vectors = cut(embed.embed_texts(docs, "text").drop("text"))
    queries = vectors.withColumnRenamed("id", "query_id")
    exact = search_vector.vector_search(queries, vectors, top_k=1, min_score=0.99, within=("lang",), skip_same=True)
    found = semantic_match_indexed(queries, VectorIndex(vectors, keys=("lang",)), 0.99, skip_same=True)
    # only the near ones are kept, but every document with another one in its language counts
    others = vectors.groupBy("lang").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("lang")
    asked = queries.join(others, "lang").select("query_id").distinct().join(exact.select("query_id", "score"), "query_id", "left")
    both = asked.join(found, "query_id").join(queries.select("query_id", "lang"), "query_id")
    near = F.coalesce(F.col("score") >= 0.99, F.lit(False))
    return both.groupBy("lang").agg(F.count_if(near).alias("matches"), (F.count_if(near & F.col("hit")) >= 0.9 * F.count_if(near)).alias("reached"))
