"""One query per operator of this subpackage, over its whole table, with SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import bpe, divergence, html_text, lexical, licenses, neardup, packing, pieces, pii, quality, rules, topk, warc
from rankloom.llm.registry import QUERIES, SQL, query, read

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def load():
    """(queries, sql) of this subpackage."""
    return QUERIES, SQL


@query("op7_bpe")
def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's ids, counted and digested, and the digest of what they decode to."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, VOCABULARY, drop=("text",))
    back = bpe.decode(coded.withColumn("ids_sha256", F.sha2("ids", 256)), VOCABULARY, drop=("ids",))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


_STOP = ", ".join(f"'{x}'" for x in sorted({v for s in rules.STOP_WORDS for v in (s, s.capitalize())}))
_RULES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "stop_word_share": "n_stop / n_words",
    "upper_share": "n_upper / word_chars",
    "duplicate_line_share": "n_dup_lines / n_lines",
    "repeated_word_share": "n_repeat_words / n_words",
    "bullet_line_share": "n_bullets / n_lines",
    "distinct_word_share": "n_distinct / n_words",
}
_FAILS = " OR ".join(
    f"(n_words >= {r.min_words} AND {_RULES[r.metric]} {'< ' + str(r.least) if r.least is not None else '> ' + str(r.most)})" for r in rules.THRESHOLDS
)
RULES_CTE = rf"""
d AS (SELECT *, row_number() OVER () AS r, coalesce(text, '') AS t FROM {{table}}),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) > 4)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
counted AS (
  SELECT w.* EXCLUDE (w, l, t), len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '\p{{{{Lu}}}}')) AS n_upper,
         len([x for x in w if trim(x, '.,;:!?"''()') IN ({_STOP})]) AS n_stop, len(list_distinct(w)) AS n_distinct,
         len([x for x in l if regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')]) AS n_bullets
  FROM w LEFT JOIN covered USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
ruled AS (SELECT *, NOT base_failed AND NOT coalesce({_FAILS}, false) AS kept FROM judged)"""


@query(
    "op8_rules",
    "WITH " + RULES_CTE.format(table="documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM ruled""",
)
def op8_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's counts and verdict by the whole table of thresholds."""
    judged = rules.apply_rules(read(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_dart_minhash")
def op4_dart_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's class of copies and near copies, and how many rows have its very words."""
    return neardup.with_classes(read(spark, sf, "documents"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's chance of being good, with the evidence and the rate of its site that it comes from."""
    return quality.classify(read(spark, sf, "documents"), read(spark, sf, "labels"), keep=("source", "lang"))


@query("op5_pack")
def op5_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's pieces in sequences of 4096 ids that all hold the sources in the corpus's proportions."""
    return packing.pack(read(spark, sf, "documents"), VOCABULARY)


@query("op2_pii")
def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's personal data, and the terms beside it that disclose it."""
    found = pii.sanitise(read(spark, sf, "documents").select("doc_id", "text"), form=None, keep_texts="found")
    counts = [F.get("_n", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.spelled("_base"), 256).alias("base_sha256"), pii.spelled("_spans").alias("spans"))


@query(
    "op1_topk",
    """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([a * c.v[i] for a, i in q.v]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20""",
)
def op1_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return topk.top_k(read(spark, sf, "embeddings"), F.col("_id") % 20 == 0)


@query("op3_html_text")
def op3_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's main text."""
    pages = html_text.extract(read(spark, sf, "pages").select("page_id", "url", "html"), drop=("html",))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def _duck(pattern: str) -> str:
    return pattern.replace("'", "''")


def _canonical_sql(unit: str) -> str:
    bare = f"trim(regexp_replace(lower(regexp_replace({unit}, '{_duck(licenses.COPYRIGHT)}', '', 'g')), '{_duck(licenses.WORDLESS)}', ' ', 'g'))"
    for pattern, to in licenses.EQUIVALENT:
        bare = f"regexp_replace({bare}, '{_duck(pattern)}', '{to.replace('$', chr(92))}', 'g')"
    return f"sha256({bare})"


_DIGEST_ROWS = ", ".join(f"('{k}', '{d}')" for k, _, _, d in licenses.DIGESTS)
_KNOWN_ROWS = ", ".join(f"('{k}', '{_duck(t)}')" for k, t in licenses.KNOWN)


@query(
    "op9_licenses",
    f"""
WITH known AS (SELECT license, {_canonical_sql('unit')} AS digest FROM (VALUES {_KNOWN_ROWS}) AS t(license, unit)
    UNION SELECT * FROM (VALUES {_DIGEST_ROWS}) AS t(license, digest)),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS u FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
units AS (SELECT doc_id, 0 AS unit, text AS u FROM documents WHERE text IS NOT NULL UNION ALL SELECT * FROM lines),
digests AS (SELECT doc_id, unit, {_canonical_sql('u')} AS digest FROM units)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, license, digest FROM digests JOIN known USING (digest)""",
)
def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text and every line that is a known licence or notice."""
    return licenses.scan(read(spark, sf, "documents"))


@query("op10_warc")
def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    """The metadata and conversion record of every page, with its record's digest in place of its bytes."""
    made = warc.derive(warc.responses(read(spark, sf, "pages")))
    return made.withColumn("record_sha256", warc.record_digest()).drop("record")


@query("op11_pieces")
def op11_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's piece ids, counted and digested, and the digest of what they decode to."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, PIECES, drop=("text",))
    back = pieces.decode(coded, PIECES)
    spelled = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return back.select("doc_id", "n_tokens", F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_AZ = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".replace("{text}", _AZ)


@query(
    "op12_lexical",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format(text='text')} AS t FROM documents WHERE text IS NOT NULL),
lens AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
size AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lens),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
q AS (SELECT DISTINCT item_id, unnest({_ALNUM.format(text='text')}) AS term FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN lens USING (r), size GROUP BY item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM
  (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0) WHERE rank <= 10""",
)
def op12_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(lexical.build_index(read(spark, sf, "documents")), read(spark, sf, "benchmark"))


_LETTERS = _ALNUM.replace(r"\x2F\x3A-", "")


@query(
    "op13_divergence",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS.format(text="coalesce(text, '')")} AS t FROM documents),
tf AS (SELECT lang, source, r, term, count(*) AS c FROM (SELECT lang, source, r, unnest(t) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(c)::HUGEINT AS total FROM tf GROUP BY lang, term HAVING count(*) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, sum(c)::HUGEINT AS c FROM tf JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(n, 0) AS n
           FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN (SELECT lang, v FROM langs) USING (lang)
           LEFT JOIN (SELECT lang, source, sum(c)::HUGEINT AS n FROM counts GROUP BY ALL) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (g.n + 2 * g.v) AS p, coalesce(c, 0) AS c,
             1 + (1000000000 * (k.total + 2)) // (l.n + 2 * l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
)
def op13_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Every source's divergence from every other of its language, and the terms that set it apart from the language."""
    return divergence.audit(read(spark, sf, "documents"))
