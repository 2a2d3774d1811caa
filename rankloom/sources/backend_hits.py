"""Hits out of the raw JSON responses of search backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import by_max_score, clamp01, round6
from rankloom.session import once

# Where each backend keeps the list, id, score and fields, and which fields are not metadata.
SHAPES = {
    "elasticsearch": {"list": "$.hits.hits", "id": ("_id",), "score": "_score", "fields": "_source",
                      "drop": ("content", "text", "body")},
    "meilisearch": {"list": "$.hits", "id": ("id", "uid"), "score": "_rankingScore", "fields": None,
                    "drop": ("id", "content", "text", "body", "_rankingScore", "_formatted")},
    "milvus": {"list": "$.data", "id": ("id",), "score": "distance", "fields": "entity",
               "drop": ("content", "text", "body", "vector", "id")},
    "qdrant": {"list": "$.result", "id": ("id",), "score": "score", "fields": "payload", "drop": ("content", "text", "body")},
}
CONTENT_FIELDS = ("content", "text", "body")


def parse_hits(raw: DataFrame, backend: str) -> DataFrame:
    """(query_id, rank, id, score, content, metadata) from (query_id, response) JSON rows.

    The content is the first of the known text fields (of a hit itself before those of its entity), ids may be text or numbers, and all
    other fields are metadata: a JSON object in which numbers, booleans and nested values keep their types. A hit without fields has none.
    A query's response may come in pages; a column ``offset`` then says how many of its hits lie before a page.
    """
    shape = SHAPES[backend]
    hits = F.try_variant_get(F.try_parse_json("response"), shape["list"], "array<variant>")
    # what a hit needs of its response is taken out first, so that no response travels with its hits
    top = F.get_json_object("response", "$.hits.max_score").cast("double") if backend == "elasticsearch" else F.lit(None).cast("double")
    before = F.col("offset") if "offset" in raw.columns else F.lit(0)
    told = once(raw.select("query_id", "response", before.alias("offset")), hits=hits, top=F.coalesce(top, F.lit(0.0)))
    rows = told.select("query_id", "offset", "top", F.posexplode("hits").alias("pos", "hit"))
    hit = F.col("hit")

    def part(source: Column, field: str, kind: str = "string") -> Column:
        return F.try_variant_get(source, f"$.{field}", kind)

    rows = rows.withColumn("fields", part(hit, shape["fields"], "variant") if shape["fields"] else hit)
    places = [(hit, "content")] if backend == "milvus" else []
    content = F.coalesce(*[part(v, f) for v, f in [*places, *((F.col("fields"), f) for f in CONTENT_FIELDS)]], F.lit(""))
    found_id = F.coalesce(*[part(hit, f) for f in shape["id"]], F.lit("unknown" if backend == "milvus" else ""))
    kept = F.map_filter(F.try_variant_get("fields", "$", "map<string,variant>"), lambda k, v: ~k.isin(*shape["drop"]))
    parsed = rows.select(
        "query_id",
        (F.col("offset") + F.col("pos") + 1).cast("int").alias("rank"),
        found_id.alias("id"),
        _normal_score(backend, part(hit, shape["score"], "double")).alias("score"),
        content.alias("content"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))).alias("metadata"),
    )
    return parsed.filter((F.col("content") != "") | (F.col("id") != "")) if backend == "meilisearch" else parsed


def _normal_score(backend: str, score: Column) -> Column:
    if backend == "elasticsearch":
        return round6(by_max_score(F.coalesce(score, F.lit(0.0)), F.col("top")))
    if backend == "milvus":
        return round6(clamp01(1 - F.coalesce(score, F.lit(0.0))))
    if backend == "qdrant":
        return round6(score)
    return round6(clamp01(F.coalesce(score, F.lit(0.0))))
