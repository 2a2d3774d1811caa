"""Cached entries as a table on disk, and their export as documents."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import slugify
from rankloom.functions.ttl import MAX_FROZEN_SECONDS, jittered_ttl
from rankloom.operators.entries import oldest


def write_cache_entries(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist entries, one folder per context."""
    entries.write.mode(mode).partitionBy("context_id").parquet(path)


def read_cache_entries(spark: SparkSession, path: str, context: str | None = None) -> DataFrame:
    """Restore entries; a context reads only its own folder."""
    entries = spark.read.parquet(path)
    return entries if context is None else entries.filter(F.col("context_id") == context)


def distill(
    entries: DataFrame,
    now: str,
    fresh: float,
    context: str | None = None,
    include_stale: bool = False,
    limit: int = 0,
    embeddings: DataFrame | None = None,
    max_frozen: float = MAX_FROZEN_SECONDS,
) -> DataFrame:
    """Entries worth exporting, oldest first: not past the frozen limit and, unless asked for, not stale."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("cached_at").cast("double")
    chosen = entries.filter(age <= max_frozen)
    if context:
        chosen = chosen.filter(F.col("context_id") == context)
    if not include_stale:
        chosen = chosen.filter(age <= jittered_ttl(fresh, F.col("norm_key")))
    if limit > 0:
        chosen = oldest(chosen, limit)
    if embeddings is not None:
        chosen = chosen.join(embeddings.select("norm_key", "embedding"), "norm_key", "left")
    return chosen.orderBy("cached_at", "norm_key")


def entry_markdown(pretty: Column, raw: Column) -> Column:
    """Markdown body of an entry: heading, metadata list, and the response in a code fence."""
    heading = F.concat(F.lit("# "), F.when(F.col("query") == "", "<empty>").otherwise(F.col("query")))

    def item(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- **{label}:** `"), value, F.lit("`"))

    stamp = F.concat(F.date_format("cached_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    extended = F.when(
        F.col("extended_count") > 0, F.concat(F.lit("- **TTL extensions:** "), F.col("extended_count").cast("string"))
    )
    response = F.when(pretty.isNotNull(), F.concat(F.lit("```json\n"), pretty, F.lit("\n```"))).otherwise(
        F.concat(F.lit("```\n(response JSON unparseable; raw bytes below)\n\n"), raw, F.lit("\n```"))
    )
    return F.concat_ws(
        "\n",
        heading, F.lit(""), F.lit("## Metadata"), F.lit(""),
        item("Context", F.col("context_id")), item("Upstream", F.col("upstream_id")), item("Hash", F.col("norm_key")),
        item("Cached at", stamp), extended, F.lit(""), F.lit("## Response"), F.lit(""), response, F.lit(""),
    )


def _indented(response: pd.Series) -> pd.Series:
    def one(text):
        try:
            return json.dumps(json.loads(text, parse_constant=_refuse), indent=2, sort_keys=True, ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return response.map(one)


def _refuse(name):
    raise ValueError(f"{name} is not JSON")


def pretty_response(response: Column) -> Column:
    """Indented form of a stored response with every field it has, names sorted; null when it does not parse."""
    return F.pandas_udf(_indented, T.StringType())(response)


def distill_documents(entries: DataFrame) -> DataFrame:
    """(context_id, file_name, body, ...): one Markdown document per entry with ``response_json`` text."""
    slug = slugify("query")
    name = F.concat_ws("-", F.when(slug != "", slug), F.substring("norm_key", 1, 8))
    body = entry_markdown(pretty_response(F.col("response_json")), F.col("response_json"))
    return entries.select("context_id", F.concat(name, F.lit(".md")).alias("file_name"), "norm_key", "query", "upstream_id",
                          "cached_at", body.alias("body"))


def distill_sink(entries: DataFrame, out_dir: str) -> None:
    """Write the documents as JSON lines per context, and an index of them."""
    docs = distill_documents(entries)
    docs.select("context_id", "file_name", "body").write.mode("overwrite").partitionBy("context_id").json(f"{out_dir}/entries")
    docs.drop("body").write.mode("overwrite").json(f"{out_dir}/index")
