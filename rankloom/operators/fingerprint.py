"""Schema fingerprints of backend responses and their changes over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.ordered import SLOT_ROWS, ordered_scan

# The fields in which backends announce dimension, model and version.
DIM_FIELDS = ("embedding_dims", "dimensions", "dim", "vector_size", "embedding_dimension")
MODEL_FIELDS = ("model", "embedding_model", "model_name", "model_id")
VERSION_FIELDS = ("version", "api_version", "schema_version")
VECTOR_FIELDS = ("vector", "embedding", "embeddings", "dense_vector")
META_DIM_FIELDS = ("embedding_dims", "dimensions")
META_MODEL_FIELDS = ("model", "embedding_model")


def _typed(doc: Column, path: str, kind: str, spark_type: str) -> Column:
    """Field of a variant when it holds a JSON value of that kind, else null."""
    is_kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == kind
    return F.when(is_kind, F.try_variant_get(doc, path, spark_type))


def schema_fingerprint(df: DataFrame, json_col: str) -> DataFrame:
    """Add embedding_dims, model_hint and schema_version read from a JSON response."""
    parsed = df.withColumn("_doc", F.try_parse_json(F.col(json_col)))
    doc = F.col("_doc")
    meta = F.coalesce(F.try_variant_get(doc, "$.metadata", "variant"), F.try_variant_get(doc, "$.meta", "variant"))
    results = F.try_variant_get(doc, "$.results", "array<variant>")

    def vector_length(result: Column) -> Column:
        return F.coalesce(
            *[F.size(F.try_variant_get(result, f"$.{f}", "array<variant>")) for f in VECTOR_FIELDS]
        )

    lengths = F.filter(F.transform(results, vector_length), lambda n: n.isNotNull() & (n >= 0))
    return parsed.withColumns(
        {
            "embedding_dims": F.coalesce(
                *[_typed(doc, f"$.{f}", "BIGINT", "bigint") for f in DIM_FIELDS],
                F.get(lengths, 0).cast("bigint"),
                *[_typed(meta, f"$.{f}", "BIGINT", "bigint") for f in META_DIM_FIELDS],
            ),
            "model_hint": F.coalesce(
                *[_typed(doc, f"$.{f}", "STRING", "string") for f in MODEL_FIELDS],
                *[_typed(meta, f"$.{f}", "STRING", "string") for f in META_MODEL_FIELDS],
            ),
            "schema_version": F.coalesce(*[_typed(doc, f"$.{f}", "STRING", "string") for f in VERSION_FIELDS]),
        }
    ).drop("_doc")


def schema_changes(observations: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Observations (upstream_id, ts, seq, dims, model) that contradict the one before them.

    Two fingerprints differ when a part that both know is unequal.
    """
    scanned = ordered_scan(
        observations, ["upstream_id"], "ts", ["seq"], slot_rows,
        previous={"prev_dims": "dims", "prev_model": "model"},
    )
    differs = F.coalesce(F.col("dims") != F.col("prev_dims"), F.lit(False)) | F.coalesce(
        F.col("model") != F.col("prev_model"), F.lit(False)
    )
    return scanned.filter(differs)
