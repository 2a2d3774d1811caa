"""Result drift between snapshots, drift windows and version changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import round6
from rankloom.operators.ordered import SLOT_ROWS, ordered_scan

# Levels in rising order, with the least overlap and the score change below which each holds.
LEVELS = ("none", "minor", "moderate", "significant", "major")
LIMITS = (("none", 0.9, 0.05), ("minor", 0.7, 0.15), ("moderate", 0.5, 0.3))
SIGNIFICANT_OVERLAP = 0.3


def drift_level(overlap: Column, change: Column, n_old: Column, n_new: Column) -> Column:
    level = F.when((n_old == 0) & (n_new == 0), "none").when((n_old == 0) | (n_new == 0), "major")
    for name, least, below in LIMITS:
        level = level.when((overlap >= least) & (change < below), name)
    return level.when(overlap >= SIGNIFICANT_OVERLAP, "significant").otherwise("major")


def detect_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per query: overlap of two result lists, mean score change of the common ids, and the level."""
    sides = [
        df.groupBy("query_id", "id").agg(F.max("score").alias(f"{n}_score")) for df, n in ((old, "old"), (new, "new"))
    ]
    both = sides[0].join(sides[1], ["query_id", "id"], "full_outer")
    stats = both.groupBy("query_id").agg(
        F.count("old_score").alias("n_old"),
        F.count("new_score").alias("n_new"),
        F.count(F.col("old_score") + F.col("new_score")).alias("common"),
        F.avg(F.abs(F.col("old_score") - F.col("new_score"))).alias("change"),
    )
    rows = stats.select(
        "query_id", "n_old", "n_new",
        round6(F.col("common") / F.greatest("n_old", "n_new")).alias("overlap"),
        round6(F.coalesce("change", F.lit(1.0))).alias("score_change"),
    )
    return rows.withColumn("level", drift_level(F.col("overlap"), F.col("score_change"), F.col("n_old"), F.col("n_new")))


def drift_window(
    observations: DataFrame, n: int = 100, above: str = "moderate", alert_count: int = 10, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """State of the last ``n`` observations (upstream_id, ts, seq, level) after each one.

    Observations are numbered per upstream and cut into blocks of ``n``; a block also gets the rows of the block
    before it, which is all that its windows reach back to.
    """
    number = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level")).cast("int") - 1
    rows = observations.withColumns({"_level": number, "_one": F.lit(1)})
    placed = ordered_scan(rows, ["upstream_id"], "ts", ["seq"], slot_rows, running_sum={"_pos": "_one"})
    block = F.floor((F.col("_pos") - 1) / n)
    copies = placed.withColumn("_own", block).withColumn("_block", F.explode(F.array(block, block + 1)))
    w = Window.partitionBy("upstream_id", "_block").orderBy("_pos").rowsBetween(-(n - 1), 0)
    level = F.col("_level")
    counted = copies.select(
        "upstream_id", "ts", "seq", "level", "_own", "_block",
        F.count("*").over(w).alias("total"),
        *[F.sum((level == i).cast("int")).over(w).alias(f"n_{name}") for i, name in enumerate(LEVELS)],
        F.max(level).over(w).alias("_max"),
        round6(F.avg(level).over(w)).alias("mean_level"),
        (F.sum((level > LEVELS.index(above)).cast("int")).over(w) >= alert_count).alias("alert"),
    )
    return counted.filter(F.col("_own") == F.col("_block")).withColumn(
        "max_level", F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_max") + 1)
    ).drop("_own", "_block", "_max")


def version_changes(polls: DataFrame) -> DataFrame:
    """Polls (upstream_id, observed_at, version, corpus_hash, doc_count, last_modified) that differ from the one before.

    A part that one side does not know never differs; document counts may move by one percent.
    """
    w = Window.partitionBy("upstream_id").orderBy("observed_at")
    parts = ["version", "corpus_hash", "doc_count", "last_modified"]
    seen = polls.select("*", *[F.lag(c).over(w).alias(f"_{c}") for c in parts])
    moved = F.abs(F.col("doc_count") - F.col("_doc_count")) > F.floor(F.greatest("doc_count", "_doc_count") * 0.01)
    moved = moved & F.col("doc_count").isNotNull() & F.col("_doc_count").isNotNull()
    differs = [F.coalesce(F.col(c) != F.col(f"_{c}"), F.lit(False)) for c in ("version", "corpus_hash", "last_modified")]
    changed = F.coalesce(moved, F.lit(False)) | differs[0] | differs[1] | differs[2]
    return seen.withColumn("changed", changed).drop(*[f"_{c}" for c in parts])
