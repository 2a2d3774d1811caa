"""Score columns: backend normalisation, leg ranges and percent-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw score range per kind of search leg.
LEG_RANGE = {"fts": (0.0, 100.0), "vector": (0.0, 1.0), "hybrid": (0.0, 1.0)}


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def round6(c) -> Column:
    return F.round(c, 6)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def by_max_score(score: Column, top: Column) -> Column:
    """Lexical relevance over the best score of its list."""
    return F.when(top > 0, clamp01(score / top)).otherwise(F.lit(0.0))


def from_distance(d: Column, metric: str) -> Column:
    """Similarity from a distance: cosine, l2, ip, or the clamped cosine of some backends."""
    if metric == "cosine":
        return 1 - d
    if metric == "l2":
        return 1 / (1 + d)
    if metric == "ip":
        return -d
    if metric == "clamped_cosine":
        return clamp01(1 - F.coalesce(d, F.lit(0.0)))
    raise ValueError(f"unknown metric {metric}")


def leg_normalized(score: Column, low: Column, high: Column) -> Column:
    """Score mapped from a leg's range to [0, 1]; a degenerate range only clamps."""
    return F.when(high > low, clamp01((score - low) / (high - low))).otherwise(clamp01(score))
