"""Vector columns over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for unequal lengths, empty vectors and zero norms."""
    a, b = as_double(a), as_double(b)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(F.lit(0.0))


def l2_normalize(a) -> Column:
    """Unit vector; a zero vector stays as it is."""
    a = as_double(a)
    # The norm is bound once through a one-element array instead of anew for every component.
    scaled = F.transform(F.array(F.sqrt(dot(a, a))), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x)))
    return F.get(scaled, 0)
