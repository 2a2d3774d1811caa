"""Time-to-live columns: jitter and freshness classes. Times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
MAX_FROZEN_SECONDS = 24 * 3600
JITTER = 0.1


def jittered_ttl(ttl: float, key: Column, pct: float = JITTER) -> Column:
    """``ttl`` plus a share of it that the first byte of the key decides."""
    byte0 = F.conv(F.substring(key, 1, 2), 16, 10).cast("bigint")
    return F.lit(float(ttl)) + F.floor(F.lit(float(ttl)) * (byte0 / F.lit(255.0)) * F.lit(pct)).cast("double")


def freshness(age: Column, key: Column, fresh: float, stale: float, max_frozen: float = MAX_FROZEN_SECONDS) -> Column:
    """fresh, stale, frozen or expired by age; the jitter moves the fresh limit and the stale limit behind it."""
    limit = jittered_ttl(fresh, key)
    return (
        F.when(age < limit, "fresh")
        .when(age < limit + F.lit(float(stale)), "stale")
        .when(age < F.lit(float(max_frozen)), "frozen")
        .otherwise("expired")
    )
