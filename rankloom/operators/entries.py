"""Tables of cached entries: inventory, summaries, retention, refresh and warm-up plans.

Entries have norm_key, query, context_id, upstream_id, cached_at, n_results, bytes. ``now`` is a timestamp string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import round6
from rankloom.functions.ttl import MAX_FROZEN_SECONDS, freshness, jittered_ttl
from rankloom.operators.ordered import SLOT_ROWS, ordered_scan
from rankloom.session import small


def age_seconds(now: str) -> Column:
    return F.lit(now).cast("timestamp").cast("double") - F.col("cached_at").cast("double")


def classify_freshness(
    entries: DataFrame, fresh: float, stale: float, now: str, max_frozen: float = MAX_FROZEN_SECONDS
) -> DataFrame:
    """Add ``freshness`` by age, with the jittered fresh limit."""
    return entries.withColumn("freshness", freshness(age_seconds(now), F.col("norm_key"), fresh, stale, max_frozen))


def cache_stats(entries: DataFrame, fresh: float, stale: float, capacity: int, now: str) -> DataFrame:
    """Inventory per upstream and over all (null upstream): counts by plain age, bytes, share of the capacity."""
    age = age_seconds(now)
    total = F.count("*")
    return entries.rollup("upstream_id").agg(
        total.alias("total"),
        F.count_if(age < fresh).alias("fresh"),
        F.count_if((age >= fresh) & (age < fresh + stale)).alias("stale"),
        F.count_if(age >= fresh + stale).alias("expired"),
        F.sum("bytes").alias("bytes"),
        round6(total / F.lit(capacity)).alias("utilisation"),
    )


def entries_summary(entries: DataFrame, fresh: float, stale: float, now: str) -> DataFrame:
    """One line per entry, its query cut to 120 characters."""
    return classify_freshness(entries, fresh, stale, now).select(
        "norm_key", F.substring("query", 1, 120).alias("query"), "upstream_id", "context_id", "cached_at", "n_results", "freshness"
    )


def oldest(entries: DataFrame, n: int, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """The ``n`` oldest entries, counted in slots of bounded rows, so that a large ``n`` needs no single task."""
    numbered = ordered_scan(
        entries.withColumn("_one", F.lit(1)), [], "cached_at", ["norm_key"], slot_rows, running_sum={"_place": "_one"}
    )
    return numbered.filter(F.col("_place") <= n).drop("_one", "_place")


def evict_plan(
    entries: DataFrame,
    now: str,
    context: str | None = None,
    prefix: str | None = None,
    older_than: float | None = None,
    max_entries: int | None = None,
) -> DataFrame:
    """Add ``action`` (keep or evict): entries that meet all given conditions go, the oldest ``max_entries`` of them."""
    chosen = entries
    if context is not None:
        chosen = chosen.filter(F.col("context_id") == context)
    if prefix is not None:
        chosen = chosen.filter(F.lower("query").startswith(prefix.lower()))
    if older_than is not None:
        chosen = chosen.filter(age_seconds(now) >= older_than)
    if max_entries is not None:
        chosen = oldest(chosen, max_entries)
    marks = chosen.select("norm_key", F.lit("evict").alias("action"))
    return entries.join(marks, "norm_key", "left").withColumn("action", F.coalesce("action", F.lit("keep")))


def enforce_cap(entries: DataFrame, n: int) -> DataFrame:
    """Entries beyond the newest ``n`` of their upstream, oldest first. Only ``n`` rows per upstream are ranked."""
    newest = Window.partitionBy("upstream_id").orderBy(F.desc("cached_at"), F.asc("norm_key"))
    kept = entries.select("norm_key", "upstream_id", "cached_at").withColumn("_r", F.row_number().over(newest)).filter(
        F.col("_r") <= n
    )
    return entries.join(kept.select("norm_key"), "norm_key", "left_anti")


def purge_expired(entries: DataFrame, now: str, max_frozen: float = MAX_FROZEN_SECONDS) -> DataFrame:
    """Entries that are still within the frozen limit."""
    return entries.filter(age_seconds(now) < max_frozen)


def refresh_list(entries: DataFrame, fresh: float, stale: float, now: str) -> DataFrame:
    """Keys of stale entries, which are due for a refresh."""
    limit = jittered_ttl(fresh, F.col("norm_key"))
    age = age_seconds(now)
    return entries.filter((age >= limit) & (age < limit + stale)).select("norm_key", "upstream_id")


def warm_plan(
    wanted: DataFrame, cached: DataFrame, per_key_ms: float, concurrency: tuple[int, ...] = (1, 4, 8)
) -> DataFrame:
    """Per concurrency: keys wanted, already cached and to warm, and the time in waves of that many keys."""
    keys = wanted.select("norm_key").distinct()
    marked = keys.join(cached.select("norm_key", F.lit(1).alias("c")).distinct(), "norm_key", "left")
    counts = marked.agg(F.count("*").alias("wanted"), F.count("c").alias("already_cached"))
    swept = counts.withColumn("concurrency", F.explode(F.array(*[F.lit(c) for c in concurrency])))
    to_warm = F.col("wanted") - F.col("already_cached")
    return swept.select(
        "concurrency",
        "wanted",
        "already_cached",
        to_warm.alias("to_warm"),
        (F.ceil(to_warm / F.col("concurrency")) * F.lit(float(per_key_ms))).cast("double").alias("estimated_ms"),
    )


def warm_entries(plan: DataFrame, invalid: DataFrame, existing: DataFrame, capacity: int) -> DataFrame:
    """Plan rows (context_id, position, norm_key) to insert: valid ones in order until the context is full.

    Positions are counted in slots, so that one context may hold most of the plan.
    """
    valid = plan.join(invalid.select("norm_key"), "norm_key", "left_anti").withColumn("_one", F.lit(1))
    placed = ordered_scan(valid, ["context_id"], "position", ["norm_key"], running_sum={"place": "_one"})
    used = small(existing.groupBy("context_id").agg(F.count("*").alias("used")))
    room = F.lit(capacity) - F.coalesce("used", F.lit(0))
    return placed.join(used, "context_id", "left").filter(F.col("place") <= room).select(
        "context_id", "position", "norm_key", "place"
    )
