"""Regressions, trends and chronic cases in benchmark histories (bench, run, mean, se)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import round6


def _status(pct: Column, low: Column, high: Column, limit: float) -> Column:
    return (
        F.when(pct.isNull(), "no_main")
        .when(low >= limit, "regression")
        .when(high <= -limit, "improvement")
        .when(low.isNotNull(), "inconclusive")
        .when(pct >= limit, "regression")
        .when(pct <= -limit, "improvement")
        .otherwise("ok")
    )


def regressions(new: DataFrame, base: DataFrame, threshold: float = 15.0, width: float = 1.96) -> DataFrame:
    """Change against the baseline in percent, with the interval of independent errors, and its status.

    The interval reaches ``width`` standard errors to either side: 1.96 for 95%.
    Without a standard error on both sides there is no interval, and the point decides.
    """
    joined = new.join(base.select("bench", F.col("mean").alias("b_mean"), F.col("se").alias("b_se")), "bench", "left")
    usable = (F.col("b_mean") > 0) & (F.col("mean") > 0)
    delta = F.col("mean") - F.col("b_mean")
    reach = width * F.sqrt(F.col("se") * F.col("se") + F.col("b_se") * F.col("b_se"))
    pct = F.when(usable, delta / F.col("b_mean") * 100)
    low = F.when(usable, (delta - reach) / F.col("b_mean") * 100)
    high = F.when(usable, (delta + reach) / F.col("b_mean") * 100)
    return joined.select(
        "bench", "mean",
        round6(pct).alias("change_pct"), round6(low).alias("ci_low"), round6(high).alias("ci_high"),
        _status(pct, low, high, threshold).alias("status"),
    )


def trend(history: DataFrame) -> DataFrame:
    """Change of each bench against its most recent earlier run; a bench has few runs."""
    w = Window.partitionBy("bench").orderBy("run")
    prior = F.lag("mean").over(w)
    rows = history.select("bench", "run", "mean", prior.alias("prev_mean")).filter(F.col("prev_mean") > 0)
    return rows.withColumn("change_pct", round6((F.col("mean") - F.col("prev_mean")) / F.col("prev_mean") * 100))


def top_movers(changes: DataFrame) -> DataFrame:
    """Per run the bench with the largest change in either direction."""
    place = F.struct(F.abs("change_pct").alias("a"), "bench")
    return changes.groupBy("run").agg(
        F.max_by("bench", place).alias("bench"), F.max_by("change_pct", place).alias("change_pct")
    )


def chronic(statuses: DataFrame) -> DataFrame:
    """Runs (bench, run, change_pct, status) that regress after rising in both runs before."""
    w = Window.partitionBy("bench").orderBy("run")
    one, two = F.lag("change_pct", 1).over(w), F.lag("change_pct", 2).over(w)
    seen = statuses.select("*", one.alias("_one"), two.alias("_two"))
    return seen.filter((F.col("status") == "regression") & (F.col("_one") > 0) & (F.col("_two") > 0)).select(
        "bench", "run", "change_pct", F.lit(3).alias("consecutive_runs")
    )
