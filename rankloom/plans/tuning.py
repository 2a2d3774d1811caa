"""Tuning jobs: benchmark a chosen run, and search then sweep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.evaluation import movements, verdicts
from rankloom.operators.scope import ScopeConfig, scope, scope_sweep
from rankloom.operators.sweeps import selected_run
from rankloom.session import cut


def benchmark_run(
    hits: DataFrame, runs: DataFrame, session_id: str, phrases: DataFrame, top_k: int
) -> tuple[DataFrame, DataFrame]:
    """Re-score baseline hits as the session's chosen run would: movements and a verdict per query.

    ``runs`` has string maps ``params`` with mode, min_similarity and scope_weight; the settings of the one chosen
    run are read by the driver. ``phrases`` holds a run_id per phrase.
    """
    chosen = selected_run(runs.filter(F.col("session_id") == session_id))
    run = runs.join(chosen.select("run_id"), "run_id").select("run_id", "params").first()
    if run is None:
        raise ValueError(f"session {session_id} has no run")
    params = run["params"]
    cfg = ScopeConfig(
        min_similarity=float(params.get("min_similarity", 0.25)), scope_weight=float(params.get("scope_weight", 0.3))
    )
    own = phrases.filter(F.col("run_id") == run["run_id"])
    tuned = scope(hits, own, params.get("mode", "filter"), cfg)
    moves = movements(hits, tuned.select("query_id", "rank", "id", "score"), top_k)
    return moves, verdicts(moves)


def tune_workflow(
    queries: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    docs: DataFrame,
    phrases: DataFrame,
    thresholds: list[float],
) -> tuple[DataFrame, DataFrame]:
    """Search all queries and sweep the scope threshold over their hits: (sweep, queries without any hit)."""
    hits = cut(search(queries))
    listed = hits.join(docs.select("id", "content"), "id").join(queries.select("query_id", "context_id"), "query_id")
    missing = queries.join(hits.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit("no_hits").alias("error")
    )
    return scope_sweep(listed, phrases, thresholds), missing
