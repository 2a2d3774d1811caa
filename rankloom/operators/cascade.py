"""Priority cascade of search legs with early exit, optional rank fusion and targeting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import LEG_RANGE, leg_normalized, round6
from rankloom.operators.fusion import fuse_rrf
from rankloom.operators.validation import DEFAULT_TOP_K
from rankloom.session import cut, once


@dataclass
class Leg:
    """A search leg. ``search`` maps queries to (query_id, rank, id, score), as many as each query's top_k asks for."""

    upstream_id: str
    kind: str
    priority: int
    search: Callable[[DataFrame], DataFrame]


@dataclass
class CascadeConfig:
    threshold: float = 0.7
    min_results: int = 1
    max_depth: int = 3
    fusion: str | None = None
    rrf_k: int = 60
    max_results: int | None = None  # of fused lists; None: each query's own top_k
    preferred: str | None = None
    content_keys: DataFrame | None = None
    failed: DataFrame | None = None


@dataclass
class _Step:
    number: int
    legs: list[Leg]
    fused: bool
    depth: int


@dataclass
class _Schedule:
    steps: list[_Step] = field(default_factory=list)
    unmet_reason: str = "all_exhausted"


def preference_order(legs: list[Leg], preferred: str | None) -> list[Leg]:
    """Legs by priority and id, those whose kind or id contains ``preferred`` in front."""
    def place(leg: Leg):
        wanted = preferred is not None and (preferred in leg.kind or preferred in leg.upstream_id)
        return (not wanted, leg.priority, leg.upstream_id)

    return sorted(legs, key=place)


def order_legs(queries: DataFrame, legs: DataFrame) -> DataFrame:
    """Leg order per query, ``queries.preferred`` naming a part of a kind or an id (null: none).

    ``legs`` is the small leg dimension (upstream_id, upstream_type, priority): it is folded to one array,
    which every query sorts by its own preference.
    """
    folded = legs.agg(F.collect_list(F.struct("priority", "upstream_id", "upstream_type")).alias("legs"))
    wanted = F.col("preferred")

    def place(leg: Column) -> Column:
        match = F.coalesce(leg["upstream_type"].contains(wanted) | leg["upstream_id"].contains(wanted), F.lit(False))
        return F.struct((~match).alias("m"), leg["priority"].alias("p"), leg["upstream_id"].alias("u"))

    ordered = F.array_sort(F.transform("legs", place))
    rows = once(queries.select("query_id", "preferred"), legs=folded.scalar())
    return rows.select("query_id", F.posexplode(ordered).alias("pos", "leg")).select(
        "query_id", (F.col("pos") + 1).alias("position"), F.col("leg.u").alias("upstream_id")
    )


def _schedule(legs: list[Leg], cfg: CascadeConfig) -> _Schedule:
    """The steps that a never satisfied query takes; the depth is tested before each step.

    Priorities ascend; a preference decides the order inside one priority.
    """
    groups: dict[int, list[Leg]] = {}
    for leg in preference_order(legs, cfg.preferred):
        groups.setdefault(leg.priority, []).append(leg)
    plan, depth = _Schedule(unmet_reason="all_exhausted" if legs else "no_upstreams"), 0
    for _, group in sorted(groups.items()):
        fused = cfg.fusion == "rrf" and len(group) >= 2
        for legs_of_step in [group] if fused else [[leg] for leg in group]:
            if depth >= cfg.max_depth:
                plan.unmet_reason = "max_depth_reached"
                return plan
            depth += len(legs_of_step)
            plan.steps.append(_Step(len(plan.steps), legs_of_step, fused, depth))
    return plan


def _summary(pending: DataFrame, hits: DataFrame, leg: Leg, failed: DataFrame | None) -> DataFrame:
    """Per pending query: best score of the leg, its normalised form, the number of hits, and failure."""
    low, high = (F.lit(x) for x in LEG_RANGE[leg.kind])
    seen = hits.groupBy("query_id").agg(F.max("score").alias("max_score"), F.count("*").alias("n"))
    rows = pending.select("query_id").join(seen, "query_id", "left")
    best = F.coalesce("max_score", F.lit(0.0))
    rows = rows.select(
        "query_id",
        F.lit(leg.upstream_id).alias("upstream_id"),
        best.alias("max_score"),
        round6(leg_normalized(best, low, high)).alias("normalized"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    if failed is None:
        return rows.withColumn("errored", F.lit(False))
    marks = failed.filter(F.col("upstream_id") == leg.upstream_id).select("query_id", F.lit(True).alias("errored"))
    return rows.join(marks, "query_id", "left").withColumn("errored", F.coalesce("errored", F.lit(False)))


def cascade(
    queries: DataFrame, legs: list[Leg], cfg: CascadeConfig | None = None, targeted: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search ``queries`` leg by leg; only unsatisfied queries reach the next step.

    Returns hits (query_id, rank, id, score, upstream_id), outcome (query_id, stop_reason, final_leg, tried,
    depth) and the scores of every leg asked, with whether it failed (``errored``). Each step's hits and summary are written once to the
    shared folder, since both the next step and the result read them.
    """
    cfg = cfg or CascadeConfig()
    pending, chosen, outcomes = queries, [], []
    if targeted:
        pending, hits, outcome = _targeted(queries, legs, cfg.failed)
        chosen.append(hits)
        outcomes.append(outcome)

    plan = _schedule(legs, cfg)
    if not plan.steps:
        outcomes.append(pending.select("query_id", *[F.lit(v).cast("string").alias(c) for c, v in (("stop_reason", plan.unmet_reason), ("final_leg", None), ("tried", ""))], F.lit(0).alias("depth")))
        none = "rank int, id string, score double, upstream_id string"
        chosen.append(queries.select("query_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in none.split(", ")]).where("false"))
        scores = queries.select("query_id", F.lit("").alias("upstream_id"), *[F.lit(0.0).alias(c) for c in ("max_score", "normalized")], F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("errored"), F.lit(0).alias("step")).where("false")
        return reduce(DataFrame.unionByName, [c.select("query_id", "rank", "id", "score", "upstream_id") for c in chosen]), reduce(DataFrame.unionByName, outcomes), scores
    start, step_hits, step_rows, leg_rows = pending, [], [], []
    for step in plan.steps:
        lists, scores = [], []
        for leg in step.legs:
            found = leg.search(pending).withColumn("upstream_id", F.lit(leg.upstream_id))
            if cfg.failed is not None:
                found = found.join(cfg.failed, ["query_id", "upstream_id"], "left_anti")
            found = cut(found.select("query_id", "rank", "id", "score", "upstream_id"))
            lists.append(found)
            scores.append(_summary(pending, found, leg, cfg.failed))
        per_leg = cut(reduce(DataFrame.unionByName, scores).withColumn("step", F.lit(step.number)))
        leg_rows.append(per_leg)
        if step.fused:
            with_keys = reduce(DataFrame.unionByName, lists).join(cfg.content_keys, "id")
            most: int | str = cfg.max_results if cfg.max_results is not None else DEFAULT_TOP_K
            if cfg.max_results is None and "top_k" in pending.columns:
                with_keys, most = with_keys.join(pending.select("query_id", "top_k"), "query_id"), "top_k"
            result = fuse_rrf(with_keys, cfg.rrf_k, most).drop("rrf_score")
            counts = result.groupBy("query_id").agg(F.count("*").alias("n"))
            best = per_leg.groupBy("query_id").agg(F.max(F.when(F.col("n") > 0, F.col("normalized"))).alias("normalized"))
            rows = best.join(counts, "query_id", "left").select(
                "query_id",
                F.coalesce("normalized", F.lit(0.0)).alias("normalized"),
                F.coalesce("n", F.lit(0)).alias("n"),
                F.col("n").isNotNull().alias("recorded"),
            )
        else:
            result = lists[0]
            rows = per_leg.select("query_id", "normalized", "n", (~F.col("errored")).alias("recorded"))
        met = F.col("recorded") & (F.col("normalized") >= cfg.threshold) & (F.col("n") >= cfg.min_results)
        rows = rows.select(
            "query_id", "normalized", "recorded", met.alias("met"), F.lit(step.number).alias("step"),
            F.lit(step.depth).alias("depth"),
        )
        step_hits.append(result.withColumn("step", F.lit(step.number)))
        step_rows.append(rows)
        pending = pending.join(rows.filter("met").select("query_id"), "query_id", "left_anti")
        if pending.isEmpty():
            break

    leg_scores = reduce(DataFrame.unionByName, leg_rows)
    seen = reduce(DataFrame.unionByName, step_rows)
    decided = seen.groupBy("query_id").agg(
        F.bool_or("met").alias("met"),
        F.max("depth").alias("depth"),
        F.min(F.when(F.col("met"), F.col("step"))).alias("met_step"),
        F.min_by(
            F.when(F.col("recorded"), F.col("step")), F.when(F.col("recorded"), F.struct(-F.col("normalized"), F.col("step")))
        ).alias("best_step"),
    )
    names = {s.number: None if s.fused else s.legs[0].upstream_id for s in plan.steps}
    first_names = {s.number: sorted(leg.upstream_id for leg in s.legs)[0] for s in plan.steps}
    tried_by_depth = {s.depth: [leg.upstream_id for t in plan.steps[: s.number + 1] for leg in t.legs] for s in plan.steps}

    def lookup(values: dict, at: Column) -> Column:
        out = F.lit(None)
        for k, v in values.items():
            out = F.when(at == k, F.lit(v)).otherwise(out)
        return out.cast("string")

    final = F.coalesce("met_step", "best_step")
    outcome = start.select("query_id").join(decided, "query_id").select(
        "query_id",
        F.when(F.col("met"), "threshold_met").otherwise(plan.unmet_reason).alias("stop_reason"),
        F.when(F.col("met"), lookup(names, F.col("met_step"))).otherwise(lookup(first_names, F.col("best_step"))).alias(
            "final_leg"
        ),
        lookup({d: ",".join(t) for d, t in tried_by_depth.items()}, F.col("depth")).alias("tried"),
        "depth",
    )
    hits = reduce(DataFrame.unionByName, step_hits).join(
        decided.select("query_id", final.alias("step")), ["query_id", "step"], "left_semi"
    )
    chosen.append(hits.drop("step"))
    outcomes.append(outcome)
    return (
        reduce(DataFrame.unionByName, [c.select("query_id", "rank", "id", "score", "upstream_id") for c in chosen]),
        reduce(DataFrame.unionByName, outcomes),
        leg_scores,
    )


def _targeted(queries: DataFrame, legs: list[Leg], failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ask the leg that a query names; any hit of a leg that did not fail settles the query, the others stay pending."""
    lists = []
    for leg in legs:
        named = queries.filter(F.col("upstream_id") == leg.upstream_id)
        found = leg.search(named).withColumn("upstream_id", F.lit(leg.upstream_id))
        if failed is not None:
            found = found.join(failed, ["query_id", "upstream_id"], "left_anti")
        lists.append(found.select("query_id", "rank", "id", "score", "upstream_id"))
    hits = cut(reduce(DataFrame.unionByName, lists))
    settled = hits.select("query_id", "upstream_id").distinct()
    outcome = settled.select(
        "query_id",
        F.lit("threshold_met").alias("stop_reason"),
        F.col("upstream_id").alias("final_leg"),
        F.col("upstream_id").alias("tried"),
        F.lit(1).alias("depth"),
    )
    return queries.join(settled.select("query_id"), "query_id", "left_anti"), hits, outcome


def upstream_failures(outcome: DataFrame, leg_scores: DataFrame) -> DataFrame:
    """Queries (query_id) that no leg answered: there was none, or all were asked and every one failed. An empty answer is an answer."""
    asked = leg_scores.groupBy("query_id").agg(F.bool_and("errored").alias("failed"))
    ended = outcome.filter(F.col("stop_reason").isin("all_exhausted", "no_upstreams")).join(asked, "query_id", "left")
    return ended.filter(F.coalesce("failed", F.lit(True))).select("query_id")
