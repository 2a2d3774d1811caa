"""Live state machines per key: the same steps as the batch folds, with state that outlives a micro-batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankloom.operators.drift import LEVELS, LIMITS, SIGNIFICANT_OVERLAP
from rankloom.operators.health import CircuitConfig, ResilienceConfig, circuit_machine, resilience_machine
from rankloom.operators.sweeps import bucket_start, bucket_step


class KeyedMachine(StatefulProcessor):
    """Runs (start, step) over the rows of a key in order of time and id; the state is one JSON value."""

    def __init__(self, keys, order, passed, inputs, outputs, start, step, ttl_ms):
        self.keys, self.order, self.passed = keys, order, passed
        self.inputs, self.outputs, self.start, self.step, self.ttl_ms = inputs, outputs, start, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("json", T.StringType())])
        self.state = handle.getValueState("machine", schema, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start()
        results = []
        for values in batch[self.inputs].itertuples(index=False, name=None):
            state, out = self.step(state, *values)
            results.append(out)
        self.state.update((json.dumps(state),))
        table = batch[self.passed].reset_index(drop=True)
        for i, name in enumerate(self.outputs):
            table[name] = [r[i] for r in results]
        yield table

    def close(self) -> None:
        pass


def run_machine(
    stream: DataFrame, keys: list[str], order: list[str], inputs: list[str], output: str, start: Callable, step: Callable,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Streaming counterpart of ``keyed_fold``; rows of a key are ordered within each micro-batch.

    A task holds one key's rows of one micro-batch: bound that by the source's files or offsets per trigger. ``ttl_ms`` forgets keys
    unused for so long in wall-clock time; a stream with it runs until it is stopped, so leave it out where files are to be drained.
    """
    outputs = T.StructType.fromDDL(output)
    schema = T.StructType([*stream.schema.fields, *outputs.fields])
    processor = KeyedMachine(keys, order, stream.columns, inputs, outputs.fieldNames(), start, step, ttl_ms)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )


def stream_token_bucket(arrivals: DataFrame, key: str, rps: float, burst: float, ttl_ms: int | None = None) -> DataFrame:
    rows = arrivals.withColumns({"rps": F.lit(float(rps)), "burst": F.lit(float(burst)), "at_us": F.unix_micros("ts")})
    return run_machine(
        rows, [key], ["at_us", "request_id"], ["at_us", "rps", "burst"], "allowed boolean, tokens double", bucket_start, bucket_step, ttl_ms
    )


def stream_circuit(outcomes: DataFrame, cfg: CircuitConfig | None = None, ttl_ms: int | None = None) -> DataFrame:
    start, step = circuit_machine(cfg or CircuitConfig())
    rows = outcomes.withColumn("at_us", F.unix_micros("ts"))
    return run_machine(
        rows, ["upstream_id"], ["at_us", "seq"], ["at_us", "success"], "state string, admitted boolean", start, step, ttl_ms
    )


def stream_resilience(outcomes: DataFrame, cfg: ResilienceConfig | None = None, ttl_ms: int | None = None) -> DataFrame:
    start, step = resilience_machine(cfg or ResilienceConfig())
    rows = outcomes.withColumn("at_us", F.unix_micros("ts"))
    return run_machine(
        rows, ["upstream_id"], ["at_us", "seq"], ["at_us", "success"], "state string, rps_limit double", start, step, ttl_ms
    )


def freshness_machine(fresh: float, stale: float):
    """(start, step) of an entry's life: served while fresh, served and refreshed while stale, else fetched anew."""
    fresh_us, total_us = int(fresh * 1e6), int((fresh + stale) * 1e6)

    def start() -> list:
        return [None]

    def step(state: list, now: int):
        filled, now = state[0], int(now)
        if filled is None:
            return [now], ("miss",)
        if now - filled < fresh_us:
            return state, ("hit",)
        return [now], ("stale" if now - filled < total_us else "expired",)

    return start, step


def stream_replay(log: DataFrame, fresh: float, stale: float, ttl_ms: int | None = None) -> DataFrame:
    """Label every access of a log stream (key, ts, seq) hit, stale, expired or miss."""
    start, step = freshness_machine(fresh, stale)
    rows = log.withColumn("at_us", F.unix_micros("ts"))
    return run_machine(rows, ["key"], ["at_us", "seq"], ["at_us"], "outcome string", start, step, ttl_ms)


def snapshot_machine():
    """(start, step) comparing each snapshot of a query (ids and scores) with the one before."""

    def start() -> list:
        return [None]

    def level(old: dict, new: dict) -> str:
        if not old and not new:
            return "none"
        if not old or not new:
            return "major"
        common = old.keys() & new.keys()
        overlap = round(len(common) / max(len(old), len(new)), 6)
        change = round(sum(abs(old[i] - new[i]) for i in common) / len(common), 6) if common else 1.0
        for name, least, below in LIMITS:
            if overlap >= least and change < below:
                return name
        return "significant" if overlap >= SIGNIFICANT_OVERLAP else "major"

    def step(state: list, ids, scores):
        new = {str(i): float(s) for i, s in zip(ids, scores)}
        return [new], (None if state[0] is None else level(state[0], new),)

    return start, step


def alert_machine(n: int, above: str, alert_count: int):
    """(start, step) keeping the last ``n`` levels of an upstream and whether enough lie above a level."""

    def start() -> list:
        return []

    def step(state: list, level: str):
        state = [*state, LEVELS.index(level)][-n:]
        return state, (len(state), sum(x > LEVELS.index(above) for x in state) >= alert_count)

    return start, step


def stream_drift(refreshes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Drift level of each refresh (query_id, upstream_id, ts, seq, ids, scores) against the one before; null for the first."""
    start, step = snapshot_machine()
    return run_machine(refreshes, ["query_id"], ["ts", "seq"], ["ids", "scores"], "level string", start, step, ttl_ms)


def stream_drift_alerts(observations: DataFrame, n: int = 100, above: str = "moderate", alert_count: int = 10, ttl_ms: int | None = None) -> DataFrame:
    """Alerts per upstream over its last ``n`` levels (upstream_id, ts, seq, level)."""
    start, step = alert_machine(n, above, alert_count)
    return run_machine(observations, ["upstream_id"], ["ts", "seq"], ["level"], "total int, alert boolean", start, step, ttl_ms)
