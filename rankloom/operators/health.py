"""Health of upstreams over time, from their request outcomes (upstream_id, ts, seq, success)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.folds import CHUNK_ROWS, keyed_fold
from rankloom.operators.ordered import SLOT_ROWS, ordered_scan

MAX_RATE = 3.4028234663852886e38


def health_timeline(
    outcomes: DataFrame,
    offline_after: int = 3,
    recover_after: int = 2,
    degraded_rate: float = 0.1,
    min_requests: int = 10,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Online, degraded or offline after every outcome.

    Streak lengths are distances to the last outcome of the other kind; the offline flag is that of the last streak
    which crossed a threshold. Three ordered scans, no row-by-row code.
    """
    rows = outcomes.withColumns({"_one": F.lit(1), "_fail": (~F.col("success")).cast("int")})
    a = ordered_scan(
        rows, ["upstream_id"], "ts", ["seq"], slot_rows, running_sum={"n": "_one", "failed": "_fail"}
    )
    a = a.withColumns({"_ok_at": F.when(F.col("success"), F.col("n")), "_bad_at": F.when(~F.col("success"), F.col("n"))})
    b = ordered_scan(
        a, ["upstream_id"], "ts", ["seq"], slot_rows, last_seen={"_last_ok": "_ok_at", "_last_bad": "_bad_at"}
    )
    zero = F.lit(0)
    b = b.withColumns(
        {
            "failure_streak": F.col("n") - F.coalesce("_last_ok", zero),
            "success_streak": F.col("n") - F.coalesce("_last_bad", zero),
        }
    )
    b = b.withColumn(
        "_flag",
        F.when(~F.col("success") & (F.col("failure_streak") >= offline_after), 1).when(
            F.col("success") & (F.col("success_streak") >= recover_after), 0
        ),
    )
    c = ordered_scan(b, ["upstream_id"], "ts", ["seq"], slot_rows, last_seen={"_offline": "_flag"})
    degraded = (
        (F.col("n") >= min_requests) & (F.col("failure_streak") == 0) & (F.col("failed") / F.col("n") > degraded_rate)
    )
    state = F.when(F.col("_offline") == 1, "offline").when(degraded, "degraded").otherwise("online")
    return c.select(*outcomes.columns, "failure_streak", "success_streak", state.alias("state"))


@dataclass
class CircuitConfig:
    """Fixed default values of the circuit rules; durations in seconds."""

    failure_threshold: int = 5
    success_threshold: int = 2
    open_seconds: float = 30.0
    window_seconds: float = 60.0


def circuit_machine(cfg: CircuitConfig):
    """(start, step) of a circuit: closed until too many failures, open for a while, then half open on trial."""
    wait, window = cfg.open_seconds * 1e6, cfg.window_seconds * 1e6

    def start() -> list:
        return ["closed", 0, 0, None, None]

    def step(state: list, now: int, success: bool):
        name, failures, trials, opened, since = state
        now = int(now)
        since = now if since is None else since
        if name == "open":
            if now - opened < wait:
                return [name, failures, trials, opened, since], (name, False)
            name, trials = "half_open", 0
        if name == "half_open":
            if not success:
                name, trials, opened = "open", 0, now
            elif trials + 1 >= cfg.success_threshold:
                name, failures, trials, opened, since = "closed", 0, 0, None, now
            else:
                trials += 1
        elif success:
            failures = 0
        else:
            if now - since >= window:
                since, failures = now, 0
            failures += 1
            if failures >= cfg.failure_threshold:
                name, trials, opened = "open", 0, now
        return [name, failures, trials, opened, since], (name, True)

    return start, step


def circuit_timeline(
    outcomes: DataFrame, cfg: CircuitConfig | None = None, chunk_rows: int = CHUNK_ROWS, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """State of the circuit after every outcome, and whether the request was let through."""
    start, step = circuit_machine(cfg or CircuitConfig())
    rows = outcomes.withColumn("_at", F.unix_micros("ts"))
    return keyed_fold(
        rows, ["upstream_id"], "ts", ["seq"], ["_at", "success"], "state string, admitted boolean", start, step,
        chunk_rows, slot_rows,
    ).drop("_at")


@dataclass
class ResilienceConfig:
    """Fixed default values of the three-state rules."""

    degraded_after: int = 5
    offline_after: int = 10
    healthy_after: int = 3
    window_seconds: float = 60.0
    degraded_rps: float = 10.0
    max_rps: float = 1000.0
    rps_step: float = 5.0


def resilience_machine(cfg: ResilienceConfig):
    """(start, step) of healthy, degraded and offline; degraded upstreams earn their rate back step by step."""
    window = cfg.window_seconds * 1e6

    def start() -> list:
        return ["healthy", 0, 0, 0, None, cfg.degraded_rps]

    def limit(name: str, rps: float) -> float:
        return {"healthy": MAX_RATE, "degraded": rps, "offline": 0.0}[name]

    def step(state: list, now: int, success: bool):
        name, failures, bad, good, since, rps = state
        now = int(now)
        since = now if since is None else since
        if success:
            bad, good = 0, good + 1
            if name == "healthy":
                failures = 0
            elif name == "offline":
                name, good, failures, rps = "degraded", 0, 0, cfg.degraded_rps
            else:
                rps = min(cfg.max_rps, rps + cfg.rps_step)
                if good >= cfg.healthy_after:
                    name, failures, bad, good, since, rps = "healthy", 0, 0, 0, now, cfg.degraded_rps
        else:
            good, bad = 0, bad + 1
            if name == "healthy":
                if now - since >= window:
                    since, failures = now, 0
                failures += 1
                if failures >= cfg.degraded_after:
                    name, failures, good, rps = "degraded", 0, 0, cfg.degraded_rps
            elif name == "degraded" and bad >= cfg.offline_after:
                name, good = "offline", 0
        return [name, failures, bad, good, since, rps], (name, limit(name, rps))

    return start, step


def resilience_timeline(
    outcomes: DataFrame, cfg: ResilienceConfig | None = None, chunk_rows: int = CHUNK_ROWS, slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """State and request limit after every outcome."""
    start, step = resilience_machine(cfg or ResilienceConfig())
    rows = outcomes.withColumn("_at", F.unix_micros("ts"))
    return keyed_fold(
        rows, ["upstream_id"], "ts", ["seq"], ["_at", "success"], "state string, rps_limit double", start, step,
        chunk_rows, slot_rows,
    ).drop("_at")


def fleet_summary(timeline: DataFrame, at: str) -> DataFrame:
    """Number of upstreams per state at a moment."""
    last = (
        timeline.filter(F.col("ts") <= F.lit(at).cast("timestamp"))
        .groupBy("upstream_id")
        .agg(F.max_by("state", F.struct("ts", "seq")).alias("state"))
    )
    return last.groupBy("state").agg(F.count("*").alias("upstreams"))
