"""Lost change events: gaps in the sequence numbers of a live stream, reported once they can no longer be filled."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAPS = "origin_node_id string, after bigint, before bigint, missing bigint"


class OpenGaps:
    """The least and the greatest number seen, and the open gaps between them as (after, before, time of the row that showed it)."""

    def __init__(self, low: int | None = None, high: int | None = None, gaps: list | None = None):
        self.low, self.high, self.gaps = low, high, gaps or []

    def see(self, numbers: np.ndarray, times: np.ndarray) -> list[int]:
        """Take rows in any order; the times at which new gaps are due."""
        if not len(numbers):
            return []
        order = np.argsort(numbers, kind="stable")
        numbers, first = np.unique(numbers[order], return_index=True)
        times = times[order][first]
        if self.low is None:
            self.low = self.high = int(numbers[0])
        outside = (numbers < self.low) | (numbers > self.high)
        for x in numbers[~outside].tolist():
            i = bisect.bisect_right(self.gaps, x, key=lambda g: g[0]) - 1
            if i >= 0 and self.gaps[i][0] < x < self.gaps[i][1]:
                after, before, due = self.gaps[i]
                self.gaps[i : i + 1] = [g for g in ([after, x, due], [x, before, due]) if g[1] - g[0] > 1]
        due = []
        for some, edge in ((numbers < self.low, self.low), (numbers > self.high, self.high)):
            mine, when = numbers[some], times[some]
            if not len(mine):
                continue
            # a gap is shown by the row farther from what was known before
            known = np.r_[mine, edge] if mine[0] < edge else np.r_[edge, mine]
            wide = np.flatnonzero(np.diff(known) > 1)
            for i in wide.tolist():
                bisect.insort(self.gaps, [int(known[i]), int(known[i + 1]), int(when[i])])
                due.append(int(when[i]))
        self.low, self.high = min(self.low, int(numbers[0])), max(self.high, int(numbers[-1]))
        return due

    def ripe(self, now: int) -> list[list[int]]:
        """Gaps that were shown by ``now``; they are forgotten."""
        out = [g for g in self.gaps if g[2] <= now]
        self.gaps = [g for g in self.gaps if g[2] > now]
        return out


class GapProcessor(StatefulProcessor):
    """State per origin: as large as the gaps that may still be filled. Rows are taken batch by batch, never as a whole."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("gaps", T.StructType([T.StructField("json", T.StringType())]))

    def _load(self) -> OpenGaps:
        return OpenGaps(*json.loads(self.state.get()[0])) if self.state.exists() else OpenGaps()

    def _store(self, gaps: OpenGaps) -> None:
        self.state.update((json.dumps([gaps.low, gaps.high, gaps.gaps]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gaps, due = self._load(), set()
        for batch in rows:
            told = batch[batch["sequence"].notna()]  # a heartbeat has no number
            due.update(gaps.see(told["sequence"].to_numpy(np.int64), told["at_ms"].to_numpy(np.int64)))
        self._store(gaps)
        now = timerValues.getCurrentWatermarkInMs()
        for at in due:
            self.handle.registerTimer(max(at, now + 1))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gaps = self._load()
        found = gaps.ripe(timerValues.getCurrentWatermarkInMs())
        self._store(gaps)
        if found:
            yield pd.DataFrame({
                "origin_node_id": [key[0]] * len(found), "after": [g[0] for g in found], "before": [g[1] for g in found],
                "missing": [g[1] - g[0] - 1 for g in found],
            })

    def close(self) -> None:
        pass


def stream_gaps(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Missing sequence numbers per origin (origin_node_id, after, before, missing), each gap once.

    A gap opens with the row behind it and shrinks as late rows fill it; what is left is reported when the watermark, ``lateness``
    behind the newest event, has passed that row. Rows without a number are heartbeats, which only move the time on. Rows later
    than the watermark are dropped, as their gap has been reported.
    """
    rows = events.select("origin_node_id", "sequence", F.col("timestamp_ms").alias("at_ms"), F.timestamp_millis("timestamp_ms").alias("ts"))
    return rows.withWatermark("ts", lateness).groupBy("origin_node_id").transformWithStateInPandas(
        statefulProcessor=GapProcessor(), outputStructType=GAPS, outputMode="Append", timeMode="EventTime"
    )
