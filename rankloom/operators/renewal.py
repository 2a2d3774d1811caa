"""Renewal chains: which rows of a key open a new span, and which join the one that is open.

A row's own span ends at its own time, so whoever opens next is a jump to the first row past it, and the openers are what jumps reach
from a key's first row. Tasks stream sorted rows and follow the jumps of a batch; a key of at most a bound of rows is done in that one pass.

Larger keys are cut into slots. Within one, jumps are composed until they leave it, so that a slot becomes a few pieces: by when the
span before it ends, which of its spans is the last one. The piece of a later slot that such a span leads to is one ordered scan
away. These jumps between slots are then composed with themselves, each round twice as far: from the first piece of a key, what is
known to be reached doubles with every round. What enters each slot is then known, and one more pass marks the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.ordered import SLOT_ROWS, light_and_heavy, ordered_scan, slots
from rankloom.session import cut


def next_openers(group: np.ndarray, at: np.ndarray, until: np.ndarray, closed: bool) -> np.ndarray:
    """Per row the place of the first later row of its group whose time its own span does not hold; beyond the group if there is none.

    Rows are sorted by group and time. A span holds its end when ``closed``.
    """
    n = len(at)
    asks = np.lexsort((np.r_[np.ones(n, np.int8), np.full(n, 2 if closed else 0, np.int8)], np.r_[at, until], np.r_[group, group]))
    passed = np.cumsum(asks < n)
    found = np.empty(n, np.int64)
    probe = asks >= n
    found[asks[probe] - n] = passed[probe]
    return np.maximum(found, np.arange(n) + 1)


class _Marker:
    """Follows the jumps of sorted batches; holds the open span of the last group between batches."""

    def __init__(self, groups: list[str], closed: bool, entered: bool):
        self.groups, self.closed, self.entered = groups, closed, entered
        self.last, self.end, self.since = None, None, None

    def mark(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Which rows open a span, and when each row's span was opened."""
        n = len(batch)
        at, until = batch.column("_at").to_numpy(), batch.column("_until").to_numpy()
        new = np.zeros(n, bool)
        for c in self.groups:
            x = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        name = lambda i: [batch.column(c)[i].as_py() for c in self.groups]
        going_on = self.last is not None and name(0) == self.last
        starts = np.r_[0, np.flatnonzero(new)]
        jump = next_openers(np.cumsum(new), at, until, self.closed).tolist()
        ends = np.r_[starts[1:], n]
        opens, since = np.zeros(n, bool), np.zeros(len(starts), np.int64)
        for g, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            if a == 0 and going_on:
                end, opened = self.end, self.since
            elif self.entered:
                end, opened = batch.column("_entry_end")[a].as_py(), batch.column("_entry_at")[a].as_py()
            else:
                end = opened = None
            i = a if end is None else a + int(np.searchsorted(at[a:b], end, "right" if self.closed else "left"))
            since[g] = opened or 0
            while i < b:
                opens[i] = True
                end, opened, i = until[i], at[i], jump[i]
        self.last, self.end, self.since = name(n - 1), int(end), int(opened)
        opener = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
        own = opener >= np.repeat(starts, ends - starts)
        return opens, np.where(own, at[opener], np.repeat(since, ends - starts))


def _marked(rows: DataFrame, groups: list[str], passed: list[str], closed: bool, entered: bool) -> DataFrame:
    """One pass over rows that lie sorted within their groups."""
    schema = T.StructType([*(rows.schema[c] for c in passed), T.StructField("opens", T.BooleanType()), T.StructField("span_at", T.LongType())])
    names = schema.names

    def run(batches):
        marker = _Marker(groups, closed, entered)
        for batch in batches:
            if len(batch):
                opens, since = marker.mark(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(opens), pa.array(since)], names=names)

    return rows.mapInArrow(run, schema)


def _pieces(closed: bool):
    """Per slot: which of its spans is the last one, by the row that the span before it leads to."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        at, until = table.column("_at").to_numpy(), table.column("_until").to_numpy()
        n = len(at)
        jump = np.minimum(next_openers(np.zeros(n, np.int64), at, until, closed), n)
        last = np.arange(n)
        while (jump < n).any():
            inner = np.minimum(jump, n - 1)
            last = np.where(jump < n, last[inner], last)
            jump = np.where(jump < n, jump[inner], n)
        final = np.flatnonzero(np.r_[last[1:] != last[:-1], True])  # the last row of each piece
        out = last[final]
        size = len(final)
        return pa.table({
            "_key": pa.array(np.full(size, table.column("_key")[0].as_py())), "_slot": pa.array(np.full(size, table.column("_slot")[0].as_py())),
            "piece": pa.array(np.arange(size)), "upto": pa.array(at[final]), "end": pa.array(until[out]), "since": pa.array(at[out]),
            "newest": pa.array(np.full(size, at[-1])),
        })

    return run


def _jumps(pieces: DataFrame, closed: bool, slot_rows: int) -> DataFrame:
    """_key, node, next: the piece that each piece's last span leads to, where there is one. A node is (slot, piece)."""
    node = F.struct(F.col("_slot").alias("slot"), "piece").alias("node")
    # a span that ends before its own row leads to the next slot's first piece
    short = F.col("end") < F.col("newest") if closed else F.col("end") <= F.col("newest")
    here = F.struct(F.col("upto").alias("x"), F.lit(1).alias("kind"), F.col("_slot").alias("slot"), F.col("piece").cast("bigint").alias("piece"))
    there = F.struct(
        F.when(short, F.col("newest")).otherwise(F.col("end")).alias("x"), F.when(short, 1).otherwise(2 if closed else 0).alias("kind"),
        F.col("_slot").alias("slot"), F.lit(1 << 40).alias("piece"),
    )
    both = pieces.select("_key", node, F.explode(F.array(F.struct(here.alias("p"), F.lit(True).alias("is_piece")), F.struct(there.alias("p"), F.lit(False).alias("is_piece")))).alias("m"))
    # backwards in time, so that the piece after a place is the last one seen
    back = both.select(
        "_key", "node", (-F.col("m.p.x")).alias("_x"), (-F.col("m.p.kind")).alias("_kind"), (-F.col("m.p.slot")).alias("_s"), (-F.col("m.p.piece")).alias("_p"),
        F.col("m.is_piece").alias("_is_piece"), F.when(F.col("m.is_piece"), F.col("node")).alias("_named"),
    )
    seen = ordered_scan(back, ["_key"], "_x", ["_kind", "_s", "_p"], slot_rows, last_seen={"next": "_named"})
    return seen.where(~F.col("_is_piece") & F.col("next").isNotNull()).select("_key", "node", "next")


def reached(jumps: DataFrame, first: DataFrame) -> DataFrame:
    """All (_key, node) that jumps lead to from ``first``. Jumps double in every round; what is known to be reached doubles with them."""
    known, jumps = cut(first), cut(jumps)
    new = known
    while True:
        new = cut(known.join(jumps, ["_key", "node"]).select("_key", F.col("next").alias("node")))
        if new.isEmpty():
            return known
        known = cut(known.unionByName(new))
        onward = jumps.select("_key", F.col("node").alias("next"), F.col("next").alias("far"))
        jumps = cut(jumps.join(onward, ["_key", "next"]).select("_key", "node", F.col("far").alias("next")))


def slot_entries(rows: DataFrame, closed: bool, slot_rows: int) -> DataFrame:
    """_key, _slot, _entry_end, _entry_at: the span that is open when a slot begins, null for a key's first slot."""
    shape = "_key long, _slot long, piece long, upto long, end long, since long, newest long"
    pieces = cut(rows.select("_key", "_slot", "_pos", "_at", "_until").groupBy("_key", "_slot").applyInArrow(_pieces(closed), shape))
    node = F.struct(F.col("_slot").alias("slot"), "piece").alias("node")
    first = pieces.groupBy("_key").agg(F.min(node).alias("node"))
    there = reached(_jumps(pieces, closed, slot_rows), first)
    left = pieces.select("_key", node, F.struct("end", "since").alias("left")).join(there, ["_key", "node"]).select("_key", F.col("node.slot").alias("_slot"), "left")
    places = pieces.select("_key", "_slot").distinct().join(left, ["_key", "_slot"], "left")
    before = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.last("left", ignorenulls=True).over(before)
    return places.select("_key", "_slot", entry.getField("end").alias("_entry_end"), entry.getField("since").alias("_entry_at"))


def renewal_chain(rows: DataFrame, keys: list[str], at: str, order: list[str], closed: bool, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Mark the rows that open a new span while none is open.

    A row joins the open span when its time lies before the span's end, or at it when ``closed``. Times are long columns ``_at`` (which
    rises with ``at``) and ``_until``, each row's own end, in microseconds. Adds ``opens`` and the opener's time ``span_at``. Null
    keys are a key; rows of the same time go by ``order``.
    """
    passed = rows.columns
    light, heavy, n = light_and_heavy(rows, keys, slot_rows)
    done = []
    if light is not None:
        placed = light.repartition(*keys) if keys else light.coalesce(1)
        done.append(_marked(placed.sortWithinPartitions(*keys, at, *order), keys, passed, closed, False))
    if heavy is not None:
        cut_up = slots(heavy, [at, *order], slot_rows, n).withColumnRenamed("_hot", "_key")
        entered = cut_up.join(slot_entries(cut_up, closed, slot_rows), ["_key", "_slot"])
        placed = entered.repartition("_key", "_slot").sortWithinPartitions("_key", "_slot", "_pos")
        done.append(_marked(placed, ["_key", "_slot"], passed, closed, True))
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])
