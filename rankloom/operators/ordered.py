"""Ordered scans per key that survive a hot key.

A plain window over one key puts all rows of that key into one task. Keys are counted first: those of at most a bound of rows,
usually all, take the plain window. The rows of the others are sorted into ranges of (key, time, order), written once and
numbered in slots of at most the bound, whatever their times. A window then runs inside a (key, slot), and one summary row per slot
carries what later slots need: a prefix scan of two levels, whose upper one has a row per slot.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.validation import DEFAULT_TOP_K, MAX_TOP_K
from rankloom.session import cut

#: Most rows of one window, rounded down to a power of two.
SLOT_ROWS = 1 << 20


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of all keys in which nulls are equal."""
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys], F.lit(True))


def light_and_heavy(df: DataFrame, keys: list[str], most: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """The rows of keys with at most ``most`` rows, the rows of the others, and how many these are; None for a side without rows.

    Only keys over the bound are written and joined: at most one for ``most`` rows of the table. The other rows get ``_hot``, its number.
    """
    if not keys:
        n = df.count()
        return (None, df.withColumn("_hot", F.lit(0).cast("bigint")), n) if n > most else (df, None, 0)
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    if not (counted.agg(F.sum("_n").alias("n")).first().n or 0):
        return df, None, 0
    heavy = cut(counted.withColumn("_hot", F.monotonically_increasing_id()))
    n = heavy.agg(F.sum("_n").alias("n")).first().n
    mine = same(df, heavy, keys)
    return df.join(heavy, mine, "left_anti"), df.join(heavy, mine).select(df["*"], heavy["_hot"]), n


def slots(heavy: DataFrame, order: list[str], most: int, n: int) -> DataFrame:
    """Rows of heavy keys, written once in ranges of (_hot, order), with ``_pos``, which rises in that order, and ``_slot`` of at most ``most`` of them.

    Ranges are as even as a sample tells; the numbers that Spark gives the rows of a range cut it into slots, so the bound is strict.
    """
    place = [F.col(c) for c in ["_hot", *order]]
    placed = heavy.repartitionByRange(-(-n // most) + 1, *place).sortWithinPartitions(*place)
    return cut(placed.withColumn("_pos", F.monotonically_increasing_id())).withColumn("_slot", F.shiftright("_pos", most.bit_length() - 1))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    ts: str,
    order: list[str],
    slot_rows: int = SLOT_ROWS,
    previous: dict[str, str] | None = None,
    last_seen: dict[str, str] | None = None,
    running_sum: dict[str, str] | None = None,
    running_max: dict[str, str] | None = None,
    prior_max: dict[str, str] | None = None,
) -> DataFrame:
    """Add running columns per key in the order ``[ts, *order]``, nulls first.

    Each dict maps a new column to its input: ``previous`` is the value of the row before
    (nulls included), ``last_seen`` the latest non-null value up to and including the row,
    ``running_sum`` and ``running_max`` run up to and including the row, ``prior_max`` up to the row before.
    Null keys are a key. No window holds more than ``slot_rows`` rows, but for the summaries, one for each ``slot_rows`` of a hot key.
    """
    previous, last_seen = previous or {}, last_seen or {}
    running_sum, running_max, prior_max = running_sum or {}, running_max or {}, prior_max or {}
    sort = [F.col(c) for c in [ts, *order]]

    def scanned(rows: DataFrame, group: list[str], place: list[Column]) -> DataFrame:
        inside = Window.partitionBy(*group).orderBy(*place)
        upto, before = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns(
            {
                **{f"_p_{o}": F.lag(F.struct(F.col(c).alias("v"))).over(inside) for o, c in previous.items()},
                **{f"_l_{o}": F.last(c, ignorenulls=True).over(upto) for o, c in last_seen.items()},
                **{f"_s_{o}": F.sum(c).over(upto) for o, c in running_sum.items()},
                **{f"_m_{o}": F.max(c).over(upto) for o, c in running_max.items()},
                **{f"_m_{o}": F.max(c).over(before) for o, c in prior_max.items()},
            }
        )

    light, heavy, n = light_and_heavy(df, keys, slot_rows)
    found = []
    if light is not None:
        added = {
            **{o: F.col(f"_p_{o}").getField("v") for o in previous},
            **{o: F.col(f"_l_{o}") for o in last_seen},
            **{o: F.coalesce(F.col(f"_s_{o}"), F.lit(0)) for o in running_sum},
            **{o: F.col(f"_m_{o}") for o in [*running_max, *prior_max]},
        }
        found.append(scanned(light, keys, sort).select(*df.columns, *[c.alias(o) for o, c in added.items()]))
    if heavy is None:
        return found[0]

    rows = slots(heavy, [ts, *order], slot_rows, n)
    summary = rows.groupBy("_hot", "_slot").agg(
        F.lit(1).alias("_one"),
        *[F.max_by(F.struct(F.col(c).alias("v")), "_pos").alias(f"_cp_{o}") for o, c in previous.items()],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_pos"))).alias(f"_cl_{o}") for o, c in last_seen.items()],
        *[F.sum(c).alias(f"_cs_{o}") for o, c in running_sum.items()],
        *[F.max(c).alias(f"_cm_{o}") for o, c in {**running_max, **prior_max}.items()],
    )
    across = Window.partitionBy("_hot").orderBy("_slot")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        "_hot",
        "_slot",
        *[F.lag(f"_cp_{o}").over(across).alias(f"_cp_{o}") for o in previous],
        *[F.last(f"_cl_{o}", ignorenulls=True).over(before).alias(f"_cl_{o}") for o in last_seen],
        *[F.sum(f"_cs_{o}").over(before).alias(f"_cs_{o}") for o in running_sum],
        *[F.max(f"_cm_{o}").over(before).alias(f"_cm_{o}") for o in [*running_max, *prior_max]],
    )
    joined = scanned(rows, ["_hot", "_slot"], [F.col("_pos")]).join(carry, ["_hot", "_slot"])
    added = {
        **{o: F.coalesce(F.col(f"_p_{o}"), F.col(f"_cp_{o}")).getField("v") for o in previous},
        **{o: F.coalesce(F.col(f"_l_{o}"), F.col(f"_cl_{o}")) for o in last_seen},
        **{
            o: F.coalesce(F.col(f"_s_{o}"), F.lit(0)) + F.coalesce(F.col(f"_cs_{o}"), F.lit(0)) for o in running_sum
        },
        **{o: F.greatest(F.col(f"_m_{o}"), F.col(f"_cm_{o}")) for o in [*running_max, *prior_max]},
    }
    found.append(joined.select(*df.columns, *[c.alias(o) for o, c in added.items()]))
    return reduce(DataFrame.unionByName, found)


def asked_k(top_k: int | str) -> Column:
    """How many results a query wants: a number for all, or a column of its own, null for the usual number; between 1 and the most allowed."""
    if isinstance(top_k, int):
        return F.lit(top_k)
    return F.greatest(F.lit(1), F.least(F.coalesce(F.col(top_k), F.lit(DEFAULT_TOP_K)), F.lit(MAX_TOP_K))).cast("int")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int | str, rank: str = "rank", most: int = MAX_TOP_K) -> DataFrame:
    """First ``n`` rows per key with their 1-based rank; ``n`` may name a column, with at most ``most``. Spark prunes to that before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= (n if isinstance(n, int) else most))
    return ranked if isinstance(n, int) else ranked.filter(F.col(rank) <= F.col(n))


def best_rows(found: pa.Table) -> pa.Table:
    """Of (query_id, k, id, score) each query's ``k`` best, in the order of ``top_rows`` by score and id; in order of queries."""
    score = found.column("score").to_numpy()
    keyed = found.append_column("_s", pa.array(np.where(np.isnan(score), np.inf, score)))
    order = pc.sort_indices(keyed, [("query_id", "ascending"), ("_s", "descending"), ("id", "ascending")], null_placement="at_start")
    found = found.take(order)
    code = found.column("query_id").combine_chunks().dictionary_encode("encode").indices.to_numpy()
    rank = np.arange(len(code)) - np.searchsorted(code, code, "left")
    return found.filter(pa.array(rank < found.column("k").to_numpy()))
