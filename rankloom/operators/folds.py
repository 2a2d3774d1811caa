"""Keyed state machines over time, without ever holding a key's rows in one task.

Rows of a key are numbered in time order and cut into chunks of bounded length. Every chunk is folded
in parallel from an assumed entry state; the exit state of each chunk then becomes the entry state of the
next, and chunks whose entry changed are folded again until none does. The result is that of one
fold over the whole key. Short keys are one chunk and take one pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.operators.ordered import SLOT_ROWS, ordered_scan
from rankloom.session import cut

CHUNK_ROWS = 500_000


def _folder(keys: list[str], inputs: list[str], passed: list[str], n_out: int, start: Callable, step: Callable, chunk_rows: int):
    """Iterator function: streams sorted rows, resets at every new (key, chunk), never holds a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for pdf in batches:
            columns = [pdf[c].to_numpy(dtype=object) for c in [*keys, "_chunk"]]
            fields = [pdf[c].to_numpy(dtype=object) for c in inputs]
            entry, pos = pdf["_entry"].to_numpy(dtype=object), pdf["_pos"].to_numpy()
            outs, exits = [[] for _ in range(n_out)], []
            for i in range(len(pdf)):
                here = tuple(c[i] for c in columns)
                if here != group:
                    group, state = here, (json.loads(entry[i]) if entry[i] else start())
                state, values = step(state, *[f[i] for f in fields])
                for o, v in zip(outs, values):
                    o.append(v)
                exits.append(json.dumps(state) if pos[i] and pos[i] % chunk_rows == 0 else None)
            out = pdf[passed + ["_chunk", "_pos"]].copy()
            for j, o in enumerate(outs):
                out[f"_o{j}"] = o
            out["_exit"] = exits
            yield out

    return run


def keyed_fold(
    rows: DataFrame,
    keys: list[str],
    at: str,
    order: list[str],
    inputs: list[str],
    output: str,
    start: Callable[[], list],
    step: Callable,
    chunk_rows: int = CHUNK_ROWS,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Add the columns of ``output`` (a DDL string) that a state machine gives per key in time order.

    ``start()`` is the state before the first row, a list of JSON values; ``step(state, *inputs)`` returns
    the next state and the tuple of output values.
    """
    fields = T.StructType.fromDDL(output).fields
    passed = rows.columns
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField("_chunk", T.LongType()),
            T.StructField("_pos", T.LongType()),
            *[T.StructField(f"_o{i}", f.dataType) for i, f in enumerate(fields)],
            T.StructField("_exit", T.StringType()),
        ]
    )
    run = _folder(keys, inputs, passed, len(fields), start, step, chunk_rows)

    def fold(part: DataFrame) -> DataFrame:
        placed = part.repartition(*keys, "_chunk").sortWithinPartitions(*keys, "_chunk", at, *order)
        return placed.mapInPandas(run, schema)

    def finish(done: DataFrame) -> DataFrame:
        return done.select(*passed, *[F.col(f"_o{i}").alias(f.name) for i, f in enumerate(fields)])

    longest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if longest <= chunk_rows:
        zero = F.lit(0).cast("bigint")
        return finish(fold(rows.withColumns({"_pos": zero, "_chunk": zero, "_entry": F.lit(None).cast("string")})))

    numbered = ordered_scan(rows.withColumn("_one", F.lit(1)), keys, at, order, slot_rows, running_sum={"_pos": "_one"})
    numbered = cut(numbered.drop("_one").withColumn("_chunk", F.floor((F.col("_pos") - 1) / chunk_rows)))
    done = cut(fold(numbered.withColumn("_entry", F.lit(None).cast("string"))))
    chunk = [*keys, "_chunk"]
    assumed = done.select(*chunk).distinct().withColumn("_entry", F.lit(None).cast("string"))
    while True:
        exits = done.filter(F.col("_exit").isNotNull()).select(
            *keys, (F.col("_chunk") + 1).alias("_chunk"), F.col("_exit").alias("_entry")
        )
        known = assumed.withColumnRenamed("_entry", "_was")
        changed = cut(known.join(exits, chunk).filter(~F.col("_entry").eqNullSafe(F.col("_was"))).select(*chunk, "_entry"))
        if changed.isEmpty():
            return finish(done)
        assumed = cut(assumed.join(changed, chunk, "left_anti").unionByName(changed))
        again = fold(numbered.join(changed, chunk))
        done = cut(done.join(changed, chunk, "left_anti").unionByName(again))
