"""Exact top-k inner products: exhaustive term-at-a-time accumulation over blocks of rows.

Vectors become sparse rows of integers. A block of candidates is inverted: per dimension its posting list, the candidates that
have a value there and their weights. A query takes its non-zero dimensions one at a time and scatters weight times posting into
a dense score array of the block; a list that covers most of the block is kept dense, so that the scatter is one array addition.
Each block keeps its best k by partition selection; the lists of all blocks merge per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.session import cut

SCALE, K = 64, 20
#: Rows of a block: what a task holds is one block of each side.
QUERY_BLOCK, ROW_BLOCK = 2048, 16384


class Postings:
    """The inverted block: per dimension either (places, weights) or a dense column."""

    def __init__(self, rows: np.ndarray):
        self.size = len(rows)
        self.lists = []
        for column in np.ascontiguousarray(rows.T):
            at = np.flatnonzero(column)
            self.lists.append(None if not len(at) else (None, column) if 4 * len(at) > self.size else (at, column[at]))

    def scores(self, query: np.ndarray, out: np.ndarray, room: np.ndarray) -> np.ndarray:
        out[:] = 0
        for d in np.flatnonzero(query[: len(self.lists)]):
            if self.lists[d] is not None:
                at, weights = self.lists[d]
                if at is None:
                    np.multiply(weights, query[d], out=room)
                    np.add(out, room, out=out)
                else:
                    out[at] += query[d] * weights
        return out


def block_best(queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_rows: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """Per query the places and scores of its k best rows of the block, its own row aside; ties by id, then row."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(rows.shape[1], 1)
    kind = np.int32 if most < 2**31 else np.int64
    postings, queries = Postings(rows.astype(kind)), queries.astype(kind)
    scores, room, found = np.zeros(len(rows), kind), np.zeros(len(rows), kind), []
    for q, own in zip(queries, query_rows.tolist(), strict=True):
        s = postings.scores(q, scores, room)
        if len(s) > k + 1:
            edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]  # at least k + 1 rows reach it: one may be the query itself
            at = np.flatnonzero(s >= edge)
        else:
            at = np.arange(len(s))
        at = at[row_rows[at] != own]
        at = at[np.lexsort((row_rows[at], row_ids[at], -s[at].astype(np.int64)))[:k]]
        found.append((at, s[at].astype(np.int64)))
    return found


def quantised(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Written once: _row, _id and _v, floor(scale * x) of every component. Vectors that are null, or hold null or non-finite components, are left out.

    Components are computed as doubles; scores must fit into a long.
    """
    good = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = df.select(F.col(id_col).cast("long").alias("_id"), F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("_v"), F.coalesce(good, F.lit(False)).alias("_good"))
    return cut(own.where("_good").drop("_good").withColumn("_row", F.monotonically_increasing_id()))


def _narrow(values: np.ndarray) -> np.ndarray:
    """The values in as few bytes each as the largest of them needs."""
    low, high = values.min(initial=0), values.max(initial=0)
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """One row per block of about ``size`` rows: its number, ids, row numbers and vectors side by side; and how many blocks there are.

    ``values`` are bytes, ``width`` of them a value.
    """
    n = max(1, -(-rows.count() // size))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        dims = part["_v"].map(len)
        values = _narrow(np.concatenate(part["_v"].tolist()) if dims.sum() else np.zeros(0, np.int64))
        return pd.DataFrame({
            name: [part[name].iloc[0]], "ids": [part["_id"].to_numpy()], "rows": [part["_row"].to_numpy()],
            "dims": [dims.to_numpy()], "width": [values.itemsize], "values": [values.tobytes()],
        })

    # a null id becomes the largest one, so that it comes last among ties
    dealt = rows.withColumn("_id", F.coalesce("_id", F.lit(2**63 - 1))).withColumn(name, F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int"))
    return cut(dealt.groupBy(name).applyInPandas(build, f"{name} int, ids array<long>, rows array<long>, dims array<int>, width int, values binary")), n


def _matrix(dims, width: int, values: bytes) -> np.ndarray:
    dims, values = np.asarray(dims, np.int64), np.frombuffer(values, f"<i{width}")
    out = np.zeros((len(dims), dims.max(initial=0)), np.int64)
    row = np.repeat(np.arange(len(dims)), dims)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(dims) - dims, dims)] = values
    return out


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other rows (all, if fewer), ties to the smaller id.

    ``is_query``: a condition on the column _id. Shorter vectors have zeros behind. Rows are told apart by themselves, so that a
    repeated row finds its copies; a null id is no query and comes last among ties.
    """
    rows = quantised(df, id_col, vector, scale)
    queries, _ = _blocks(rows.where(is_query), QUERY_BLOCK, "q_block")
    cands, n_cands = _blocks(rows, ROW_BLOCK, "r_block")
    asked = queries.select("q_block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "dims", "width", "values")])
    # Every block of queries, the smaller side, goes to every block of rows. Compressed files say little of the blocks' size in memory,
    # so neither side may be broadcast; as many partitions as blocks keep few bytes with much work apart.
    asked = asked.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(n_cands - 1)))).repartition(n_cands, "r_block")
    pairs = asked.hint("merge").join(cands.repartition(n_cands, "r_block"), "r_block")

    def search(batches):
        for batch in batches:
            for i in range(len(batch)):
                p = {c: batch.column(c)[i].values.to_numpy() for c in ("q_ids", "q_rows", "q_dims", "ids", "rows", "dims")}
                mine, theirs = (_matrix(p[f"{s}dims"], batch.column(f"{s}width")[i].as_py(), batch.column(f"{s}values")[i].as_py()) for s in ("q_", ""))
                ids, own = p["ids"], p["rows"]
                found = block_best(mine, p["q_rows"], theirs, ids, own, k)
                sizes = [len(at) for at, _ in found]
                at, score = np.concatenate([a for a, _ in found]), np.concatenate([s for _, s in found])
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(p["q_ids"], sizes)), "q_row": pa.array(np.repeat(p["q_rows"], sizes)), "vec_id": pa.array(ids[at]), "row": pa.array(own[at]), "score": pa.array(score),
                })

    per_block = pairs.mapInArrow(search, "query_id long, q_row long, vec_id long, row long, score long")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row")
    merged = per_block.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    none = F.when(F.col("vec_id") < 2**63 - 1, F.col("vec_id"))
    return merged.select("query_id", "rank", none.alias("vec_id"), "score")
