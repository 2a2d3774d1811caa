"""Vector search: nearest vectors by blocks, exact or through hash buckets."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.functions.vectors import as_double
from rankloom.operators.ordered import asked_k, best_rows, top_rows
from rankloom.session import cut, cut_packed, discard, meet_packed, small

BLOCK_ROWS = 8192
PART_ROWS = 16384
#: Copies of its rows that a group's blocks and parts may take through the shuffle; vectors of larger groups are packed. Pairs of a task.
COPIES, TASK_PAIRS = 4, 1 << 33
_STEP = 256
#: Pairs computed as doubles at a time.
_PAIRS = 8192


def similarities(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of every row of ``q`` with every row of ``d``."""
    products = q @ d.T
    if metric == "ip":
        return products
    nq, nd = (q * q).sum(axis=1), (d * d).sum(axis=1)
    if metric == "cosine":
        norms = np.sqrt(np.outer(nq, nd))
        return np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)
    if metric == "l2":
        return 1.0 / (1.0 + np.sqrt(np.maximum(nq[:, None] + nd[None, :] - 2.0 * products, 0.0)))
    raise ValueError(f"unknown metric {metric}")


def _comparable(m: np.ndarray, squares: np.ndarray) -> bool:
    """Whether the vectors can be scaled to length 1 (or are zero)."""
    return bool(np.isfinite(m).all() and ((squares == 0) | ((squares > 1e-100) & (squares < 1e100))).all())


def _squares(m: np.ndarray) -> np.ndarray:
    """Sum of squares of every row, a few rows at a time: a block is never held once more."""
    out = np.empty(len(m))
    for at in range(0, len(m), _STEP):
        some = m[at : at + _STEP]
        out[at : at + _STEP] = (some * some).sum(axis=1)
    return out


def _unit(m: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Every row scaled to length 1, in single precision."""
    out = np.empty(m.shape, np.float32)
    norms = np.sqrt(np.where(squares > 0, squares, 1.0))[:, None]
    for at in range(0, len(m), _STEP):
        out[at : at + _STEP] = m[at : at + _STEP] / norms[at : at + _STEP]
    return out


def _best_cosines(qs: pd.DataFrame, ds: pd.DataFrame, qm: np.ndarray, dm: np.ndarray, min_score: float | None, skip_same: bool, earlier: bool):
    """Per query its best ``k``: single precision leaves out what cannot be among them, the rest is computed as doubles.

    Both sides are in order of ``seq`` if ``earlier``, so that a step meets only the rows before its last query.
    """
    nq, nd = _squares(qm), _squares(dm)
    qu, du = _unit(qm, nq), _unit(dm, nd)
    slack = 2e-6 + 1.2e-7 * (dm.shape[1] + 4)
    q_ids, ks, ids = qs["query_id"].to_numpy(), qs["k"].to_numpy(), ds["id"].to_numpy()
    place = np.empty(len(ids), np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    if earlier:
        q_seq, d_seq = qs["seq"].to_numpy(), ds["seq"].to_numpy()
    if skip_same:
        own = pd.merge(pd.DataFrame({"id": q_ids, "q": np.arange(len(q_ids))}), pd.DataFrame({"id": ids, "d": np.arange(len(ids))}), on="id").sort_values("q")
        own_q, own_d = own["q"].to_numpy(), own["d"].to_numpy()
    for at in range(0, len(qs), _STEP):
        end = min(at + _STEP, len(qs))
        n = int(np.searchsorted(d_seq, q_seq[at:end].max(), "left")) if earlier else len(ids)
        if not n:
            continue
        sims = qu[at:end] @ du[:n].T
        if earlier:
            sims[d_seq[None, :n] >= q_seq[at:end, None]] = -2
        if skip_same:
            some = slice(*np.searchsorted(own_q, [at, end]))
            inside = own_d[some] < n
            sims[own_q[some][inside] - at, own_d[some][inside]] = -2
        floor, most = np.full(end - at, -1.5 if min_score is None else max(-1.5, min_score - slack)), int(ks[at:end].max())
        groups = 8 * most
        if n >= 2 * groups:  # so many groups reach the k-th best of their maxima, that so many rows do
            tops = sims[:, : n // groups * groups].reshape(end - at, groups, -1).max(axis=2)
            floor = np.maximum(floor, np.partition(tops, groups - most, axis=1)[:, groups - most] - slack)
        q, d = np.nonzero(sims >= floor[:, None].astype(np.float32))
        score = np.empty(len(q))
        for i in range(0, len(q), _PAIRS):
            a, b = q[i : i + _PAIRS] + at, d[i : i + _PAIRS]
            norms = np.sqrt(nq[a] * nd[b])
            products = np.einsum("ij,ij->i", qm[a], dm[b])
            score[i : i + _PAIRS] = np.round(np.divide(products, norms, out=np.zeros(len(a)), where=norms > 0), 6)
        if min_score is not None:
            good = score >= min_score
            q, d, score = q[good], d[good], score[good]
        order = np.lexsort((place[d], -score, q))
        q, d, score = q[order], d[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        kept = rank < ks[at + q]
        yield pd.DataFrame({"query_id": q_ids[at + q[kept]], "k": ks[at + q[kept]], "id": ids[d[kept]], "score": score[kept] + 0.0})


def _block_top_k(metric: str, min_score: float | None, skip_same: bool, earlier: bool) -> Callable:
    """Task function: each query's best ``k`` of one corpus part, for the queries of one block."""

    def best(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out, frames = [], []
        q_len, d_len = q["embedding"].map(len), d["embedding"].map(len)
        for length in set(q_len[q_len > 0]) & set(d_len):
            qs, ds = q[q_len == length], d[d_len == length]
            if earlier:
                qs, ds = qs.sort_values("seq", kind="stable"), ds.sort_values("seq", kind="stable")
            dm, ids = np.stack(ds["embedding"].to_numpy()).astype(float, copy=False), ds["id"].to_numpy()
            if metric == "cosine" and not (earlier and (qs["seq"].isna().any() or ds["seq"].isna().any())):
                qm = np.stack(qs["embedding"].to_numpy()).astype(float, copy=False)
                if _comparable(qm, _squares(qm)) and _comparable(dm, _squares(dm)):
                    frames.extend(_best_cosines(qs, ds, qm, dm, min_score, skip_same, earlier))
                    continue
            for at in range(0, len(qs), _STEP):
                chunk = qs.iloc[at : at + _STEP]
                sims = np.round(similarities(np.stack(chunk["embedding"].to_numpy()).astype(float), dm, metric), 6)
                allowed = np.ones(sims.shape, dtype=bool)
                if skip_same:
                    allowed &= chunk["query_id"].to_numpy()[:, None] != ids[None, :]
                if earlier:
                    allowed &= ds["seq"].to_numpy()[None, :] < chunk["seq"].to_numpy()[:, None]
                if min_score is not None:
                    allowed &= sims >= min_score
                for qid, k, row, ok in zip(chunk["query_id"], chunk["k"], sims, allowed):
                    pick = np.flatnonzero(ok)
                    if len(pick) > k:
                        floor = np.partition(row[pick], len(pick) - k)[len(pick) - k]
                        pick = pick[row[pick] >= floor]
                    pick = pick[np.lexsort((ids[pick], -row[pick]))][:k]
                    out.extend((qid, k, ids[i], row[i] + 0.0) for i in pick)
        if out or not frames:
            frames.append(pd.DataFrame(out, columns=["query_id", "k", "id", "score"]))
        return pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]

    return best


def _parts(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))


def _packed(df: DataFrame, prefix: str, rows: int, n: int, order: str) -> DataFrame:
    """Written: rows of one group (``_g``) and vector length in order of ``order``, at most ``rows`` in one, columns as arrays and vectors as one value.

    Names begin with ``prefix``. ``low`` and ``high`` are the ends of ``order``.
    """
    lists = [c for c in df.columns if c not in ("_g", "embedding")]
    shape = T.StructType([T.StructField("pack", T.LongType()), T.StructField("_g", T.LongType()), T.StructField("dim", T.IntegerType())])
    for c in lists:
        shape = shape.add(c, T.ArrayType(df.schema[c].dataType))
    shape = shape.add("low", df.schema[order].dataType).add("high", df.schema[order].dataType).add("vectors", T.BinaryType())
    schema = to_arrow_schema(shape)
    cores = df.sparkSession.sparkContext.defaultParallelism
    ranges = max(_parts(n, 4 * rows), min(cores, _parts(n, rows)))

    def pack(batches):
        open_, group, number = {}, None, 0

        def done(dim: int, last: bool = True):
            nonlocal number
            made = pa.concat_tables(x for x, _ in open_[dim]).combine_chunks()
            m = np.concatenate([x for _, x in open_.pop(dim)])
            part = made.column("part")[0].as_py()
            for at in range(0, len(m), rows):
                some = made.slice(at, rows)
                if len(some) < rows and not last:
                    open_[dim] = [(some, m[at:].copy())]
                    break
                ends = pc.min_max(some.column(order)).as_py()
                row = {"pack": (part << 32) + number, "_g": group, "dim": dim, "low": ends["min"], "high": ends["max"], "vectors": m[at : at + rows].tobytes()}
                number += 1
                row |= {c: pa.ListArray.from_arrays([0, len(some)], some.column(c).combine_chunks()) for c in lists}
                yield pa.RecordBatch.from_arrays([x if isinstance(x := row[f.name], pa.Array) else pa.array([x], f.type) for f in schema], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            length = pc.fill_null(pc.list_value_length(table.column("embedding")), 0).to_numpy()
            at = batch.column("_g").to_numpy()
            for g in dict.fromkeys(at.tolist()):
                if g != group:
                    for dim in list(open_):
                        yield from done(dim)
                    group = g
                for dim in set(length[at == g].tolist()) - {0}:
                    some = table.filter(pa.array((at == g) & (length == dim)))
                    flat = pc.list_flatten(some.column("embedding")).to_numpy()
                    gathered = open_.setdefault(dim, [])
                    gathered.append((some.select(["part", *lists]), flat.astype("<f8").reshape(-1, dim)))
                    if sum(len(m) for _, m in gathered) >= rows:
                        yield from done(dim, last=False)
        for dim in list(open_):
            yield from done(dim)

    placed = df.repartitionByRange(ranges, "_g", order).sortWithinPartitions("_g", order).withColumn("part", F.spark_partition_id().cast("long"))
    return cut_packed(placed.mapInArrow(pack, shape).toDF(*[f"{prefix}{f.name}" for f in shape]))


def _packed_top_k(block: Callable, schema: pa.Schema) -> Callable:
    """Task function: best ``k`` of all packs of vectors that pass each pack of queries."""

    def frame(row: dict, ids: str, names: list[str]) -> pd.DataFrame:
        m = np.frombuffer(row["vectors"].as_buffer(), "<f8").reshape(-1, row["dim"].as_py())
        return pd.DataFrame({ids: row["id"].values.to_pandas()} | {c: row[c].values.to_pandas() for c in names} | {"embedding": list(m)})

    def run(batches):
        asked, found = {}, {}
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                key = row["q_pack"].as_py()
                extra = ["seq"] if "seq" in row else []
                if key not in asked:
                    own = {c.removeprefix("q_"): x for c, x in row.items() if c.startswith("q_")}
                    asked[key] = frame(own | {"id": own["query_id"]}, "query_id", ["k", *extra])
                some = block(asked[key], frame(row, "id", extra))
                if len(some):
                    table = pa.Table.from_pandas(some, schema, preserve_index=False)
                    found[key] = best_rows(pa.concat_tables([found[key], table]) if key in found else table)
        for table in found.values():
            yield from table.to_batches()

    return run


def vector_search(
    queries: DataFrame,
    corpus: DataFrame,
    metric: str = "cosine",
    top_k: int | str = 10,
    min_score: float | None = None,
    within: tuple[str, ...] = (),
    skip_same: bool = False,
    earlier: bool = False,
    repeated: bool = False,
) -> DataFrame:
    """Top ``top_k`` corpus vectors per query as (query_id, rank, id, score); a column's name gives every query its own number.

    Queries and corpus are hashed into blocks and parts of bounded size, and one task compares
    one block with one part and returns the block's best ``top_k`` there. No pair of rows ever
    leaves a task and neither side is collected or broadcast. Where blocks and parts would take more than ``COPIES`` copies
    through the shuffle, both sides are packed into files instead, and tasks read the parts past one block each: disk grows with the
    tables, not with their product. Both sides are read more than once; cut() costly ones first. ``within`` names columns that both sides
    must share; a group of any size is cut like the whole. Vectors of other lengths never match.
    ``skip_same`` leaves out a vector's own id, ``earlier`` admits only a smaller ``seq``. ``repeated`` says that a
    pair may meet in several groups and counts once.
    """
    keys = list(within)
    extra = ["seq"] if earlier else []
    q = queries.select(*[F.col(c).alias(c) for c in keys], F.col("query_id").alias("query_id"), asked_k(top_k).alias("k"), *[F.col(c).alias(c) for c in extra], as_double("embedding").alias("embedding"))
    d = corpus.select(*[F.col(c).alias(c) for c in keys], F.col("id").alias("id"), *[F.col(c).alias(c) for c in extra], as_double("embedding").alias("embedding"))
    cores = q.sparkSession.sparkContext.defaultParallelism
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("k", T.IntegerType()),
            T.StructField("id", d.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    block = _block_top_k(metric, min_score, skip_same, earlier)

    def in_cells(q: DataFrame, d: DataFrame) -> DataFrame:
        def home(c: str, n: str) -> Column:
            return F.pmod(F.xxhash64(c), F.col(n))

        def every(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

        cell = [*keys, "_b", "_p"]
        q = q.withColumn("_b", home("query_id", "_nb")).withColumn("_p", every("_np")).drop("_nb", "_np")
        d = d.withColumn("_p", home("id", "_np")).withColumn("_b", every("_nb")).drop("_nb", "_np")
        return q.groupBy(*cell).cogroup(d.groupBy(*cell)).applyInPandas(block, schema)

    def in_packs(q: DataFrame, d: DataFrame, nq: int, nd: int, largest: int) -> DataFrame:
        asked = _packed(q, "q_", BLOCK_ROWS, nq, "seq" if earlier else "query_id")
        parts = _packed(d, "", PART_ROWS, nd, "seq" if earlier else "id")
        on = (F.col("_g") == F.col("q__g")) & (F.col("dim") == F.col("q_dim"))
        if earlier:
            on &= F.col("low") < F.col("q_high")
        blocks = _parts(nq, BLOCK_ROWS)
        streams = min(_parts(nd, PART_ROWS), max(_parts(3 * cores, blocks), _parts(largest * min(nq, BLOCK_ROWS), TASK_PAIRS)))
        best = meet_packed(parts, asked, on, streams, _packed_top_k(block, to_arrow_schema(schema)), schema)
        discard(asked, parts)
        return best

    found = []
    if keys:
        blocks = q.groupBy(*keys).agg(F.count("*").alias("_nq"), F.ceil(F.count("*") / BLOCK_ROWS).alias("_nb"))
        parts = d.groupBy(*keys).agg(F.count("*").alias("_nd"), F.ceil(F.count("*") / PART_ROWS).alias("_np"))
        far = F.col("_nq") * F.col("_np") + F.col("_nd") * F.col("_nb") > COPIES * (F.col("_nq") + F.col("_nd"))
        sizes = cut(blocks.join(parts, keys).withColumns({"_far": far, "_g": F.monotonically_increasing_id()}))
        of = sizes.groupBy("_far").agg(F.sum("_nq").alias("nq"), F.sum("_nd").alias("nd"), F.max("_nd").alias("largest"))
        of = {r["_far"]: r for r in of.collect()}  # two rows
        if False in of or not of:
            near = small(sizes.where("NOT _far").select(*keys, "_nb", "_np"))
            found.append(in_cells(q.join(near, keys), d.join(near, keys)))
        if True in of:
            groups = small(sizes.where("_far").select(*keys, "_g"))
            found.append(in_packs(q.join(groups, keys).drop(*keys), d.join(groups, keys).drop(*keys), of[True].nq, of[True].nd, of[True].largest))
    else:
        nq, nd = q.count(), d.count()
        nb, np_ = _parts(nq, BLOCK_ROWS), max(_parts(nd, PART_ROWS), min(cores, _parts(nd, 512)))
        if nq * np_ + nd * nb > COPIES * (nq + nd):
            found.append(in_packs(*(x.withColumn("_g", F.lit(0).cast("bigint")) for x in (q, d)), nq, nd, nd))
        else:
            cells = {"_nb": F.lit(nb).cast("bigint"), "_np": F.lit(np_).cast("bigint")}
            found.append(in_cells(q.withColumns(cells), d.withColumns(cells)))
    partial = reduce(DataFrame.unionByName, found)
    if repeated:
        partial = partial.distinct()
    return top_rows(partial, ["query_id"], [F.desc("score"), F.asc("id")], top_k if isinstance(top_k, int) else "k").select(
        "query_id", "rank", "id", "score"
    )


def hash_buckets(df: DataFrame, dim: int, tables: int, bits: int) -> DataFrame:
    """One row per vector and hash table with the bucket: the signs of ``bits`` projections.

    The hyperplanes follow from a rule, component i of plane p being sin(p * p + 7 p i + i * i),
    so that every job hashes alike without a stored model.
    """
    p = np.arange(1, tables * bits + 1, dtype=float)[:, None]
    i = np.arange(1, dim + 1, dtype=float)[None, :]
    planes = np.sin(p * p + 7 * p * i + i * i)
    powers = 1 << np.arange(bits)

    @F.pandas_udf("array<int>")
    def buckets(vectors: pd.Series) -> pd.Series:
        above = np.stack(vectors.to_numpy()).astype(float) @ planes.T >= 0
        return pd.Series(list((above.reshape(len(vectors), tables, bits) * powers).sum(axis=2).astype(np.int32)))

    usable = df.filter(F.size("embedding") == dim)
    return usable.select("*", F.posexplode(buckets("embedding")).alias("table_no", "bucket"))


def vector_search_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    dim: int,
    top_k: int | str = 10,
    tables: int = 8,
    bits: int = 4,
    skip_same: bool = False,
) -> DataFrame:
    """Approximate ``vector_search``: candidates share a bucket in some table, scores are exact."""
    return vector_search(
        hash_buckets(queries, dim, tables, bits),
        hash_buckets(corpus, dim, tables, bits),
        top_k=top_k,
        within=("table_no", "bucket"),
        skip_same=skip_same,
        repeated=True,
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact hits that were found, as (query_id, recall)."""
    hit = exact.join(found.select("query_id", "id", F.lit(1).alias("found")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.round(F.count("found") / F.count("*"), 6).alias("recall"))


def semantic_match(
    queries: DataFrame, stored: DataFrame, tau: float = 0.92, within: tuple[str, ...] = (), skip_same: bool = False
) -> DataFrame:
    """Best stored vector per query and whether it reaches ``tau``: (query_id, matched_key, sim, hit)."""
    best = vector_search(queries, stored, top_k=1, within=within, skip_same=skip_same)
    hit = F.coalesce(F.col("score") >= tau, F.lit(False))
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id",
        F.when(hit, F.col("id")).alias("matched_key"),
        F.col("score").alias("sim"),
        hit.alias("hit"),
    )
