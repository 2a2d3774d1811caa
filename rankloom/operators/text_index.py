"""A corpus as posting lists in blocks of documents, written once, and its search with blocks that cannot win left unread.

One pass over the texts makes a row per block, a file of its own: the ids in their order, and per field the lengths and every token's
list: the places of its documents in the block, how often each has it, and two bounds, its most occurrences and its shortest text. No
exchange carries a text or a list, and an index serves any number of searches.

A search packs the queries with the weights of their tokens into rows of many queries. A task holds one of these and reads blocks past
it; it keeps each query's best documents so far, and in a block scores only queries whose bounds there reach their k-th score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from rankloom.functions.text import NOT_WORD
from rankloom.operators.ordered import best_rows
from rankloom.session import cut, cut_packed, discard, meet_packed

# Fixed values of the published BM25 formula.
K1 = 1.2
B = 0.75

#: Documents and bytes of text of one block, bytes taken in at a time, and rows sent and postings sorted at a time.
BLOCK_DOCS, BLOCK_BYTES, SLICE_BYTES, SENT, SORTED = 1 << 14, 32 << 20, 2 << 20, 16384, 1 << 18
#: Tokens and results of queries that meet a block at a time (a longer query stands alone).
PART_TOKENS, PART_HITS = 400_000, 1 << 23
#: A list with more than this part of a block's documents is summed as a whole column. Groups are tasks of their own up to a number.
DENSE, MOST_TASKS = 8, 4096
#: Blocks beyond which those that cannot win are left unscored.
FEW_BLOCKS = 1
#: Work of a task, in lists of a query's token in a block: that of reading one block, the least worth a task, and the most.
READ_LISTS, LEAST_LISTS, MOST_LISTS = 4000, 100_000, 10_000_000


def split_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased tokens, and per occurrence its token's and its text's number. A null text has none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), NOT_WORD)
    flat = lists.flatten()
    some = pc.not_equal(flat, "")
    text = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[some.to_numpy(zero_copy_only=False)]
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64), text


def token_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, and text, token and occurrences of every pair of the two that occurs."""
    names, token, text = split_tokens(texts)
    width = max(len(names), 1)
    pairs, times = np.unique(text * width + token, return_counts=True)
    return names, pairs // width, pairs % width, times


def _binary(values: np.ndarray, kind: str, starts: np.ndarray) -> pa.Array:
    made = values.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * made.itemsize).astype(np.int32).tobytes()), pa.py_buffer(made.tobytes())])


def _merged(names: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """All distinct names in their order, and for each array the places of its names in there."""
    coded = pa.chunked_array(names, pa.string()).dictionary_encode().chunks
    known = coded[-1].dictionary if coded else pa.array([], pa.string())
    order = pc.sort_indices(known).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return known.take(pa.array(order)), [place[x.indices.to_numpy()] for x in coded]


@dataclass
class TextIndex:
    """``lists``, the written index; its fields and number of blocks; per field, documents with a token and their mean length."""

    lists: DataFrame
    fields: tuple[str, ...]
    blocks: int
    sizes: dict[int, tuple[int, float]]


class _Block:
    """Documents gathered until one block is full."""

    def __init__(self, fields: int):
        self.names: list[pa.Array] = []
        self.ids, self.bytes = [], 0
        # a slice's number among the names, its tokens as places in them, documents and occurrences, in as few bytes as they need
        self.parts: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(fields)]

    def add(self, ids: pa.Array, texts: list[pa.Array]) -> None:
        for held, column in zip(self.parts, texts, strict=True):
            names, text, token, times = token_counts(column)
            self.bytes += column.nbytes
            if len(names):
                order = np.argsort(token, kind="stable")
                few = np.min_scalar_type(int(times.max()))
                held.append((len(self.names), token[order].astype("<i4"), (text[order] + len(self.ids)).astype("<u2"), times[order].astype(few)))
                self.names.append(names)
        self.ids.extend(ids.to_pylist())

    def rows(self, block: int):
        """Per field its own row, then its lists by token."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        place = np.empty(len(order), np.uint16)
        place[order] = np.arange(len(order))
        names, by_name = _merged(self.names)
        self.names.clear()
        for field, parts in enumerate(self.parts):
            lengths, ends = np.zeros(len(order), np.int64), np.zeros(len(names), np.int64)
            # slice by slice, for counting widens its input; a slice is put into the order of the block's names where it lies
            for at, token, doc, times in parts:
                doc[:] = place[doc]
                lengths += np.bincount(doc, times, minlength=len(order)).astype(np.int64)
                token[:] = by_name[at][token]
                sort = np.argsort(token, kind="stable")
                for values in (token, doc, times):
                    values[:] = values[sort]
                ends += np.bincount(token, minlength=len(names))
            ends = np.cumsum(ends)
            yield {
                "block": [block], "field": [field], "n": [int((lengths > 0).sum())], "total": [int(lengths.sum())],
                "ids": [[self.ids[i] for i in order]], "lengths": [lengths.astype("<i8").tobytes()],
            }
            low = 0
            while low < len(names):
                high = max(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SORTED, "right")), low + 1)
                some = [slice(*np.searchsorted(token, [low, high])) for _, token, _, _ in parts]
                low = high
                if any(x.stop > x.start for x in some):
                    token, doc, times = (np.concatenate([part[i][x] for part, x in zip(parts, some, strict=True)]) for i in (1, 2, 3))
                    yield from self._lists(block, field, names, lengths, token, doc, times)
            parts.clear()

    @staticmethod
    def _lists(block: int, field: int, names: pa.Array, lengths: np.ndarray, token: np.ndarray, doc: np.ndarray, times: np.ndarray):
        """The lists of some tokens, with all their postings in the block."""
        sort = np.lexsort((doc, token))
        token, doc, times = token[sort], doc[sort], times[sort]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        most, least = np.maximum.reduceat(times, first), np.minimum.reduceat(lengths[doc], first)
        starts = np.r_[first, len(token)]
        for i in range(0, len(first), SENT):
            some = starts[i : i + SENT + 1]
            lists = slice(some[0], some[-1])
            n = len(some) - 1
            yield {
                "block": [block] * n, "field": [field] * n, "token": names.take(pa.array(token[some[:-1]])).to_pylist(), "df": np.diff(some),
                "most": most[i : i + n], "least": least[i : i + n],
                "places": _binary(doc[lists], "<u2", some - some[0]), "times": _binary(times[lists], "<u4", some - some[0]),
            }


def _block_row(block: _Block, number: int, fields: int, schema: pa.Schema) -> pa.RecordBatch:
    """The whole block as one row."""
    heads, lists = [None] * fields, [[] for _ in range(fields)]
    for row in block.rows(number):
        f = row["field"][0]
        if "df" in row:
            lists[f].append((pa.array(row["token"], pa.string()), *(np.asarray(row[c]).astype("<u4") for c in ("df", "most", "least")), *(np.frombuffer(row[c].buffers()[2], kind) for c, kind in (("places", "<u2"), ("times", "<u4")))))
        else:
            heads[f] = row

    def every(i: int, kind: str) -> list[bytes]:
        return [np.concatenate([x[i] for x in held]).astype(kind).tobytes() if held else b"" for held in lists]

    def nested(i: int, kind: pa.DataType) -> pa.Array:
        flat = pa.chunked_array([pa.array(x[i], kind) for held in lists for x in held], kind).combine_chunks()
        ends = np.cumsum([0, *(sum(len(x[i]) for x in held) for held in lists)])
        return pa.ListArray.from_arrays(pa.array([0, fields], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))

    row = {
        "block": number, "ids": heads[0]["ids"][0], "n": [h["n"][0] for h in heads], "total": [h["total"][0] for h in heads], "lengths": [h["lengths"][0] for h in heads],
        "token": nested(0, pa.string()), "df": nested(1, pa.int32()), "most": every(2, "<u4"), "least": every(3, "<u4"), "places": every(4, "<u2"), "times": every(5, "<u4"),
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x := row[f.name], pa.Array) else pa.array([x], f.type) for f in schema], schema=schema)


def build_text_index(docs: DataFrame, fields: tuple[str, ...] = ("content", "title"), id_col: str = "id") -> TextIndex:
    """The index of every document's whole fields; a null field has no tokens, repeated rows are documents of their own."""
    if BLOCK_DOCS > 1 << 16:
        raise ValueError("places of a block have 16 bits")
    shape = T.StructType.fromDDL("block long, n array<long>, total array<long>, lengths array<binary>, token array<array<string>>, df array<array<int>>, most array<binary>, least array<binary>, places array<binary>, times array<binary>")
    shape = shape.add("ids", T.ArrayType(docs.schema[id_col].dataType))
    schema = to_arrow_schema(shape)
    names = [f"f{i}" for i in range(len(fields))]
    whole = docs.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(n) for f, n in zip(fields, names, strict=True)], F.spark_partition_id().alias("part"))

    def build(batches):
        block, number, part = _Block(len(names)), 0, 0

        def done():
            yield _block_row(block, (part << 32) + number, len(names), schema)
            pa.default_memory_pool().release_unused()

        for batch in batches:
            sizes = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy().astype(np.int64) for n in names))
            at = 0
            while at < len(batch):
                part = batch.column("part")[0].as_py()
                room = SLICE_BYTES + (sizes[at - 1] if at else 0)
                end = min(max(int(np.searchsorted(sizes, room, "right")), at + 1), at + BLOCK_DOCS)
                some = batch.slice(at, end - at)
                at = end
                if block.ids and (len(block.ids) + len(some) > BLOCK_DOCS or block.bytes > BLOCK_BYTES):
                    yield from done()
                    block, number = _Block(len(names)), number + 1
                block.add(some.column("id"), [some.column(n) for n in names])
        if block.ids:
            yield from done()

    lists = cut_packed(whole.mapInArrow(build, shape))
    each = lists.select(F.posexplode(F.arrays_zip("n", "total")).alias("field", "x"))
    found = each.groupBy("field").agg(F.sum("x.n").alias("n"), F.sum("x.total").alias("total"), F.count("*").alias("blocks")).collect()
    return TextIndex(lists, tuple(fields), max((r.blocks for r in found), default=0), {r.field: (r.n, r.total / r.n) for r in found if r.n})


def query_tokens(queries: DataFrame, k: Column) -> DataFrame:
    """Written: query_id, k, token, qtf of every query."""
    kind = queries.schema["query_id"].dataType
    shape = T.StructType([T.StructField("query_id", kind), T.StructField("k", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("qtf", T.LongType())])

    def split(batches):
        for batch in batches:
            names, text, token, times = token_counts(batch.column("query"))
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("k").take(at), names.take(pa.array(token)), pa.array(times)], names=shape.names)

    rows = queries.select("query_id", k.cast("int").alias("k"), F.col("query").cast("string").alias("query")).mapInArrow(split, shape)
    return cut(rows.groupBy("query_id", "token").agg(F.max("k").alias("k"), F.sum("qtf").alias("qtf")))


def _scorer(sizes: dict[int, tuple[int, float]], fields: int, kinds: tuple[pa.DataType, pa.DataType]):
    """Group function: each query's k best documents of one block, by its best field, with ties to the smaller id."""

    def best(table: pa.Table) -> pa.Table:
        head = pc.is_null(table.column("weight"))
        # postings are read where they lie: a filter would copy them
        heads, lists = table.filter(head), table.select(["field", "weight", "asks"]).filter(pc.invert(head))
        postings = ((p, t) for p, t in zip(table.column("places"), table.column("times"), strict=True) if p.is_valid)
        lengths = {f: np.frombuffer(n, "<i8") for f, n in zip(heads.column("field").to_pylist(), heads.column("lengths").to_pylist(), strict=True)}
        ids = heads.column("ids")[heads.column("field").to_pylist().index(0)].values
        size = len(ids)
        field, weight = lists.column("field").to_pylist(), lists.column("weight").to_pylist()
        # a list that covers much of the block is kept as a whole column, others as places and scores
        made, positive, sums, room = [], all(w > 0 for w in weight), np.zeros((fields, size)), np.empty(size)
        for f, w, (places, times) in zip(field, weight, postings, strict=True):
            at, tf = np.frombuffer(places.as_buffer(), "<u2"), np.frombuffer(times.as_buffer(), "<u4").astype(float)
            scores = w * tf / (tf + K1 * (1 - B + B * lengths[f][at] / sizes[f][1]))
            if positive and DENSE * len(at) > size:
                whole = np.zeros(size)
                whole[at] = scores
                at, scores = None, whole
            else:
                at = at.astype(np.intp)
            made.append((sums[f], at, scores))
        asks = lists.column("asks").combine_chunks()
        flat = asks.flatten()
        row = np.repeat(np.arange(len(lists)), asks.value_lengths().to_numpy())
        coded = flat.field("query_id").dictionary_encode("encode")
        code, ks, qtf = coded.indices.to_numpy(), flat.field("k").to_numpy(), flat.field("qtf").to_numpy()
        order = np.argsort(code, kind="stable")
        code, row, ks, qtf = code[order], row[order], ks[order], qtf[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        queries, counts, docs, values = [], [], [], []
        for start, end in zip(starts.tolist(), np.r_[starts, len(code)][1:].tolist(), strict=True):
            sums[:] = 0
            mine, k = row[start:end].tolist(), int(ks[start])
            for r, n in zip(mine, qtf[start:end].tolist(), strict=True):
                own, at, scores = made[r]
                if at is not None:
                    own[at] += scores if n == 1 else n * scores
                else:
                    np.add(own, scores if n == 1 else np.multiply(scores, n, out=room), out=own)
            score = sums.max(axis=0) if fields > 1 else sums[0]
            if positive:
                at = _promising(score, k)
            else:
                seen = np.zeros(size, bool)
                for r in mine:
                    seen[made[r][1]] = True
                at = np.flatnonzero(seen)
            found = np.round(score[at], 6)
            if len(at) > k:
                edge = np.partition(found, len(at) - k)[len(at) - k]
                at, found = at[found >= edge], found[found >= edge]
            first = np.lexsort((at, -found))[:k]
            queries.append(start)
            counts.append(len(first))
            docs.append(at[first])
            values.append(found[first])
        asked = np.repeat(np.array(queries, np.int64), np.array(counts, np.int64))
        at, score = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((docs, np.int64), (values, float)))
        return pa.table({
            "query_id": coded.dictionary.take(pa.array(code[asked])).cast(kinds[0]), "k": pa.array(ks[asked], pa.int32()),
            "id": ids.take(pa.array(at)).cast(kinds[1]), "score": pa.array(score, pa.float64()),
        })

    return best


def _promising(score: np.ndarray, k: int) -> np.ndarray:
    """Places of all scores above 0 that may be among the k best when rounded to six places."""
    groups = 8 * k
    if len(score) < 2 * groups:
        return np.flatnonzero(score > 0)
    # the k-th best of the maxima of groups: at least k documents reach it
    tops = score[: len(score) // groups * groups].reshape(groups, -1).max(axis=1)
    edge = np.partition(tops, groups - k)[groups - k] - 2e-6
    return np.flatnonzero(score >= edge) if edge > 0 else np.flatnonzero(score > 0)


def _pack_queries(dealt: DataFrame, parts: int, fields: int) -> DataFrame:
    """Written: of (query_id, k, token, qtf, w0, w1, ..) one row for each of ``parts`` parts of the queries, with the askers of every token and its weights."""
    shape = T.StructType.fromDDL("part int, k binary, token array<string>, weights binary, ends binary, asker binary, qtf binary")
    shape = shape.add("queries", T.ArrayType(dealt.schema["query_id"].dataType))
    schema = to_arrow_schema(shape)

    def pack(table: pa.Table) -> pa.Table:
        asked, told = (table.column(c).combine_chunks().dictionary_encode("encode") for c in ("query_id", "token"))
        asker, token = asked.indices.to_numpy(), told.indices.to_numpy()
        order = np.argsort(token, kind="stable")
        first = np.unique(token, return_index=True)[1]
        k = np.zeros(len(asked.dictionary), "<i4")
        k[asker] = table.column("k").to_numpy()
        weights = [table.column(f"w{f}").take(pa.array(first)).to_numpy() for f in range(fields)]
        row = {
            "part": table.column("part")[0].as_py(), "k": k.tobytes(), "token": pa.ListArray.from_arrays([0, len(told.dictionary)], told.dictionary),
            "weights": np.array(weights, "<f8").tobytes(), "ends": np.cumsum(np.bincount(token)).astype("<i8").tobytes(), "asker": asker[order].astype("<i4").tobytes(),
            "qtf": table.column("qtf").to_numpy()[order].astype("<i8").tobytes(), "queries": pa.ListArray.from_arrays([0, len(asked.dictionary)], asked.dictionary),
        }
        return pa.Table.from_arrays([x if isinstance(x := row[f.name], pa.Array) else pa.array([x], f.type) for f in schema], schema=schema)

    # a group holds few bytes for its work, so partitions are not merged by their size
    packs = dealt.repartition(min(parts, MOST_TASKS), "part").groupBy("part").applyInArrow(pack, shape)
    return cut_packed(packs.toDF(*[f"q_{f.name}" for f in shape]))


class _Asked:
    """Queries of one part, with each one's best documents in the blocks so far."""

    def __init__(self, row: dict, fields: int):
        held = {c: np.frombuffer(row[f"q_{c}"].as_buffer(), kind) for c, kind in (("k", "<i4"), ("weights", "<f8"), ("ends", "<i8"), ("asker", "<i4"), ("qtf", "<i8"))}
        self.tokens, self.queries = row["q_token"].values, row["q_queries"].values
        self.k, self.asker, self.qtf, self.starts = held["k"], held["asker"], held["qtf"], np.r_[0, held["ends"]]
        self.weights = held["weights"].reshape(fields, -1)
        self.floor, self.found = np.full(len(self.k), -np.inf), None

    def meet(self, row: dict, sizes: dict[int, tuple[int, float]], best, choose: bool) -> None:
        """Score a block. Only lists of tokens that are asked for, by queries that may have a better document there, are looked at."""
        met, bound, some = [], np.full(len(self.k), -np.inf), np.zeros(len(self.k), bool)
        counts = np.diff(self.starts)
        for f in sizes:
            names = row["token"].values[f].values
            place = pc.index_in(self.tokens, value_set=names)
            token = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False) & ~np.isnan(self.weights[f]))
            place = place.take(pa.array(token)).to_numpy().astype(np.int64)
            most, least = (np.frombuffer(row[c].values[f].as_buffer(), "<u4")[place].astype(float) for c in ("most", "least"))
            limit = np.zeros(len(self.tokens))
            limit[token] = np.maximum(self.weights[f][token], 0) * most / (most + K1 * (1 - B + B * least / sizes[f][1]))
            here = np.zeros(len(self.tokens), bool)
            here[token] = True
            asked = np.repeat(here, counts)
            some[self.asker[asked]] = True
            if choose:
                bound = np.maximum(bound, np.bincount(self.asker, np.repeat(limit, counts) * self.qtf, minlength=len(self.k)))
            met.append((f, token, place))
        if choose:
            some &= bound + 1e-6 >= self.floor
        if not some.any():
            return
        chosen = some[self.asker]
        before = np.r_[0, np.cumsum(chosen)]
        field, weight, places, times, flat, lengths = [], [], [], [], [], []
        for f, token, place in met:
            n = before[self.starts[token + 1]] - before[self.starts[token]]
            token, place = token[n > 0], place[n > 0]
            starts = np.r_[0, np.cumsum(row["df"].values[f].values.to_numpy(), dtype=np.int64)]
            lists = pa.array(place)
            for held, c, width in ((places, "places", 2), (times, "times", 4)):
                ends = pa.py_buffer((starts * width).astype(np.int32).tobytes())
                held.append(pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, ends, row[c].values[f].as_buffer()]).take(lists))
            field.append(np.full(len(token), f))
            weight.append(self.weights[f][token])
            asks = np.flatnonzero(chosen & np.repeat(np.isin(np.arange(len(self.tokens)), token), counts))
            flat.append(asks)
            lengths.append(n[n > 0])
        heads, flat = list(range(len(self.weights))), np.concatenate(flat)
        empty = [None] * len(heads)
        asks = pa.StructArray.from_arrays([pa.array(self.asker[flat]), pa.array(self.k[self.asker[flat]]), pa.array(self.qtf[flat])], names=["query_id", "k", "qtf"])
        ends = np.r_[np.zeros(len(heads), np.int64), np.cumsum(np.r_[0, np.concatenate(lengths)])]
        ids = row["ids"].values
        own = pa.array([0 if i == 0 else None for i in range(len(heads))], pa.int32())
        rest = len(ends) - 1 - len(heads)
        table = pa.table({
            "field": np.concatenate([heads, *field]).astype(np.int32), "weight": pa.array([*empty, *np.concatenate(weight)], pa.float64()), "asks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), asks),
            "places": pa.concat_arrays([pa.array(empty, pa.binary()), *places]), "times": pa.concat_arrays([pa.array(empty, pa.binary()), *times]),
            "ids": pa.ListArray.from_arrays([0, len(ids)], ids).take(pa.concat_arrays([own, pa.nulls(rest, pa.int32())])),
            "lengths": pa.array([*(row["lengths"].values[f].as_py() for f in heads), *[None] * rest], pa.binary()),
        })
        found = best(table)
        self.found = best_rows(found if self.found is None else pa.concat_tables([self.found, found]))
        code = self.found.column("query_id").to_numpy()
        ends = np.flatnonzero(np.r_[code[1:] != code[:-1], True]) if len(code) else np.zeros(0, np.int64)
        full = ends[np.diff(np.r_[-1, ends]) == self.k[code[ends]]]
        self.floor[code[full]] = self.found.column("score").to_numpy()[full]


def search_index(tokens: DataFrame, index: TextIndex, stats: DataFrame | None = None) -> DataFrame:
    """query_id, k, id, score: of every part of the blocks, at most k documents of each query in ``query_tokens``.

    ``stats`` (field, token, df, n, avg_length) takes the place of the index's own counts.
    """
    known = tokens.select("token").distinct()
    number = {f: i for i, f in enumerate(index.fields)}
    if stats is None:
        sizes = index.sizes
        every = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.arrays_zip(F.col("token")[i].alias("token"), F.col("df")[i].alias("df")).alias("lists")) for i in number.values()])).alias("x")
        lists = index.lists.select(every).select("x.field", F.explode("x.lists").alias("y")).select("field", "y.token", "y.df")
        df = lists.join(known, "token", "left_semi").groupBy("field", "token").agg(F.sum("df").alias("df"))
        n = _by_field({f: x for f, (x, _) in sizes.items()})
    else:
        own = stats.where(F.col("field").isin(list(number)))
        rows = own.groupBy("field").agg(F.max("n").alias("n"), F.max("avg_length").alias("avg")).collect()  # one row per field
        sizes = {number[r.field]: (r.n, r.avg) for r in rows}
        df = own.join(known, "token", "left_semi").select(_by_field(number).alias("field"), "token", "df", "n")
        n = F.col("n")
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * (K1 + 1)
    weights = df.groupBy("token").agg(*[F.max(F.when(F.col("field") == i, weight)).alias(f"w{i}") for i in number.values()])
    asked = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("hits")).first()
    parts = max(1, -(-asked.n // PART_TOKENS), -(-asked.hits // PART_HITS))
    dealt = tokens.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).join(weights, "token")
    fields, choose = len(index.fields), index.blocks > FEW_BLOCKS

    kinds = [index.lists.schema["ids"].dataType.elementType, tokens.schema["query_id"].dataType]
    shape = T.StructType([T.StructField("query_id", kinds[1]), T.StructField("k", T.IntegerType()), T.StructField("id", kinds[0]), T.StructField("score", T.DoubleType())])
    best = _scorer(sizes, fields, (pa.int32(), to_arrow_type(kinds[0])))

    def score(batches):
        held: dict[int, _Asked] = {}
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                part = row["q_part"].as_py()
                if part not in held:
                    held[part] = _Asked(row, fields)
                held[part].meet(row, sizes, best, choose)
        for x in held.values():
            if x.found is not None:
                yield from x.found.set_column(0, "query_id", x.queries.take(x.found.column("query_id").combine_chunks())).to_batches()

    work = index.blocks * (asked.n / parts + READ_LISTS)
    cores = index.lists.sparkSession.sparkContext.defaultParallelism
    streams = min(index.blocks, -(-work // LEAST_LISTS), max(-(-3 * cores // parts), -(-work // MOST_LISTS)))
    packs = _pack_queries(dealt, parts, fields)
    found = meet_packed(index.lists, packs, F.lit(True), max(1, int(streams)), score, shape)
    discard(packs)
    return found


def _by_field(values: dict) -> Column:
    """A value for each field's number (or name)."""
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(F.col("field") == F.lit(k), F.lit(v)).otherwise(out)
    return out
