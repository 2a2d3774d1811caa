"""Ranked lexical search, a hybrid of term-at-a-time and document-at-a-time evaluation over blocks of documents.

The index is one table of posting lists: a row per block of documents and term, holding the places of its documents in the block
and the occurrences in each; and a row per block with its documents' ids, in their order, and lengths. Searching joins the lists of
the queries' terms to the queries, so that one group is one block with the lists that one part of the queries asks for.

There each query's short lists are summed term by term into accumulators of the few documents that they name. The accumulators are
then one list among the long ones, with its own bound, and all are read document by document in runs of RUN: a run whose bounds
together cannot pass the k-th best score so far is skipped unread; in the others, lists that cannot lift a document over that score by
themselves are only probed for documents of the others, and no longer than a document can still reach it.

Scores are 64-bit integers. With N documents that hold a term, L terms in them and n in this one, m = 100 - 90 + (90 n N) div L; a
term in df documents has the weight w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score is the sum of
w * ((1000000000 tf) div (1000 tf + 8 m)) over the query's distinct terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm import terms
from rankloom.llm.arrowtext import slices
from rankloom.session import cut

K = 10
#: Bytes of text and documents of one block, bytes of one slice of it, and rows of the index sent at a time.
BLOCK_BYTES, BLOCK_DOCS, SLICE_BYTES, SENT = 32 << 20, 1 << 16, 4 << 20, 16384
#: Terms of queries that meet a block in one group (a longer query stands alone).
PART_TERMS = 20_000
#: Documents of one run, and the share of a block's documents up to which a list is short.
RUN, SHORT = 2048, 1 / 32

OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[65:91] = OUTSIDE[97:123] = OUTSIDE[128:] = False

INDEX = "block long, term string, df long, places binary, times binary, ids array<long>, lengths array<long>"


def _binary(values: np.ndarray, kind: str, starts: np.ndarray) -> pa.BinaryArray:
    made = values.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * made.itemsize).astype(np.int32).tobytes()), pa.py_buffer(made.tobytes())])


class _Block:
    """Documents gathered until one block is full."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.lengths, self.parts, self.bytes = [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        found = terms.find(texts, OUTSIDE)
        own = np.array([self.names.setdefault(t, len(self.names)) for t in found.names.to_pylist()], np.int64)
        text, term, times, lengths = terms.text_counts(found, len(texts))
        self.parts.append((own[term] if len(own) else term, text + len(self.ids), times))
        self.ids.extend(ids.to_pylist())
        self.lengths.append(lengths)
        self.bytes += texts.nbytes

    def rows(self, block: int):
        """The block's own row, then its lists by term."""
        order = np.array(sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0)), np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.concatenate(self.lengths)[order]
        yield [[block], [None], [None], [None], [None], [[self.ids[i] for i in order]], [lengths.tolist()]]
        names = sorted(self.names)
        by_name = np.empty(len(names), np.int64)
        by_name[[self.names[t] for t in names]] = np.arange(len(names))
        term, doc, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        term, doc = by_name[term] if len(names) else term, place[doc]
        sort = np.lexsort((doc, term))
        df = np.bincount(term, minlength=len(names))
        starts = np.r_[0, np.cumsum(df)]
        doc, times = doc[sort], times[sort]
        for i in range(0, len(names), SENT):
            some = starts[i : i + SENT + 1]
            lists = slice(some[0], some[-1])
            n = len(some) - 1
            yield [[block] * n, names[i : i + n], df[i : i + n], _binary(doc[lists], "<u2", some - some[0]), _binary(times[lists], "<u4", some - some[0]), [None] * n, [None] * n]


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The written index of every document, whole texts. A null text has no terms, a null id comes last among ties, repeated rows are documents of their own."""
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # a partition's blocks are numbered from its own number on
    numbered = whole.withColumn("part", F.spark_partition_id())
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    heads = [c.split()[0] for c in INDEX.split(", ")]

    def build(batches):
        block, number = _Block(), 0

        def done(part):
            for row in block.rows((part << 32) + number):
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=heads)

        part = 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                part = piece.column("part")[0].as_py()
                for at in range(0, len(piece), BLOCK_DOCS):
                    some = piece.slice(at, BLOCK_DOCS)
                    if block.ids and (block.bytes + some.column("text").nbytes > BLOCK_BYTES or len(block.ids) + len(some) > BLOCK_DOCS):
                        yield from done(part)
                        block, number = _Block(), number + 1
                    block.add(some.column("id"), some.column("text"))
        if block.ids:
            yield from done(part)

    return cut(numbered.mapInArrow(build, INDEX))


@dataclass
class _List:
    """Places in ascending order, their scores, and per run of documents where it begins and the best score in it."""

    places: np.ndarray
    scores: np.ndarray
    starts: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, places: np.ndarray, scores: np.ndarray, n_docs: int) -> _List:
        starts = np.searchsorted(places, np.arange(0, n_docs + RUN, RUN))
        most = np.zeros(len(starts) - 1, np.int64)
        full = starts[1:] > starts[:-1]
        if full.any():
            most[full] = np.maximum.reduceat(scores, starts[:-1][full])
        return cls(places, scores, starts, most)


def accumulated(lists: list[_List], n_docs: int) -> _List:
    """Short lists, taken term by term, as one list of their documents' sums."""
    places = np.concatenate([x.places for x in lists])
    named, own = np.unique(places, return_inverse=True)
    sums = np.zeros(len(named), np.int64)
    np.add.at(sums, own, np.concatenate([x.scores for x in lists]))
    return _List.of(named, sums, n_docs)


def best_of_block(lists: list[_List], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best documents with a score above 0, best first, ties to the smaller place."""
    short = [x for x in lists if len(x.places) <= n_docs * SHORT]
    rows = [x for x in lists if len(x.places) > n_docs * SHORT]
    if short:
        rows.append(accumulated(short, n_docs))
    held, kept, edge = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # places, scores, and what a score must pass
    if not rows:
        return held, kept
    bounds = np.stack([x.most for x in rows])
    for run in np.flatnonzero(bounds.sum(axis=0) > 0):
        here = bounds[:, run]
        if here.sum() <= edge:
            continue
        order = np.argsort(-here, kind="stable")
        rest = here[order][::-1].cumsum()[::-1]  # what this list and all after it can add
        sums, low = np.zeros(RUN, np.int64), run * RUN
        at = None
        for i, left in zip(order, rest, strict=True):
            x = rows[i]
            if not here[i]:
                break
            span = slice(x.starts[run], x.starts[run + 1])
            if at is None and left > edge:  # a document of this list may pass without the lists before it
                sums[x.places[span] - low] += x.scores[span]
                continue
            if at is None:
                at = np.flatnonzero(sums)
            at = at[sums[at] + left > edge]
            if not len(at):
                break
            places = x.places[span]
            hit = np.searchsorted(places, at + low)
            found = hit < len(places)
            found[found] = places[hit[found]] == at[found] + low
            sums[at[found]] += x.scores[span][hit[found]]
        at = np.flatnonzero(sums) if at is None else at
        at = at[sums[at] > edge]
        if len(at):
            held, kept = np.r_[held, at + low], np.r_[kept, sums[at]]
            best = np.lexsort((held, -kept))[:k]
            held, kept = held[best], kept[best]
            edge = kept[-1] if len(kept) == k else 0
    return held, kept


def _query_terms(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """Written: row (of the query), item_id, term; each term once."""
    whole = queries.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))

    def split(batches):
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                found = terms.find(piece.column("text"), OUTSIDE)
                query, term, _, _ = terms.text_counts(found, len(piece))
                yield pa.RecordBatch.from_arrays([piece.column("row").take(pa.array(query)), piece.column("item_id").take(pa.array(query)), found.names.take(pa.array(term))], names=["row", "item_id", "term"])

    return cut(whole.mapInArrow(split, "row long, item_id long, term string"))


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each query's k best documents with a score above 0 (all, if fewer), ties to the smaller doc_id.

    Query rows are told apart by themselves: a repeated row finds its documents again. A null text, or one without a known term, finds
    nothing; so does an empty index. Columns other than ``id_col`` and ``text`` do not matter, whatever their names.
    """
    asked = _query_terms(queries, id_col, text)
    lists = index.where(F.col("term").isNotNull()).select("block", "term", "df", "places", "times")
    heads = index.where(F.col("term").isNull()).select("block", "ids", "lengths")
    size = heads.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms")).first()
    n_docs, n_terms = size.n_docs, size.n_terms or 1
    parts = max(1, -(-asked.count() // PART_TERMS))
    known = asked.select("term").distinct()
    df = lists.join(known, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = df.withColumn("weight", weight).where("weight > 0").select("term", "weight")
    shared = asked.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).groupBy("part", "term").agg(F.collect_list("row").alias("rows"))
    wanted = cut(shared.join(weights, "term"))  # its written size decides how it meets the index
    empty = lambda kind: F.lit(None).cast(kind)
    asked_lists = lists.join(wanted, "term").select("block", "part", "weight", "rows", "places", "times", empty("array<long>").alias("ids"), empty("array<long>").alias("lengths"))
    every = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked_heads = every.select("block", "part", empty("long").alias("weight"), empty("array<long>").alias("rows"), empty("binary").alias("places"), empty("binary").alias("times"), "ids", "lengths")

    def best(table: pa.Table) -> pa.Table:
        rows, weight, places, times = ([x for x in table.column(c).to_pylist()] for c in ("rows", "weight", "places", "times"))
        head = weight.index(None)
        ids, n = table.column("ids")[head].as_py(), np.array(table.column("lengths")[head].as_py(), np.int64)
        m = 100 - 90 + 90 * n * n_docs // n_terms
        asked_by: dict[int, list[_List]] = {}
        for r, w, p, t in zip(rows, weight, places, times, strict=True):
            if w is None:
                continue
            at, tf = np.frombuffer(p, "<u2").astype(np.int64), np.frombuffer(t, "<u4").astype(np.int64)
            own = _List.of(at, w * (1_000_000_000 * tf // (1000 * tf + 8 * m[at])), len(n))
            for q in r:
                asked_by.setdefault(q, []).append(own)
        out = [(q, ids[p], s) for q, mine in asked_by.items() for p, s in zip(*best_of_block(mine, len(n), k), strict=True)]
        row, doc, score = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"row": pa.array(row, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "score": pa.array(score, pa.int64())})

    per_block = asked_lists.unionByName(asked_heads).groupBy("block", "part").applyInArrow(best, "row long, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    merged = per_block.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.join(asked.select("row", "item_id").distinct(), "row").select("item_id", "rank", "doc_id", "score")
