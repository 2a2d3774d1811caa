"""Source divergence audit: how far the sources of a language differ in their use of terms, from one pass over the texts.

A task gathers postings of its texts in memory, (lang, term) to occurrences and documents per source. When they fill MEMORY bytes they
are written as a run sorted by term, in pages that each belong to one hash shard; the pages of a shard arrive sorted by their first
term, so that a heap over the pages that overlap merges all runs in one stream and holds one page of each at most. What leaves it is
one row of frequencies per kept term.

A source's share of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two shares diverge by f(p, q) = floor((p - q)^2 / (p + q)).
The sum of f over all V kept terms, for every two sources, starts from V f(p0, q0), as if neither had any term, and is corrected: for
the terms that one of them has (counted by how often it has them), and, streamed term by term, for those that both have:
f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). f is symmetric, so two sources are summed once. All of it is exact: decimals of 38 digits
where a product may pass 64 bits.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm import terms
from rankloom.llm.arrowtext import LETTERS, mix, raw, slices, span_hashes
from rankloom.session import cut

MIN_DOCS, TOP_TERMS = 10, 10
#: Bytes of postings that a task holds before it writes a run, hash shards for each of the session's shuffle partitions (which are
#: sized to the table), terms of a page, bytes of texts taken in at a time.
MEMORY, SHARDS, PAGE_TERMS, SLICE_BYTES = 64 << 20, 4, 512, 4 << 20
#: Sums of pairs of sources that a task holds before it sends them on, and rows sent at a time.
PAIR_SUMS, SENT = 1 << 20, 8192

PAGES = "shard int, lang string, first string, terms array<string>, sizes array<int>, sources array<int>, counts array<long>, docs array<long>, names array<string>"
FREQUENCIES = "lang string, term string, sources array<string>, counts array<long>"


class _Postings:
    """Occurrences and documents per (lang, term) and source, until they are written as a run."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.names: dict[str, int] = {}
        self.keys, self.counts, self.docs = [], [], []
        self.bytes = 0

    def add(self, langs: list[str], sources: list[str], texts: pa.Array) -> None:
        found = terms.find(texts, ~LETTERS)
        if not len(found.names):
            return
        known = len(self.names)
        own = np.array([self.names.setdefault(t, len(self.names)) for t in found.names.to_pylist()], np.int64)
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(langs, sources, strict=True)], np.int64)
        text, term, times, _ = terms.text_counts(found, len(texts))
        key, place = np.unique(group[text] << 40 | own[term], return_inverse=True)
        self._hold(key, np.bincount(place, times).astype(np.int64), np.bincount(place))
        self.bytes += found.names.nbytes * 4 * (len(self.names) - known) // len(found.names)
        if self.full():
            key, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            sums = [np.zeros(len(key), np.int64) for _ in range(2)]
            for total, part in zip(sums, (self.counts, self.docs), strict=True):
                np.add.at(total, place, np.concatenate(part))
            self.bytes -= 24 * sum(map(len, self.keys))
            self.keys, self.counts, self.docs = [], [], []
            self._hold(key, *sums)

    def _hold(self, key: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(counts)
        self.docs.append(docs)
        self.bytes += 24 * len(key)

    def full(self) -> bool:
        return self.bytes > MEMORY

    def run(self, shards: int):
        """The run's pages: per shard its terms in order."""
        if not self.keys:
            return
        key, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        sums = [np.zeros(len(key), np.int64) for _ in range(2)]
        for total, part in zip(sums, (self.counts, self.docs), strict=True):
            np.add.at(total, place, np.concatenate(part))
        groups = list(self.groups)
        langs = sorted({g[0] for g in groups})
        names = sorted(self.names)
        lang_of = np.array([langs.index(g[0]) for g in groups], np.int64)
        by_name = np.empty(len(names), np.int64)
        by_name[[self.names[t] for t in names]] = np.arange(len(names))
        group, term = key >> 40, by_name[key & (1 << 40) - 1]
        lang = lang_of[group]
        data, at = raw(pa.array(names, pa.string()))
        salt = mix(np.array([zlib.crc32(x.encode()) + 1 for x in langs], np.uint64))
        shard = ((span_hashes(data, at[:-1], at[1:])[term] ^ salt[lang]) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((group, term, lang, shard))
        shard, lang, term, group, counts, docs = (x[order] for x in (shard, lang, term, group, *sums))
        first = np.r_[True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])]  # of a (shard, lang, term)
        starts = np.r_[np.flatnonzero(first), len(term)]
        s, g = shard[starts[:-1]], lang[starts[:-1]]
        page = np.r_[np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (g[1:] != g[:-1])]), len(s)]
        for a, b in zip(page, page[1:], strict=False):
            for i in range(a, b, PAGE_TERMS):
                j = min(i + PAGE_TERMS, b)
                rows = slice(starts[i], starts[j])
                used, source = np.unique(group[rows], return_inverse=True)
                spelled = [names[t] for t in term[starts[i:j]]]
                yield (int(s[i]), langs[g[i]], spelled[0], spelled, np.diff(starts[i : j + 1]), source, counts[rows], docs[rows], [groups[u][1] for u in used])


def _runs(docs: DataFrame) -> DataFrame:
    """The pages of all runs of a table (lang, source, text) without nulls in the first two."""
    kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
    heads = [c.split()[0] for c in PAGES.split(", ")]

    shards = SHARDS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def index(batches):
        held = _Postings()

        def spilled():
            rows = []
            for row in held.run(shards):
                rows.append(row)
                if len(rows) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=heads)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=heads)

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                held.add(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text"))
                if held.full():
                    yield from spilled()
                    held = _Postings()
        yield from spilled()

    return docs.mapInArrow(index, PAGES)


def _entries(batches):
    """Pages in the order of shard, lang and first term."""
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            cuts = [0]
            for n in row["sizes"]:
                cuts.append(cuts[-1] + n)
            yield row["shard"], row["lang"], row["first"], row | {"cuts": cuts}


def merged(batches, min_docs: int):
    """One stream of (lang, term, sources, counts) from sorted pages, for terms of at least ``min_docs`` documents."""
    heap: list[tuple] = []  # (shard, lang, term, page's number, term's number, page)
    key, total, found = None, 0, {}

    def done():
        if key is not None and total >= min_docs:
            yield key[1], key[2], list(found), list(found.values())

    def before(limit):
        """Terms whose pages have all been read: those before ``limit`` (None: all)."""
        nonlocal key, total, found
        while heap and (limit is None or heap[0][:3] < limit):
            shard, lang, term, number, i, page = heap[0]
            if (shard, lang, term) != key:
                yield from done()
                key, total, found = (shard, lang, term), 0, {}
            for at in range(page["cuts"][i], page["cuts"][i + 1]):
                name = page["names"][page["sources"][at]]
                found[name] = found.get(name, 0) + page["counts"][at]
                total += page["docs"][at]
            if i + 1 < len(page["terms"]):
                heapq.heapreplace(heap, (shard, lang, page["terms"][i + 1], number, i + 1, page))
            else:
                heapq.heappop(heap)

    for number, (shard, lang, first, page) in enumerate(_entries(batches)):
        yield from before((shard, lang, first))
        heapq.heappush(heap, (shard, lang, first, number, 0, page))
    yield from before(None)
    yield from done()


def frequencies(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Written: per lang and term of at least ``min_docs`` of its documents, the sources that have it and how often each."""
    whole = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sorted_pages = _runs(whole).repartition(F.col("shard")).sortWithinPartitions("shard", "lang", "first")
    heads = [c.split()[0] for c in FREQUENCIES.split(", ")]

    def merge(batches):
        rows = []
        for row in merged(batches, min_docs):
            rows.append(row)
            if len(rows) == SENT:
                yield pa.RecordBatch.from_pylist([dict(zip(heads, r, strict=True)) for r in rows])
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(heads, r, strict=True)) for r in rows])

    return cut(sorted_pages.mapInArrow(merge, FREQUENCIES))


def _exact(x: str) -> str:
    return f"CAST({x} AS DECIMAL(20, 0))"


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)) as long; null where there are no terms at all."""
    whole = f"{_exact(n)} + 2 * {_exact(v)}"
    return F.expr(f"1 + CAST(1000000000 AS DECIMAL(10, 0)) * ({_exact(count)} + 2) div nullif({whole}, 0)")


def apart(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def both_have(rows: DataFrame) -> DataFrame:
    """a, b, value: the corrections of two sources (a before b) for the terms that both have, in partial sums.

    ``rows``: one per term, ``has`` an array of (g, p, p0) sorted by g. Neighbours at distance 1, 2, ... of all terms of a batch are
    taken at once, so that what a task holds is a batch and PAIR_SUMS sums, never the pairs.
    """

    def correct(batches):
        sums: dict[tuple[int, int], int] = {}

        def sent():
            pairs = list(sums)
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sums.values(), pa.int64())], names=["a", "b", "value"])

        for batch in batches:
            lists = batch.column("has")
            flat = lists.flatten()
            g, p, p0 = (flat.field(i).to_numpy() for i in range(3))
            term = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            for d in range(1, int(lists.value_lengths().to_numpy().max(initial=0))):
                i = np.flatnonzero(term[d:] == term[:-d])
                j = i + d
                value = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
                order = np.lexsort((g[j], g[i]))
                a, b, value = g[i][order], g[j][order], value[order]
                first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                for pair, x in zip(zip(a[first].tolist(), b[first].tolist(), strict=True), np.add.reduceat(value, first).tolist(), strict=True):
                    sums[pair] = sums.get(pair, 0) + x
                if len(sums) > PAIR_SUMS:
                    yield sent()
                    sums.clear()
        yield sent()

    return rows.select("has").mapInArrow(correct, "a long, b long, value long")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) that occurs.

    Part ``pair``: every other source of the lang, by divergence summed over all kept terms. Part ``term``: the ``top_terms`` kept
    terms that the source has, by how far its share passes the lang's. Ties go to the smaller item. Nulls in the three columns
    count as empty strings, repeated rows as documents of their own; groups without kept terms have pairs (0 where the lang keeps
    none) and no terms; an empty table gives no rows. Other columns do not matter.
    """
    own = docs.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    kept = frequencies(own, min_docs).withColumn("total", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    entries = kept.join(langs, "lang").select("lang", "term", "v", share("total", "lang_n", "v").alias("q"), F.explode(F.arrays_zip(F.col("sources"), F.col("counts").alias("counts"))).alias("e"))
    entries = cut(entries.select("lang", "term", "v", "q", F.col("e.sources").alias("source"), F.col("e.counts").alias("count")))
    seen = own.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = entries.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = seen.join(langs.select("lang", "v"), "lang", "left").join(sizes, ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))
    groups = cut(groups.select(F.monotonically_increasing_id().alias("g"), "*", F.coalesce(share("0", "n", "v"), F.lit(1).cast("long")).alias("p0")))

    # v + 0: the entry's own v is the same
    has = cut(entries.drop("v").join(groups, ["lang", "source"]).select("lang", "source", "term", "q", "g", "p0", share("count", "n", "v").alias("p")))
    other = groups.select("lang", F.col("g").alias("h"), F.col("p0").alias("q0"))
    base = groups.join(other, "lang").where("g <> h").select("g", "h", (F.col("v") * apart("p0", "q0")).alias("value"))
    often = has.groupBy("lang", "g", "p0", "p").agg(F.count("*").alias("n_terms"))
    one = often.join(other, "lang").where("g <> h").groupBy("g", "h").agg(F.sum(F.col("n_terms") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    two = both_have(has.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "p", "p0"))).alias("has"))).select(F.col("a").alias("g"), F.col("b").alias("h"), "value")
    ways = one.unionByName(two)
    ways = ways.unionByName(ways.select(F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    sums = base.unionByName(ways).groupBy("g", "h").agg(F.sum("value").alias("value"))
    names = groups.select("g", "lang", "source")
    pairs = sums.join(names, "g").join(names.select(F.col("g").alias("h"), F.col("source").alias("item")), "h").select("lang", "source", "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    above = has.where("p > q").select("lang", "source", F.col("term").alias("item"), apart("p", "q").alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("part", F.lit("pair")).unionByName(above.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
