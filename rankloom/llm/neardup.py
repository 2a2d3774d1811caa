"""Near-duplicate classes of whole texts by DartMinHash signatures, banded joining and an exact check of each candidate.

Every element of a text (a shingle of five words) owns the region [0, count) x [0, oo) of weights and times. Hashed darts fall
on it at unit rate, the same for every text, and each names a coordinate. A text sees the darts under its count and up to a
time at which every coordinate has been hit; the earliest dart of a coordinate is its signature entry. Two texts agree in an
entry with the probability of their weighted Jaccard similarity, and the darts looked at depend on the signature's length.

Copies share one node from the start. Nodes that agree in a band meet at the bucket's first node, its hub, not in pairs: a node and a
hub make one edge, however many bands they share, and each node is compared first with the hub that it shares most bands with,
then with those hubs that are still of another class. Members of buckets that still hold several classes then meet by their rarest
elements, of which two similar sets must share one early enough, so no link of a bucket is lost to the number of its members.
What travels by band is a key and a node; four bits of every signature entry join an edge once, and turn away what cannot be similar.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rankloom.llm.arrowtext import SPACES, extend, mix, raw, run_digests, span_hashes, words
from rankloom.session import cut, discard, small

SHINGLE, SIMILARITY = 5, 0.8
#: At a similarity of 0.8 a pair shares none of 24 bands of 5 rows with a chance of 0.00007.
BANDS, ROWS = 24, 5
#: The chance with which four bits of every entry turn away a pair of just enough similarity.
ASTRAY = 1e-6
#: Bytes of texts that a task hashes at a time: what it holds beside them is some fifty times as much.
SLICE = 1 << 19
#: Earlier elements that a place of a prefix carries, so that a pair of sets is made once.
BEFORE = 32
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and their text numbers, in text order, and two digests of each text's words.

    A text of fewer words than ``width`` has one shingle of all of them; one without words has none.
    """
    data, at = raw(texts)
    begin, end, owner = words(data, at, SPACES)
    h = span_hashes(data, begin, end)
    n = np.bincount(owner, minlength=len(texts))
    starts = np.r_[0, np.cumsum(n)]
    first, second = run_digests(h, starts, 1), run_digests(h, starts, 2)
    ends = np.repeat(starts[1:], n)
    at_word = np.flatnonzero(np.arange(len(h)) + width <= ends)
    with np.errstate(over="ignore"):
        total = np.zeros(len(at_word), np.uint64)
        for k in range(width):
            total = mix(total * _TURN + h[at_word + k])
    short = np.flatnonzero((n > 0) & (n < width))
    values, docs = np.r_[total, first[short]], np.r_[owner[at_word], short]
    order = np.argsort(docs, kind="stable")
    return values[order], docs[order], first, second


def counted(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs with their counts."""
    order = np.lexsort((values, docs))
    v, d = values[order], docs[order]
    new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (d[1:] != d[:-1])]) if len(v) else np.zeros(0, np.int64)
    return v[new], d[new], np.diff(np.r_[new, len(v)])


def darts(values: np.ndarray, docs: np.ndarray, counts: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """The signatures of ``n_docs`` weighted sets, k entries each; sets without elements keep zeros."""
    out = np.zeros((n_docs, k), np.uint64)
    weight = np.bincount(docs, counts, n_docs)
    todo, reach = weight > 0, np.full(n_docs, k * (math.log(k) + 2.0))
    while todo.any():
        mine = todo[docs]
        v, d, c = values[mine], docs[mine], counts[mine]
        limit = reach / np.maximum(weight, 1)
        # cells of weight [0, 1), [1, 2), [2, 4), ... up to the count
        levels = np.where(c > 1, np.ceil(np.log2(np.maximum(c, 1))).astype(np.int64), 0) + 1
        level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
        v, d, c = np.repeat(v, levels), np.repeat(d, levels), np.repeat(c, levels)
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        width = np.maximum(low, 1.0)
        with np.errstate(over="ignore"):
            seed = mix(v + mix((level.astype(np.uint64) + np.uint64(1)) * _TURN))
            time, found, step = np.zeros(len(v)), [], np.uint64(0)
            while len(v):
                step += np.uint64(1)
                dart = mix(seed + step * _STEP)
                time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
                on = time < limit[d]
                d, c, seed, time, low, width, dart = d[on], c[on], seed[on], time[on], low[on], width[on], dart[on]
                v = v[: len(d)]
                place = mix(dart ^ _TURN)
                inside = low + width * ((mix(place) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < c
                found.append((d[inside] * k + (place[inside] % np.uint64(k)).astype(np.int64), time[inside], dart[inside]))
        slot, when, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(-when, kind="stable")  # the earliest comes last and stays
        hit = np.zeros(n_docs * k, bool)
        hit[slot] = True
        flat = np.zeros(n_docs * k, np.uint64)
        flat[slot[order]] = dart[order]
        full = todo & hit.reshape(n_docs, k).all(1)
        out[full] = flat.reshape(n_docs, k)[full]
        todo &= ~full
        reach[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, distinct between bands."""
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), bands, rows)
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), (len(signatures), bands)).copy()
        for r in range(rows):
            key = mix(key * _TURN + parts[:, :, r])
    return key


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Four bits of every entry, sixteen entries a word."""
    k = signatures.shape[1]
    bits = np.zeros((len(signatures), -(-k // 16) * 16), np.uint64)
    bits[:, :k] = signatures & np.uint64(15)
    return (bits.reshape(len(signatures), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)


def differing(a: Column, b: Column, k: int) -> Column:
    """How many of ``k`` entries differ in the four bits that two sketches hold of them."""

    def word(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = reduce(lambda c, n: c.bitwiseOR(F.shiftrightunsigned(x, n)), (1, 2, 3), x)
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(lambda c, i: c + word(i), range(1, -(-k // 16)), word(0))


def most_differing(similarity: float, k: int) -> int:
    """The entries that may differ in a sketch: a pair of this similarity has more of them with a chance below ASTRAY."""
    p = (1 - similarity) * 15 / 16
    chances = [math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(k + 1)]
    return next((n for n in range(k) if sum(chances[n + 1 :]) < ASTRAY), k)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def signed(df: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> DataFrame:
    """The rows of ``df`` with _row, digests _a and _b, the number of shingles _n, the band keys _bands and the sketch _sketch, written once."""

    def make(texts: pa.Array) -> list:
        values, docs, first, second = shingles(texts, width)
        n = np.bincount(docs, minlength=len(texts))
        signatures = darts(*counted(values, docs), len(texts), bands * rows)[n > 0]
        lists = [_lists(x.ravel().view(np.int64), np.where(n > 0, x.shape[1], 0), pa.int64()) for x in (band_keys(signatures, bands, rows), sketches(signatures))]
        return [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(n), *lists]

    longs = T.ArrayType(T.LongType())
    fields = T.StructType([T.StructField(c, t) for c, t in (("_a", T.LongType()), ("_b", T.LongType()), ("_n", T.LongType()), ("_bands", longs), ("_sketch", longs))])
    own = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in {"_row", "_low"}]).withColumn("_low", F.lower(F.col(text)))
    return cut(extend(own, "_low", fields, make, SLICE, drop=("_low",)).withColumn("_row", F.monotonically_increasing_id()))


def element_sets(df: DataFrame, text: str, width: int = SHINGLE) -> DataFrame:
    """_row and the sorted 32-bit hashes of its (shingle, occurrence) pairs: weighted Jaccard becomes that of plain sets."""

    def make(texts: pa.Array) -> list:
        v, d, c = counted(*shingles(texts, width)[:2])
        nth = (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64)
        d = np.repeat(d, c)
        with np.errstate(over="ignore"):
            e = (mix(np.repeat(v, c) + mix((nth + np.uint64(1)) * _STEP)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        e, d, _ = counted(e, d)
        return [_lists(e, np.bincount(d, minlength=len(texts)), pa.int32())]

    own = df.select("_row", F.lower(F.col(text)).alias("_low"))
    return extend(own, "_low", T.StructType([T.StructField("_set", T.ArrayType(T.IntegerType()))]), make, SLICE, drop=("_low",))


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, similarity) of every pair. Of the sets only those of the pairs' ends travel."""
    needed = pairs.select(F.explode(F.array("x", "y")).alias("x")).distinct()
    own = sets.toDF("x", "_p").join(small(needed), "x", "left_semi")
    left, right = own, own.toDF("y", "_q")
    met = pairs.join(left, "x").join(right, "y")
    common = F.size(F.array_intersect("_p", "_q"))
    return met.select("x", "y", (common / (F.size("_p") + F.size("_q") - common)).alias("similarity"))


def _alike(similarity: float, entries: int) -> Column:
    """Whether sizes and sketches of both ends of a pair allow ``similarity``."""
    near = F.least("n", "other_n") >= similarity * F.greatest("n", "other_n")
    return near & (differing(F.col("sketch"), F.col("other_sketch"), entries) <= most_differing(similarity, entries))


def open_pairs(members: DataFrame, sets: DataFrame, similarity: float, entries: int) -> DataFrame:
    """(x, y) with x < y: all pairs of different classes among ``members`` (node, root, n, sketch; each node once) that can reach ``similarity``.

    With elements in order of their number of holders, two sets of size m and this similarity share one of the first
    m - similarity * m + 1 of each; where they meet first, what is left of either must make up the overlap that their sizes ask for.
    Elements of one class alone come first and meet nobody, and what thousands share comes last and is seldom met at.
    """
    own = members.select("node", "root", "n", "sketch")
    whole = own.select("node", "root").join(sets.toDF("node", "_set"), "node")
    held = whole.select("node", "root", F.explode("_set").alias("e"))
    holders = held.groupBy("e").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("e", "c")
    shared = held.join(holders, "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("_shared"))
    sized = shared.join(whole.select("node", F.size("_set").alias("size")), "node")
    alone = F.col("size") - F.size("_shared")  # elements of one class, which come before all others
    # the product is rounded down before it is rounded up: a prefix may be too long, never too short
    first = (F.col("size") - F.ceil(F.col("size") * similarity - 1e-6) + 1).cast("int")
    placed = F.transform(F.slice("_shared", F.lit(1), F.greatest(first - alone, F.lit(0))), lambda x, i: F.struct(x["e"].alias("e"), (alone + i).alias("at")))
    prefixes = sized.select("node", "size", placed.alias("_prefix")).where(F.size("_prefix") > 0).join(own, "node")
    place = prefixes.select("node", "root", "n", "size", "sketch", "_prefix", F.posexplode("_prefix").alias("_at", "x"))
    # the elements before, as many as are worth carrying: a pair is made where none of them is shared
    names = F.transform("_prefix", lambda x: x["e"])
    before = F.when(F.col("_at") > 0, F.slice(names, F.greatest(F.col("_at") - BEFORE + 1, F.lit(1)), F.least("_at", F.lit(BEFORE)))).otherwise(F.slice(names, 1, 0))
    place = place.select(F.col("x.e").alias("e"), "node", "root", "n", "size", F.col("x.at").alias("at"), "sketch", before.alias("before"))
    # the smaller set of a pair, or the one with the smaller node, is met in a shorter prefix: the other one asks at least its own size of it
    lesser = place.where(F.col("at") <= F.col("size") * ((1 - similarity) / (1 + similarity)) + 1e-6)
    other = place.select("e", *[F.col(c).alias(f"other_{c}") for c in place.columns[1:]])
    overlap = (F.col("size") + F.col("other_size")) * (similarity / (1 + similarity)) - 1e-6
    reach = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at")) >= overlap
    smaller = (F.col("size") < F.col("other_size")) | ((F.col("size") == F.col("other_size")) & (F.col("node") < F.col("other_node")))
    met = lesser.join(other, "e").where(smaller & reach & (F.col("root") != F.col("other_root")) & _alike(similarity, entries) & ~F.arrays_overlap("before", "other_before"))
    return met.select(F.least("node", "other_node").alias("x"), F.greatest("node", "other_node").alias("y")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs of at least ``similarity``, written."""
    asked = cut(pairs)
    found = cut(compare(asked, sets).where(F.col("similarity") >= similarity).select("x", "y"))
    discard(asked)
    return found


def _rooted(df: DataFrame, roots: DataFrame | None, node: str, root: str) -> DataFrame:
    """``df`` with the class of its column ``node``: the node itself where it has no link."""
    if roots is None:
        return df.withColumn(root, F.col(node))
    return df.join(roots.toDF(node, root), node, "left").withColumn(root, F.coalesce(root, node))


def link_buckets(members: DataFrame, sets: DataFrame, similarity: float, entries: int = BANDS * ROWS, profiles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) with x < y that join the nodes of buckets into classes, and the classes (node, root).

    members: (key, node), sets: by node, profiles: (node, n, sketch), which members may hold instead. Three steps: every node with the
    hub of its buckets that it shares most of them with, nodes with those of their other hubs that are of other classes by then, and
    ``open_pairs`` among the members of buckets that still hold several classes.
    """
    profiles = members.select("node", "n", "sketch").dropDuplicates(["node"]) if profiles is None else profiles
    buckets = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    central = members.select("key", "node").join(buckets, "key").groupBy("node").agg(F.sum("c").alias("met"))
    rank = F.struct("met", -F.col("node"))
    hubs = members.select("key", "node").join(central, "node").groupBy("key").agg(F.max_by("node", rank).alias("hub"), F.count("*").alias("c")).where("c > 1").select("key", "hub")
    met = cut(members.select("key", "node").join(hubs, "key").where("node <> hub"))
    edges = met.groupBy("node", "hub").agg(F.count("*").alias("bands")).join(profiles, "node").join(profiles.toDF("hub", "other_n", "other_sketch"), "hub").where(_alike(similarity, entries))
    edges = cut(edges.select(F.col("hub").alias("x"), F.col("node").alias("y"), "bands"))
    best = edges.groupBy("y").agg(F.max_by("x", F.struct("bands", -F.col("x"))).alias("x"))
    links = _linked(best.select("x", "y"), sets, similarity)
    roots = None if links.isEmpty() else components(links)
    ends = _rooted(_rooted(edges.select("x", "y"), roots, "x", "a"), roots, "y", "b")
    more = _linked(ends.where("a <> b").select("x", "y"), sets, similarity)
    discard(edges)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
    # every member has met its hub by now: only the others of a bucket may still have links between classes
    placed = cut(_rooted(met.select("key", "node"), roots, "node", "root"))
    discard(met)
    several = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    left = cut(placed.join(several, "key", "left_semi").select("node", "root").distinct().join(profiles, "node"))
    last = _linked(open_pairs(left, sets, similarity, entries), sets, similarity)
    discard(placed, left)
    if not last.isEmpty():
        links = links.unionByName(last)
        roots = components(links)
    if roots is None:
        roots = links.select(F.col("y").alias("node"), F.col("x").alias("root"))
    return links, roots


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node that links lead to.

    Each round hangs larger neighbours, then all, on the smallest one known; the rounds grow with the logarithm of the longest path.
    """
    edges, before = cut(links.select(F.col("y").alias("u"), F.col("x").alias("v"))), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lower, "u")
        known = edges
        edges = cut(hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        discard(known)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(table: DataFrame, id_col: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE, entries: int = BANDS * ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of a ``signed`` table of ``entries`` signature entries (its bands times rows): (nodes, links, classes).

    nodes: (_a, _b, node, root, class_id, n_copies), one row per different text: texts of the same words, in any case and
    spacing, are one node, named by their first row. links: (x, y) between nodes of at least ``similarity`` that
    hold the classes together. classes: (root, class_id).
    Texts without words (null, empty, blank) are one node without links. class_id is the smallest id of a class; null if all are null.
    """
    alike = table.groupBy("_a", "_b").agg(F.min(F.struct("_row", "_n", "_bands", "_sketch")).alias("f"), F.min(id_col).alias("least_id"), F.count("*").alias("n_copies"))
    nodes = cut(alike.select("_a", "_b", F.col("f._row").alias("node"), F.col("f._n").alias("n"), F.col("f._bands").alias("bands"), F.col("f._sketch").alias("sketch"), "least_id", "n_copies"))
    banded = nodes.select("node", F.explode("bands").alias("key"))
    several = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = cut(banded.join(several, "key", "left_semi"))
    wanted = members.select(F.col("node").alias("_row")).distinct()
    sets = cut(element_sets(table.select("_row", text).join(small(wanted), "_row", "left_semi"), text, width))
    links, roots = link_buckets(members, sets, similarity, entries, nodes.select("node", "n", "sketch"))
    placed = nodes.drop("bands", "sketch", "n").join(roots, "node", "left")
    placed = cut(placed.withColumn("root", F.coalesce("root", "node")))
    discard(members, sets, nodes)
    classes = placed.groupBy("root").agg(F.min("least_id").alias("class_id"))
    return placed.join(classes, "root").drop("least_id"), links, classes


def with_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, class_id and n_copies, the rows of the same words.

    Null, empty and blank texts are one class; a class of null ids alone has a null class_id. Other columns do not matter, whatever
    their names. An empty table gives an empty one.
    """
    table = signed(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")))
    nodes, _, _ = near_duplicates(table, "id")
    return table.select("id", "_a", "_b").join(nodes, ["_a", "_b"]).select(F.col("id").alias(id_col), "class_id", "n_copies")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without rows whose class has an earlier row. Rows of null, empty and blank texts are copies of each other.

    All columns keep their values, whatever their names. An empty table gives an empty one.
    """
    names = df.columns
    place = {n: f"c{i}" for i, n in enumerate(names)}
    table = signed(df.toDF(*place.values()), place[text])
    nodes, _, _ = near_duplicates(table, place[id_col], place[text])
    first = nodes.where("root = node").select(F.col("node").alias("_row"))
    return table.join(first, "_row", "left_semi").select([F.col(c).alias(n) for n, c in place.items()])
