"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

Each source with a share of its own is a queue, the small ones share a queue: in it, whole documents stand in the order of the
fraction of their source that is sent with them, so that at any place all its sources are equally far. In every window a queue is due its quota of
tokens; what whole tokens cannot pay is its deficit, carried into the next window. The debts of all windows up to w have a
closed form: queues up to j have sent floor(t C_j / N) tokens when t tokens are packed (N in all, C_j those of queues up to j).
So a task finds the windows, offsets and carried deficits of its documents from their place in their queue alone, without
seeing other partitions, every window is full, and no queue is ever a whole token away from its due.

Where targets differ from what the queues hold, a queue ends early; an epoch ends there, and the remaining queues share on.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankloom.llm.arrowtext import slices
from rankloom.llm.bpe import vocabulary
from rankloom.session import cut, small

WINDOW, END = 4096, 2
#: Tokens a window holds of a queue at least; sources of smaller shares are pooled. At most WINDOW / GRAIN queues reach the driver.
GRAIN = 64
#: Stretches of the shared queue that are sorted apart.
STRETCHES = 4096


@dataclass(frozen=True)
class Epoch:
    """A stretch of the tape of packed tokens: where it starts, which queues send, from where on and how much."""

    start: int
    queues: np.ndarray
    begin: np.ndarray
    length: np.ndarray

    def sent(self, j: np.ndarray, tape: np.ndarray) -> np.ndarray:
        """Tokens that the first j queues have sent when the tape is ``tape`` long."""
        total = int(self.length.sum())
        cum = np.r_[0, np.cumsum(self.length)]
        t = np.clip(tape - self.start, 0, total)
        return np.where(t == total, cum[j], np.floor(t * (cum[j] / total)).astype(np.int64))


def epochs(held: list[int], weights: list[float]) -> list[Epoch]:
    """Stretches between the ends of queues that hold ``held`` tokens and send in proportion to ``weights``."""
    ends = [h / w for h, w in zip(held, weights, strict=True)]
    out, start, before = [], 0, [0] * len(held)
    for v in sorted(set(ends)):
        now = [h if e <= v else max(b, min(h, int(w * v))) for h, w, e, b in zip(held, weights, ends, before, strict=True)]
        live = [j for j in range(len(held)) if now[j] > before[j]]
        length = np.array([now[j] - before[j] for j in live], np.int64)
        out.append(Epoch(start, np.array(live), np.array([before[j] for j in live], np.int64), length))
        start, before = start + int(length.sum()), now
    return out


def cuts(queue: np.ndarray, place: np.ndarray, size: np.ndarray, plan: list[Epoch], window: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of every piece of documents at ``place`` in their ``queue``."""
    found = []
    for e in plan:
        for k, q in enumerate(e.queues.tolist()):
            first, length, total = int(e.begin[k]), int(e.length[k]), int(e.length.sum())
            a, b = np.maximum(place, first) - first, np.minimum(place + size, first + length) - first
            docs = np.flatnonzero((queue == q) & (a < b))
            if not len(docs):
                continue
            j = np.full(1, k)

            def own(w, e=e, j=j):  # tokens of this queue before window w
                return e.sent(j + 1, w * window) - e.sent(j, w * window)

            def holding(p, own=own, e=e, length=length, total=total):  # the window that holds token p of the queue
                w = ((e.start + (p + 0.5) * total / length) // window).astype(np.int64)
                while (over := own(w) > p).any():
                    w = w - over
                while (under := own(w + 1) <= p).any():
                    w = w + under
                return w

            a, b = a[docs], b[docs]
            low, high = holding(a), holding(b - 1)
            n = high - low + 1
            w = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            doc, a, b = np.repeat(docs, n), np.repeat(a, n), np.repeat(b, n)
            mine = own(w)
            start, stop = np.maximum(a, mine), np.minimum(b, own(w + 1))
            head = np.maximum(e.start - w * window, 0)  # what an earlier epoch has put into the window
            offset = head + e.sent(j, (w + 1) * window) - e.sent(j, w * window) + start - mine
            some = stop > start
            found.append(np.stack([doc, start + first - place[doc], stop - start, w, offset])[:, some])
    if not found:
        return tuple(np.zeros((5, 0), np.int64))
    return tuple(np.concatenate(found, 1))


def coded_rows(df: DataFrame, path: str, id_col: str, text: str, source: str, end: int) -> DataFrame:
    """Written once: id, _source, _ids (packed), _n, and how many tokens of the source stand earlier in the same task."""
    own = df.select(F.col(id_col).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source"), F.col(text).alias("_text"))

    def run(batches):
        vocab, before, part = vocabulary(path), {}, TaskContext.get().partitionId()
        width = "<u2" if max(len(vocab.tokens), end + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for rows in slices(batch, "_text", 1 << 20):
                ids = [np.r_[np.frombuffer(x, "<u4"), np.uint32(end)].astype(width) for x in vocab.encode([t or "" for t in rows.column("_text").to_pylist()])]
                places, sources = [], rows.column("_source").to_pylist()
                for s, x in zip(sources, ids, strict=True):
                    places.append(before.get(s, 0))
                    before[s] = places[-1] + len(x)
                yield pa.RecordBatch.from_pydict(
                    {"_id": rows.column("_id"), "_source": rows.column("_source"), "_ids": pa.array([x.tobytes() for x in ids], pa.binary()), "_n": pa.array(list(map(len, ids)), pa.int64()), "_before": pa.array(places, pa.int64()), "_part": pa.array([part] * len(ids), pa.int64())}
                )

    kind = own.schema["_id"].dataType.simpleString()
    return cut(own.mapInArrow(run, f"_id {kind}, _source string, _ids binary, _n long, _before long, _part long"))


def shared_places(coded: DataFrame, parts: DataFrame, tokens: int, window: int) -> DataFrame:
    """The rows of ``coded`` with their _place in one queue of ``tokens`` tokens that all their sources share evenly.

    A document stands at the fraction of its source's tokens that come before it or are a part of its own, the same part for all
    documents of a source and by hash of its name, so that sources of one document spread as well. Stretches of fractions hold about
    as many tokens each; they are sorted apart, and their sums are added up.
    """
    stretches = max(1, min(STRETCHES, tokens // (4 * window)))
    of = Window.partitionBy("_source")
    earlier = F.coalesce(F.sum("tokens").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_source", "_part", earlier.alias("_base"), F.sum("tokens").over(of).alias("_all"))
    phase = F.pmod(F.xxhash64("_source"), F.lit(1 << 20)) / (1 << 20)
    fraction = (F.col("_base") + F.col("_before") + F.col("_n") * phase) / F.col("_all")
    stood = coded.join(small(starts), ["_source", "_part"]).withColumn("_fraction", fraction)
    stood = stood.withColumn("_stretch", F.least(F.floor(F.col("_fraction") * stretches), F.lit(stretches - 1)))
    sums = stood.groupBy("_stretch").agg(F.sum("_n").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = Window.partitionBy("_stretch").orderBy("_fraction", "_source", "_part", "_before").rowsBetween(Window.unboundedPreceding, -1)
    ordered = stood.withColumn("_own", F.coalesce(F.sum("_n").over(own), F.lit(0)))
    placed = ordered.join(F.broadcast(sums.select("_stretch", before.alias("_first"))), "_stretch")
    return placed.select("_id", "_ids", (F.col("_first") + F.col("_own")).alias("_place"))


def pack(
    df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None,
    window: int = WINDOW, end: int = END, grain: int = GRAIN, with_ids: bool = False,
) -> DataFrame:
    """Cut every row's ids and the closing id ``end`` into pieces of gapless sequences of ``window`` ids; only the last one is short.

    ``targets`` has weights of sources; those not named share what their tokens would get. Without it every window has the corpus's
    own proportions, to a token for sources of ``grain`` tokens a window or more; the documents of smaller ones (and of the smallest
    other, if they do not come to ``grain`` together) stay whole in their shared queue and are spread evenly over all windows, as
    are those not named by ``targets``. A null or empty text is the closing id alone, a null source is a source, repeated rows are packed each.
    Returns id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, the piece's ids; an empty table gives no row.
    """
    coded = coded_rows(df, path, id_col, text, source, end)
    parts = cut(coded.groupBy("_source", "_part").agg(F.sum("_n").alias("tokens")))
    by_source = parts.groupBy("_source").agg(F.sum("tokens").alias("tokens"))
    total = by_source.agg(F.sum("tokens")).first()[0] or 0
    if targets:
        named = {f"={s}": w for s, w in targets.items() if w > 0}
        own = {r[0]: r[1] for r in by_source.where(F.col("_source").isin(*named)).collect()}
    else:
        least = -(-grain * total // window)
        top = by_source.where(F.col("tokens") >= max(least, 1)).orderBy(F.desc("tokens"), "_source").limit(window // grain)
        own = {r[0]: r[1] for r in top.collect()}
        named = dict(own)
    rest = total - sum(own.values())
    if own and 0 < rest < grain * total / window:  # too little for a queue: it joins the smallest one
        rest += own.pop(min(own, key=lambda s: (own[s], s)))
    names = sorted(own)
    held = [own[s] for s in names] + [rest] * (rest > 0)
    scale = sum(own.values()) / sum(named[s] for s in names) if names else 1.0
    plan = epochs(held, [named[s] * scale for s in names] + [float(rest)] * (rest > 0))
    if any((x.length * window < x.length.sum()).any() and x.length.sum() > window for x in plan):
        raise ValueError("a target gives a source less than one token a window")
    queue = F.coalesce(F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)])[F.col("_source")], F.lit(len(names))) if names else F.lit(0)
    shared = len(names)
    order = Window.partitionBy("_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_queue", queue)
    bases = parts.where(F.col("_queue") < shared).withColumn("_base", F.coalesce(F.sum("tokens").over(order), F.lit(0))).drop("tokens")
    placed = coded.join(small(bases), ["_source", "_part"]).select("_id", "_ids", "_queue", (F.col("_base") + F.col("_before")).alias("_place"))
    if rest:
        pool = shared_places(coded.where(queue == shared), parts.where(F.col("_queue") == shared), rest, window)
        placed = placed.unionByName(pool.withColumn("_queue", F.lit(shared)))
    wide = max(end + 1, len(vocabulary(path).tokens)) > 1 << 16

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "_ids", 4 << 20):
                ids = [np.frombuffer(x, "<u4" if wide else "<u2").astype("<u4") for x in rows.column("_ids").to_pylist()]
                size = np.array(list(map(len, ids)), np.int64)
                doc, start, length, seq, offset = cuts(rows.column("_queue").to_numpy(), rows.column("_place").to_numpy(), size, plan, window)
                pieces = [ids[d][s : s + n].tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                made = [rows.column("_id").take(pa.array(doc)), start, length, list(map(zlib.crc32, pieces)), size[doc], seq, offset]
                kinds = [None, *[pa.int64()] * 6]
                arrays = [made[0], *(pa.array(x, k) for x, k in zip(made[1:], kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(pieces, pa.binary())] if with_ids else [])], names=names_out)

    names_out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    kind = df.schema[id_col].dataType.simpleString()
    return placed.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else ""))
