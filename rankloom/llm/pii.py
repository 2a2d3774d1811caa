"""Personal data: patterns for base spans, and information-theoretic sanitisation of the terms that give entities away.

The corpus says how strongly a term reveals a protected entity: with p(e) the share of documents that hold e, and p(e|t) the
share of those with term t in which t stands near e, the term carries 1 - log p(e|t) / log p(e) of the entity's information
(PMI over the entity's own information). An entity of too few texts for an estimate stands for the narrowest class of entities that it
belongs to and that has one: its mail domain, network, first digits, or kind. Terms at or over a disclosure threshold are spans too,
wherever they stand in a document that holds the entity; sanitising generalises or removes them. Clean documents hold no entity
and stay as they are.

Terms are runs of ASCII letters and non-ASCII characters of three bytes or more, compared without ASCII case.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.arrowtext import LETTERS, extend, raw, slices, span_hashes, words
from rankloom.session import cut, small

KINDS = ("email", "ip", "card", "phone")
#: Terms on either side of an entity that count as standing near it.
CONTEXT = 10
#: Share of an entity's information from which a term discloses it, and different texts that must show the two together.
DISCLOSURE, SUPPORT = 0.9, 3
#: Distinct terms that a counting task gathers before it hands them on.
GATHERED = 1 << 20

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, OTHER = re.compile("[0-9]"), re.compile("[^0-9]")


def _luhn(digits: str) -> bool:
    ds = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(ds)) % 10 == 0


def _emails(text: str):
    """Runs of local characters before an @ with a domain behind it; only the surroundings of an @ are looked at."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and LOCAL.match(text[start - 1]):
                start -= 1
            found = DOMAIN.match(text, at + 1) if start < at else None
            if found:
                done = found.end()
                yield start, done
            else:
                done = at + 1  # no match can hold this @
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of personal data, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x[-9:] if not x[:-9].strip("0") else "999") <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = OTHER.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(OTHER.sub("", m[0])) <= 15]
    return sorted(out)


def entity(text: str, kind: int, start: int, end: int) -> int:
    """A signed 64-bit name of the entity that a span holds: its lower-case text, or the digits of cards and phones."""
    value = OTHER.sub("", text[start:end]) if kind >= 2 else text[start:end].lower()
    return int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def classes(text: str, kind: int, start: int, end: int) -> list[int]:
    """Names of what a span's entity stands for, the narrowest first: itself, then the classes that it belongs to, its kind last."""
    said = text[start:end].lower()
    digits = OTHER.sub("", said)
    if kind == 0:
        labels = said.rpartition("@")[2].split(".")
        wider = ["@" + ".".join(labels[i:]) for i in range(len(labels) - 1)]
    elif kind == 1:
        parts = said.split(".")
        wider = [".".join(parts[:n]) + "." for n in (3, 2)]
    else:
        wider = [digits[:n] + "*" for n in ((6,) if kind == 2 else (6, 4, 3))]
    name = lambda v: int.from_bytes(hashlib.blake2b(f"{KINDS[kind]}:{v}".encode(), digest_size=8).digest(), "big", signed=True)
    return [entity(text, kind, start, end), *map(name, wider), name("")]


def _folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = raw(texts)
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8), at


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, begin and end (code points within the text) of every term."""
    data, at = _folded(texts)
    begin, end, owner = words(data, at, ~LETTERS)
    some = end - begin >= 3
    begin, end, owner = begin[some], end[some], owner[some]
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    first = points[at[owner]]
    return span_hashes(data, begin, end).view(np.int64), owner, points[begin] - first, points[end] - first


def found_in(df: DataFrame, text: str, keep_texts: str) -> DataFrame:
    """Written once: the rows with _row, _base (spans), _n (counts), _digest, and of rows with spans _near (entity or class and term, per
    mention's surroundings), _levels (per mention its entity and classes) and _all (the terms outside all mentions).

    ``keep_texts``: "all", or "found" for the texts with base spans only.
    """

    def make(texts: pa.Array) -> list:
        spans, counts, near, digests, levels, every = [], [], [], [], [], []
        whole = [t or "" for t in texts.to_pylist()]
        holding = []
        for i, t in enumerate(whole):
            found = base_spans(t)
            spans.append([{"kind": k, "start": a, "end": b} for a, k, b in found])
            counts.append([sum(k == n for _, k, _ in found) for n in range(4)])
            digests.append(hashlib.blake2b(t.encode(), digest_size=16).digest() if found else None)
            near.append([])
            levels.append([])
            every.append([])
            if found:
                holding.append(i)
        if holding:
            h, owner, begin, end = terms(pa.array([whole[i] for i in holding], pa.string()))
            cuts_at = np.searchsorted(owner, np.arange(len(holding) + 1))
            for k, i in enumerate(holding):
                a, b = cuts_at[k], cuts_at[k + 1]
                hs, bs, es = h[a:b], begin[a:b], end[a:b]
                free = np.ones(len(hs), bool)
                for s in spans[i]:
                    free &= (es <= s["start"]) | (bs >= s["end"])
                hs, bs = hs[free], bs[free]
                pairs = set()
                for s in spans[i]:
                    chain, p = classes(whole[i], s["kind"], s["start"], s["end"]), int(np.searchsorted(bs, s["start"]))
                    around = hs[max(0, p - CONTEXT) : p + CONTEXT].tolist()
                    levels[i].append(chain)
                    for e in chain:
                        pairs.add((e, None))
                        pairs.update((e, t) for t in around)
                every[i] = np.unique(hs).tolist()
                near[i] = [{"e": e, "t": t} for e, t in sorted(pairs, key=str)]
        texts_out = [t if keep_texts == "all" or s else None for t, s in zip(texts.to_pylist(), spans, strict=True)]
        return [texts_out, spans, counts, near, digests, levels, every]

    span = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("kind", "start", "end")]))
    pair = T.ArrayType(T.StructType([T.StructField("e", T.LongType()), T.StructField("t", T.LongType())]))
    longs = T.ArrayType(T.LongType())
    fields = [("_text", T.StringType()), ("_base", span), ("_n", T.ArrayType(T.LongType())), ("_near", pair), ("_digest", T.BinaryType()), ("_levels", T.ArrayType(longs)), ("_all", longs)]
    own = df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in {"_row", "_input", text.lower()}] + [F.col(text).alias("_input")])
    made = extend(own, "_input", T.StructType([T.StructField(*f) for f in fields]), make, drop=("_input",))
    return cut(made.withColumn("_row", F.monotonically_increasing_id()))


def term_counts(df: DataFrame, text: str) -> DataFrame:
    """(t, df): in how many rows each term stands, summed within a task before it is handed on."""

    def run(batches):
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda k, n: pa.RecordBatch.from_pydict({"t": pa.array(k), "n": pa.array(n)})
        held, size = [], 0
        for batch in batches:
            for rows in slices(batch, "_text", 1 << 20):
                h, owner, _, _ = terms(rows.column("_text"))
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                once = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
                k, n = np.unique(h[once], return_counts=True)
                held.append((k, n))
                size += len(k)
                if size > GATHERED:
                    keys, sums = _summed([*held, (keys, sums)])
                    held, size = [], 0
                    if len(keys) > GATHERED:
                        yield out(keys, sums)
                        keys, sums = keys[:0], sums[:0]
        keys, sums = _summed([*held, (keys, sums)])
        yield out(keys, sums)

    return df.select(F.col(text).alias("_text")).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def estimated(table: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Entities and classes of at least ``support`` different texts (e, with_e: their rows), and terms that as many show beside them (e, t, rows)."""
    pairs = table.select("_digest", F.explode("_near").alias("p")).select("_digest", "p.e", "p.t")
    counted = pairs.groupBy("e", "t", "_digest").agg(F.count("*").alias("n")).groupBy("e", "t").agg(F.count("*").alias("texts"), F.sum("n").alias("rows"))
    often = cut(counted.where(F.col("texts") >= support))
    return often.where("t is null").select("e", F.col("rows").alias("with_e")), often.where("t is not null").select("e", "t", "rows")


def stood_for(table: DataFrame, entities: DataFrame) -> DataFrame:
    """(_row, entity, e): per mention the narrowest of its entity and classes that has an estimate, if any has."""
    mentions = table.select("_row", F.explode("_levels").alias("chain")).select("_row", F.col("chain")[0].alias("entity"), F.posexplode("chain").alias("level", "e")).distinct()
    known = mentions.join(small(entities.select("e")), "e")
    return known.groupBy("_row", "entity").agg(F.min_by("e", "level").alias("e"))


def disclosing(df: DataFrame, text: str, n: int, entities: DataFrame, near: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(e, t, share): terms that reveal an entity or class, and how much of its information they carry.

    What is in every document carries no information and is revealed by nothing.
    """
    wanted = cut(near.select("t").distinct())
    if wanted.isEmpty():
        return near.select("e", "t", F.lit(0.0).alias("share")).where("false")
    df_t = term_counts(df, text).join(wanted, "t", "left_semi")
    both = near.join(entities, "e").join(df_t, "t")
    share = F.when(F.col("with_e") < n, 1 - F.log(F.col("rows") / F.col("df")) / F.log(F.col("with_e") / n)).otherwise(0.0)
    return cut(both.select("e", "t", share.alias("share")).where(F.col("share") >= disclosure))


def _mark(df: DataFrame, form: str | None) -> DataFrame:
    """Add _spans, base and term spans in order, and, if asked for, _clean: the text without them."""

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "_text", 1 << 20):
                texts = [t or "" for t in rows.column("_text").to_pylist()]
                h, owner, begin, end = terms(rows.column("_text"))
                at = np.searchsorted(owner, np.arange(len(texts) + 1))
                spans_out, clean = [], []
                for i, (t, base, wanted) in enumerate(zip(texts, rows.column("_base").to_pylist(), rows.column("_terms").to_pylist(), strict=True)):
                    spans = [(s["start"], s["kind"], s["end"]) for s in base]
                    if wanted:
                        a, b = at[i], at[i + 1]
                        hit = np.isin(h[a:b], np.array(wanted, np.int64))
                        for s in base:
                            hit &= (end[a:b] <= s["start"]) | (begin[a:b] >= s["end"])
                        spans += [(x, len(KINDS), y) for x, y in zip(begin[a:b][hit].tolist(), end[a:b][hit].tolist(), strict=True)]
                    spans.sort()
                    spans_out.append([{"kind": k, "start": x, "end": y} for x, k, y in spans])
                    if form:
                        clean.append(_replaced(t, spans, form))
                names = [c for c in rows.schema.names if c != "_terms"]
                made = [pa.array(spans_out, rows.schema.field("_base").type)] + ([pa.array(clean, pa.string())] if form else [])
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), *made], names=[*names, "_spans", *(["_clean"] if form else [])])

    fields = [f for f in df.schema if f.name != "_terms"]
    extra = [T.StructField("_spans", df.schema["_base"].dataType)] + ([T.StructField("_clean", T.StringType())] if form else [])
    return df.mapInArrow(run, T.StructType([*fields, *extra]))


def _replaced(text: str, spans: list[tuple[int, int, int]], form: str) -> str:
    """Base spans become their kind in brackets; terms a name or word in general, or nothing. Overlapping spans become one."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out.append(text[done:start])
            if kind < len(KINDS):
                out.append(f"[{KINDS[kind]}]")
            elif form == "generalise":
                out.append("[name]" if text[start].isupper() else "[word]")
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitise(
    df: DataFrame, text: str = "text", form: str | None = "generalise", keep_texts: str = "all", disclosure: float = DISCLOSURE, support: int = SUPPORT
) -> DataFrame:
    """The rows of ``df`` with _base and _spans (kind, start, end in code points), counts _n by kind, and the sanitised text as _clean.

    ``form``: "generalise", "remove", or None to only find spans. A null text has no spans and stays null; repeated rows stay, and an
    empty table gives an empty one. The text comes back as _text; columns of the caller named like an added one are replaced.
    """
    if form not in ("generalise", "remove", None):
        raise ValueError(f"unknown form {form}")
    table = found_in(df, text, keep_texts)
    holding = table.where(F.size("_base") > 0)
    entities, near = estimated(holding, support)
    pairs = disclosing(df, text, table.count(), entities, near, disclosure).select("e", "t")
    held = stood_for(holding, entities).select("_row", "e").distinct().join(holding.select("_row", F.explode("_all").alias("t")), "_row")
    own = held.join(small(pairs), ["e", "t"]).groupBy("_row").agg(F.collect_set("t").alias("_terms"))
    gone = ("_near", "_digest", "_levels", "_all")
    marked = _mark(holding.drop(*gone).join(own, "_row", "left"), form)
    plain = table.where(F.size("_base") == 0).drop(*gone).withColumn("_spans", F.col("_base"))
    return marked.unionByName(plain.withColumn("_clean", F.col("_text")) if form else plain)


def estimates(df: DataFrame, text: str = "text", support: int = SUPPORT) -> DataFrame:
    """One row: entities, those with an estimate of their own, those that stand for a class, and those without any."""
    holding = found_in(df, text, "found").where(F.size("_base") > 0)
    entities, _ = estimated(holding, support)
    every = holding.select(F.explode("_levels").alias("chain")).select(F.col("chain")[0].alias("entity")).distinct()
    at = stood_for(holding, entities).groupBy("entity").agg(F.min("e").alias("e"))
    joined = every.join(at, "entity", "left")
    own = F.col("e") == F.col("entity")
    return joined.agg(F.count("*").alias("entities"), F.count_if(own).alias("of_their_own"), F.count_if(~own).alias("by_class"), F.count_if(F.col("e").isNull()).alias("without"))


def spelled(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
