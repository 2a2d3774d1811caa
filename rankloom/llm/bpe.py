"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up all neighbouring pairs by binary search over the sorted
pair keys, takes the lowest rank of each word and merges it wherever it stands in that word; words without a known pair leave
the array. Words are looked up in a bounded table first, so that rounds run over new words only.

The vocabulary file is that of a lower-casing word-end tokenizer (NFC, white space as one space, byte symbols, end-of-word suffix).
Ids are stored as little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankloom.llm.arrowtext import extend

#: Words in each of the two tables that a task remembers; a full one takes the place of the older, which changes no result.
REMEMBERED = 250_000
#: Words merged in one set of flat arrays.
ROUND_WORDS = 20_000


#: Latin letters, digits, spaces and marks without an apostrophe: a text of these alone is split by a plainer pattern, alike.
_LATIN, _MARKS = "a-z\u00df-\u00f6\u00f8-\u00ff", r"!-&(-/:-@\[-`{-~"
NOT_PLAIN = re.compile(f"[^{_LATIN}0-9 \t\n\r{_MARKS}]")
PLAIN = re.compile(f"[{_LATIN}]+|[0-9]|[{_MARKS}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


class Vocabulary:
    """The tables of one vocabulary file, and a bounded memory of words already encoded."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or len(split) != 1 or spec["decoder"] is not None:
            raise ValueError(f"{path} is not a lower-casing BPE vocabulary with word ends")
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens of an unknown kind")
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(split[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.final = np.array([ids[s + suffix] for s in symbols], np.int64)
        self.base = len(self.tokens)
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] * self.base + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, pairs[:, 2]
        soonest = np.full(self.base, len(pairs), np.int64)  # the first rank that uses a token
        for side in (0, 1):
            np.minimum.at(soonest, pairs[:, side], np.arange(len(pairs)))
        #: Ranks whose result could be merged again at a lower rank: such a pair is merged one at a time.
        self.single = soonest[pairs[:, 2]] < np.arange(len(pairs))
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # words met lately, and those met before

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; the number of merges where there is none."""
        key = left * self.base + right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], len(self.made))

    def _merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        ends = np.cumsum(sizes)
        flat = np.frombuffer(b"".join(data), np.uint8)
        sym = self.inner[flat]
        sym[ends - 1] = self.final[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        none, done_sym, done_word = len(self.made), [], []
        rank = np.r_[self._rank(sym[:-1], sym[1:]), none]
        rank[ends - 1] = none  # a word's last symbol has no right neighbour
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            stay = best < none
            done_sym.append(sym[~stay])
            done_word.append(word[~stay])
            hit = np.flatnonzero((rank == best) & stay)
            if not len(hit):
                break
            same = word[hit[1:]] == word[hit[:-1]]
            new_run = np.r_[True, (hit[1:] != hit[:-1] + 1) | ~same]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run_start) % 2 == 0
            take &= ~self.single[rank[hit]] | np.r_[True, ~same]
            hit = hit[take]
            sym[hit] = self.made[rank[hit]]
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, word, rank, hit = sym[stay], word[stay], rank[stay], place[hit]
            rank[hit] = none
            inner = hit[hit + 1 < len(sym)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self._rank(sym[inner], sym[inner + 1])
            left = hit[hit > 0] - 1
            left = left[word[left] == word[left + 1]]
            rank[left] = self._rank(sym[left], sym[left + 1])
        found, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        stored = found[order].astype("<u4").tobytes()
        cuts = (4 * np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))]).tolist()
        return [stored[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _words(self, text: str) -> list[str]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # lower-casing sees one character at a time
        return self.words.findall(text) if NOT_PLAIN.search(text) else PLAIN.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        docs = []
        for t in texts:
            special = self.cut is not None and "<|" in t
            docs.append([x if special and x in self.special else self._words(x) for x in (self.cut.split(t) if special else [t])])
        now, old = self.known
        lost = []
        for w in set().union(*(ws for parts in docs for ws in parts if isinstance(ws, list))) - now.keys():
            x = old.get(w)
            if x is None:
                lost.append(w)
            else:
                now[w] = x
        for i in range(0, len(lost), ROUND_WORDS):
            some = lost[i : i + ROUND_WORDS]
            now.update(zip(some, self._merge(some), strict=True))
        get = now.__getitem__
        out = [b"".join([b"".join(map(get, ws)) if isinstance(ws, list) else np.uint32(self.special[ws]).tobytes() for ws in parts]) for parts in docs]
        if len(now) > REMEMBERED:
            self.known = ({}, now)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file that every executor has at ``path``."""
    return Vocabulary(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the ids of every whole text and their number.

    A null text counts as an empty one and has no ids. Columns named like the added ones are replaced, repeated rows stay.
    """

    def make(texts: pa.Array) -> list:
        found = vocabulary(path).encode([x or "" for x in texts.to_pylist()])
        return [found, [len(x) // 4 for x in found]]

    return extend(df, text, T.StructType([T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType())]), make, drop=drop)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the text of every row of ids: its tokens, special ones too, with one space between. Null ids give an empty text.

    Ids that the vocabulary lacks are an error.
    """

    def make(rows: pa.Array) -> list:
        vocab = vocabulary(path)
        return [[vocab.decode(np.frombuffer(x or b"", "<u4")) for x in rows.to_pylist()]]

    return extend(df, ids, T.StructType([T.StructField(decoded, T.StringType())]), make, drop=drop)
