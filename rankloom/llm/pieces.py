"""SentencePiece encoding and decoding by a table of each prefix's last token.

Every prefix of a text has one encoding, and that encoding has one last token. A token ending a prefix is the last one if and only if
it is compatible with the last token of the prefix before it: the two, merged on their own, stay two. So one pass over the text
finds all tokens that end at each place (an automaton of all tokens), keeps the one that passes the pair test, and the ids are
recovered backwards from the end. The work grows with the length of the text, however long its words are.

Two tokens are tested by undoing their merges at the seam, the latest first: they are apart if at no moment the two parts that
meet at the seam would have been merged sooner than the next merge of either. Tokens whose merges do not come in the order of their
scores (runs of spaces share one score) are tested by merging the pair.

The model file is that of a merge-type (BPE) model with bytes for unknown characters and without character rules. Words, which
no token crosses, are looked up in a bounded table first.
"""

from __future__ import annotations

import codecs
import functools
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rankloom.llm.arrowtext import extend

#: Words, and pairs of tokens, in each of the two tables of a memory.
REMEMBERED = 250_000

SPACE = "▁"
#: Fixed values of the model file: kinds of pieces, and the fields of its messages.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
TRAINER_MODEL_TYPE, TRAINER_SUFFIX_SPACE, TRAINER_BYTE_FALLBACK, TRAINER_UNKNOWN_SURFACE = 3, 24, 35, 44
RULES_CHARSMAP, RULES_DUMMY_PREFIX, RULES_EXTRA_SPACES, RULES_ESCAPE_SPACES = 2, 3, 4, 5
MERGE_TYPE = 2


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one message of the model file: number and value."""
    at = 0
    while at < len(data):
        key, at = _number(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            if kind == 2:
                size, at = _number(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _each_byte(error: UnicodeError):
    return "�", error.start + 1


codecs.register_error("rankloom-each-byte", _each_byte)


class _Memory(dict):
    """What ``make`` gives for a key, remembered; a full table becomes the older one, whose entries come back when they are asked for."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


class Pieces:
    """The tables of one model file, and a bounded memory of words and pairs already met."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(message(f.read()))
        trainer = dict(message(next((v for n, v in parts if n == TRAINER), b"")))
        rules = dict(message(next((v for n, v in parts if n == NORMALIZER), b"")))
        if trainer.get(TRAINER_MODEL_TYPE) != MERGE_TYPE or not trainer.get(TRAINER_BYTE_FALLBACK) or trainer.get(TRAINER_SUFFIX_SPACE):
            raise ValueError(f"{path} is not a merge-type model with bytes for unknown characters")
        if rules.get(RULES_CHARSMAP) or rules.get(RULES_EXTRA_SPACES, 1) or not rules.get(RULES_ESCAPE_SPACES, 1):
            raise ValueError(f"{path} changes characters or spaces before it merges")
        self.prefix = SPACE if rules.get(RULES_DUMMY_PREFIX, 1) else ""
        unknown = trainer.get(TRAINER_UNKNOWN_SURFACE, " ⁇ ".encode())
        self.ids: dict[str, int] = {}
        self.texts: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.byte_ids = [0] * 256
        for i, v in enumerate(v for n, v in parts if n == PIECES):
            own = dict(message(v))
            text, kind = own[PIECE_TEXT].decode(), own.get(PIECE_KIND, NORMAL)
            if kind in (USER_DEFINED, UNUSED):
                raise ValueError(f"{path} has pieces of a kind that is not known here: {text}")
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
            if kind == NORMAL:
                self.ids[text] = i
            self.texts.append(text)
            self.kinds.append(kind)
            scores.append(struct.unpack("<f", own.get(PIECE_SCORE, b"\0\0\0\0"))[0])
        if any(c not in self.ids for t in self.ids for c in t):
            raise ValueError(f"{path} has pieces with characters that are no pieces")
        levels = {s: n for n, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = [levels[scores[i]] if k == NORMAL else -1 for i, k in enumerate(self.kinds)]
        self.size = len(self.texts)
        self._derive()
        self._cut()
        form = {BYTE: lambda t: bytes([int(t[3:5], 16)]), CONTROL: lambda t: b"", UNKNOWN: lambda t: unknown, NORMAL: lambda t: t.replace(SPACE, " ").encode()}
        plain = [form[k](t) for t, k in zip(self.texts, self.kinds, strict=True)]
        led = [self.prefix and k == NORMAL and t.startswith(SPACE) for t, k in zip(self.texts, self.kinds, strict=True)]
        #: What each id says, and then what it says at the front of a text.
        self.surfaces = pa.array([*plain, *(x[1:] if skip else x for x, skip in zip(plain, led, strict=True))], pa.binary())
        self.silent = np.array([k == CONTROL for k in self.kinds])
        self.known = _Memory(self._word)
        self.pairs = _Memory(lambda key: self.apart(*divmod(key, self.size)))

    def _merged(self, chars: str, stop: int = -1) -> tuple[list[str], list[str]]:
        """What a short string is merged to, and the two parts of its last merge; None in place of it once a merge crosses ``stop``."""
        parts, last = list(chars), []
        while True:
            found = [(self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not found:
                return parts, last
            at = min(found)[1]
            last = parts[at : at + 2]
            parts[at : at + 2] = [last[0] + last[1]]
            if stop >= 0 and stop not in {sum(map(len, parts[:k])) for k in range(1, len(parts))}:
                return [], last

    def _derive(self) -> None:
        """Per token the two parts of its last merge, whether its merges come in the order of ranks, and the automaton of all that are ever made."""
        self.halves: dict[int, tuple[int, int]] = {}
        self.ordered = [False] * self.size
        self.automaton = ahocorasick.Automaton()
        tied = {r for r, n in zip(*np.unique([self.rank[i] for i in self.ids.values()], return_counts=True), strict=True) if n > 1}
        for text, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(text) > 1:
                parts, last = self._merged(text)
                if len(parts) > 1:
                    continue  # no text is ever merged to this piece
                left, right = self.halves[i] = self.ids[last[0]], self.ids[last[1]]
                inner = [self.rank[x] for x in (left, right) if x in self.halves]
                self.ordered[i] = self.ordered[left] and self.ordered[right] and all(r < self.rank[i] for r in inner) and self.rank[i] not in tied
            else:
                self.ordered[i] = True
            self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()

    def _cut(self) -> None:
        """The pattern of words: no piece has a space behind another character, and none holds a separator."""
        crossed = any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)
        apart = re.escape("".join(c for c in map(chr, range(32)) if not any(c in t for t in self.ids)))
        single = f"|[{apart}]" if apart else ""
        self.words = re.compile(f"[^{apart}]+{single}" if crossed else f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+{single}", re.DOTALL)

    def _seam(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart, for tokens whose merges come in the order of ranks."""
        never = self.size
        x, y = left, right
        next_x = next_y = never  # the ranks at which the parts at the seam were merged into what they are part of
        while True:
            made = self.ids.get(self.texts[x] + self.texts[y])
            if made is not None and self.rank[made] < next_x and self.rank[made] <= next_y:
                return False
            x_made = self.rank[x] if x in self.halves else -1
            y_made = self.rank[y] if y in self.halves else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                next_x, x = x_made, self.halves[x][1]
            elif y_made > x_made:
                next_y, y = y_made, self.halves[y][0]
            else:  # the same token twice: its left one is merged first, so the right one is undone first
                next_y, y = y_made, self.halves[y][0]

    def apart(self, left: int, right: int) -> bool:
        """Whether a text that is merged to ``left`` and ``right`` on their own stays two tokens."""
        if self.ordered[left] and self.ordered[right]:
            return self._seam(left, right)
        a, b = self.texts[left], self.texts[right]
        return self._merged(a + b, len(a))[0] == [a, b]

    def _word(self, word: str) -> bytes:
        """The ids of one word."""
        pairs, size = self.pairs, self.size
        last, sizes = [-1] * (len(word) + 1), [0] * (len(word) + 1)  # token and length; -1: the start, or an unknown character
        for end, (n, token) in self.automaton.iter(word):
            end += 1
            if not sizes[end]:
                before = last[end - n]
                if before < 0 or pairs[before * size + token]:
                    last[end], sizes[end] = token, n
        found, at = array("I"), len(word)
        while at:
            if sizes[at]:
                found.append(last[at])
                at -= sizes[at]
            else:
                at -= 1
                found.extend(self.byte_ids[b] for b in reversed(word[at].encode()))
        found.reverse()
        return found.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as unsigned 32-bit integers."""
        out = []
        for text in texts:
            words = self.words.findall((self.prefix + text).replace(" ", SPACE)) if text else ()
            out.append(b"".join(map(self.known.__getitem__, words)))
            self.known.trim()
            self.pairs.trim()
        return out

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.StringArray:
        """The texts of runs of ids; ``starts`` has where runs begin, and the total length at its end."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise ValueError(f"ids of {ids.min()} to {ids.max()} for a model of {self.size} pieces")
        # the front of a text is its first id that is not silent
        spoken = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(spoken, starts[:-1])
        front = spoken[first[first < np.searchsorted(spoken, starts[1:])]]
        said = ids.astype(np.int64)
        said[front] += self.size
        letters = pa.concat_arrays([self.surfaces.take(pa.array(said))])
        at = np.frombuffer(letters.buffers()[1], np.int32, len(ids) + 1, letters.offset * 4)
        data = letters.buffers()[2] or pa.py_buffer(b"")
        made = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(at[starts].tobytes()), data)
        try:
            made.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no character
            return pa.array([x.decode(errors="rankloom-each-byte") for x in made.cast(pa.binary()).to_pylist()], pa.string())
        return made


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model of a file that every executor has at ``path``."""
    return Pieces(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the ids (array of int) of every whole text and their number, without begin or end ids.

    A null text counts as an empty one and has no ids. Columns named like the added ones are replaced (whatever their case), other
    columns stay as they are, repeated rows stay, an empty table gives an empty one.
    """

    def make(texts: pa.Array) -> list:
        found = pieces(path).encode([x or "" for x in texts.to_pylist()])
        sizes = [len(x) // 4 for x in found]
        flat = pa.array(np.frombuffer(b"".join(found), np.int32))
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), flat), sizes]

    return extend(df, text, T.StructType([T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n_tokens, T.LongType())]), make, drop=drop)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the text of every row of ids. Null ids give an empty text; bytes that are no character give U+FFFD each.

    Begin and end ids are silent, null ids inside a row are skipped, ids that the model lacks are an error. Columns named like the
    added one are replaced.
    """

    def make(rows: pa.Array) -> list:
        if rows.null_count or rows.flatten().null_count:
            rows = pa.array([[i for i in x or () if i is not None] for x in rows.to_pylist()], rows.type)
        sizes = rows.value_lengths().to_numpy()
        return [pieces(path).decode(rows.flatten().to_numpy(), np.r_[0, np.cumsum(sizes, dtype=np.int64)])]

    return extend(df, ids, T.StructType([T.StructField(decoded, T.StringType())]), make, drop=drop)
