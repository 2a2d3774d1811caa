"""Lower-cased terms of a slice of texts: places in numpy, distinct terms told apart by their bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from rankloom.llm.arrowtext import raw, span_hashes, words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Terms:
    """Every occurrence of a term in order: its text's number, and its number among the distinct ``names``."""

    text: np.ndarray
    term: np.ndarray
    names: pa.StringArray


def gathered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans in a row, and where each begins and the last ends."""
    size = end - begin
    at = np.r_[0, np.cumsum(size)]
    return data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])], at


def distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A representative of every distinct span, and the number of each span's representative.

    Spans meet by their hash; the bytes of each are then compared with its representative's, and another hash is taken if two differ.
    """
    flat, at = gathered(data, begin, end)
    size, seed = end - begin, 1
    while True:
        _, first, own = np.unique(span_hashes(data, begin, end, seed), return_index=True, return_inverse=True)
        if np.array_equal(size[first][own], size) and np.array_equal(flat, data[np.repeat(begin[first][own] - at[:-1], size) + np.arange(at[-1])]):
            return first, own
        seed += 1


def find(texts: pa.Array, outside: np.ndarray) -> Terms:
    """The maximal runs of bytes that ``outside`` does not mark, A-Z lower-cased. ``outside`` marks ASCII bytes only."""
    data, at = raw(texts)
    data = _LOWER[data]
    begin, end, text = words(data, at, outside)
    if not len(begin):
        return Terms(text, text, pa.array([], pa.string()))
    first, own = distinct(data, begin, end)
    letters, cuts = gathered(data, begin[first], end[first])
    names = pa.StringArray.from_buffers(len(first), pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(letters.tobytes()))
    return Terms(text, own, names)


def text_counts(found: Terms, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and occurrences of every pair of the two that occurs, in that order; and the terms of each text with repeats."""
    width = max(len(found.names), 1)
    pairs, times = np.unique(found.text * width + found.term, return_counts=True)
    return pairs // width, pairs % width, times, np.bincount(found.text, minlength=n_texts)
