"""Arrow batches of texts: bounded slices, columns added in tasks, word positions and word hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts (or lists of four-byte values) reach ``budget`` bytes, so that a task's memory depends on one slice or one text."""
    texts = batch.column(column)
    lengths = pc.multiply(pc.list_value_length(texts), 4) if pa.types.is_list(texts.type) else pc.binary_length(texts)
    sizes = pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def extend(
    df: DataFrame, text: str, fields: T.StructType, make: Callable[[pa.Array], list], budget: int = 1 << 20, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``fields``, which ``make`` computes from slices of the column ``text``; a column of the same name is replaced."""
    gone = {c.lower() for c in (*fields.names, *drop)}
    keep = [c for c in df.columns if c.lower() not in gone]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *fields.names]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, budget):
                made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(make(part.column(text)), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=names)

    return df.mapInArrow(run, schema)


def least_hashed(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows: one for each of the smallest hashes of ``key``. Only hashes are sorted, and only their edge reaches the driver."""
    hashed = df.withColumn("_hash", F.xxhash64(key))
    edge = hashed.select("_hash").distinct().orderBy("_hash").limit(rows).agg(F.max("_hash")).first()[0]
    return hashed.where(F.col("_hash") <= F.lit(edge)).dropDuplicates(["_hash"]).drop("_hash")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins and ends; a null text is empty."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, at - at[0] if len(texts) else np.zeros(1, np.int64)


def words(data: np.ndarray, at: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every maximal run of bytes that ``outside`` does not mark; runs end with their text."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    gap = outside[data]
    first = ~gap
    first[1:] &= gap[:-1]
    inner = at[(at > 0) & (at < len(data))]
    first[inner] = ~gap[inner]
    last = ~gap
    last[:-1] &= gap[1:]
    last[inner - 1] = ~gap[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(at, begin, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _letters(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: differences of a running polynomial, brought to a common power."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    base = 0x5851F42D4C957F2D + 2 * seed
    with np.errstate(over="ignore"):
        up = _powers(base, len(data))
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_letters(seed)[data] * up[:-1], out=run[1:])
        span = run[end] - run[begin]
        down = _powers(pow(base, -1, 1 << 64), len(data))
        return mix(span * down[begin] + (end - begin).astype(np.uint64) * _ODD)


def run_digests(values: np.ndarray, starts: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit digest per run of ``values``; ``starts`` has where runs begin, and the total length at its end."""
    n = np.diff(starts)
    place = np.arange(len(values), dtype=np.int64) - np.repeat(starts[:-1], n)
    with np.errstate(over="ignore"):
        parts = mix(values + mix((place.astype(np.uint64) + np.uint64(seed)) * _ODD))
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(parts, out=total[1:])
        return mix(total[starts[1:]] - total[starts[:-1]] + n.astype(np.uint64) * _ODD + np.uint64(seed))
