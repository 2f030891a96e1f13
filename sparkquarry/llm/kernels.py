"""Vectorised text kernels shared by the operators of this folder.

All of them work on one flat byte buffer that holds the UTF-8 of many documents, as Arrow delivers
it, so that no Python object is made for a word. Memory is bounded by the slice size (SLICE bytes,
or one document if that is longer) plus some 20 bytes for each word of the slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sparkquarry.store import bound_batches

SLICE = 1 << 20
SEGMENT = 1 << 18
_P = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACES = frozenset((0x20, *range(0x09, 0x0E)))


def table(separators) -> np.ndarray:
    """bool[256]: True where the byte belongs to a word."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words of white-space separated text, and words of letters, digits and non-ASCII.
BLANK_WORDS = table(SPACES)
ALNUM_WORDS = table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = SEGMENT + 1
    base, inv = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    base[0] = inv[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(inv)


@dataclass
class Words:
    """Words of n documents: 64-bit hash, byte start and end in the buffer; those of document d are first[d]:first[d + 1]."""

    h: np.ndarray
    s: np.ndarray
    e: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def spans_of(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; runs break at the document offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[0], edge[n] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = np.unique(cut[inside[cut] & inside[cut - 1]])
    starts = np.flatnonzero(edge[:n] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    if len(both):
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    return starts, ends


def tokenize(buf: np.ndarray, offs: np.ndarray, word: np.ndarray, lower: bool = True) -> Words:
    """Words of each document and their hashes. Hashes of equal words are equal wherever they stand."""
    s, e = spans_of(word[buf], offs)
    powers, inverse = _powers()
    values = _BYTE[LOWER] if lower else _BYTE
    h = np.zeros(len(s), np.uint64)
    n = len(buf)
    for a in range(0, n, SEGMENT):
        b = min(n, a + SEGMENT)
        i, j = np.searchsorted(e, a, "right"), np.searchsorted(s, b, "left")
        if i == j:
            continue
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[buf[a:b]] * powers[: b - a], out=total[1:])
        lo, hi = np.maximum(s[i:j], a) - a, np.minimum(e[i:j], b) - a
        part = (total[hi] - total[lo]) * inverse[lo]
        if s[i] < a:  # continues a word of the segment before
            part[:1] *= np.uint64(pow(_P, int(a - s[i]), 1 << 64))
        h[i:j] += part
    return Words(mix(h), s, e, np.searchsorted(s, offs))


def fold(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values."""
    size = max(0, len(h) - n + 1)
    out = np.full(size, n, np.uint64)
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : k + size]
    return mix(out)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside a document, and the index of each one's first word."""
    all_ = fold(w.h, n)
    at = np.arange(len(all_))
    last = np.repeat(w.first[1:], w.counts)[: len(all_)] if len(all_) else at
    ok = at + n <= last
    return all_[ok], at[ok]


def sort_within(x: np.ndarray, first: np.ndarray) -> None:
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            x[a:b].sort()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, off, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with at most limit bytes of text each (or one row)."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, n, a = np.cumsum(size), len(size), 0
    while a < n:
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


def map_text(df: DataFrame, make: Callable[[], Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict | None]], schema, text: str = "text", limit: int = SLICE) -> DataFrame:
    """Applies a kernel to slices of df by mapInArrow.

    make() is called once in each task and gives the kernel; the kernel takes (bytes, offsets,
    slice) and returns the columns of schema as a dict of arrays. No row goes to another task.
    """
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)
    bound_batches(df.sparkSession)

    def run(batches):
        kernel = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                out = kernel(*flat(part.column(text)), part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x.cast(f.type) for f, x in zip(arrow, (out[f.name] for f in arrow))], schema=arrow)

    return df.mapInArrow(run, fields)


def sliced(table: pa.Table, text: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a table's texts, a slice at a time."""
    for batch in table.to_batches():
        for part in slices(batch, text):
            yield flat(part.column(text))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for each d; 0 where empty."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
