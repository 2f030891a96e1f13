"""Exact term counts of the texts of a slice, shared by the divergence audit and the ranked search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sparkquarry.llm import kernels as K

#: Words of letters and non-ASCII only.
LETTER_WORDS = K.table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: A longer text is taken in parts of about so many bytes.
PART = 4 << 20


@dataclass
class Counts:
    """Document doc[i] holds the term names[code[i]] n[i] times; one entry for each document and term, in order of (doc, code). totals are words of each document, repeats included."""

    doc: np.ndarray
    code: np.ndarray
    n: np.ndarray
    names: pa.Array
    totals: np.ndarray


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A string array whose values stand one behind the other in data."""
    offs = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def words(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words in order, A-Z lower-cased, and how many each document has."""
    inside = word[buf]
    s, e = K.spans_of(inside, offs)
    return strings(K.LOWER[buf[inside]], e - s), np.diff(np.searchsorted(s, offs))


def parts(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The slice itself; a single long text in parts that end outside words (a word longer than PART stays whole)."""
    if len(offs) != 2 or len(buf) <= PART:
        yield buf, offs
        return
    a, n = 0, len(buf)
    while a < n:
        b = min(n, a + PART)
        while b < n and word[buf[b]] and word[buf[b - 1]]:
            step = ~word[buf[b : b + 4096]]
            b = b + int(step.argmax()) if step.any() else min(n, b + 4096)
        yield buf[a:b], np.array([0, b - a])
        a = b


def counts(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> Counts:
    found, totals = [], np.zeros(len(offs) - 1, np.int64)
    for piece, at in parts(buf, offs, word):
        w, each = words(piece, at, word)
        totals += each
        coded = w.dictionary_encode()
        size = max(1, len(coded.dictionary))
        key = np.repeat(np.arange(len(each)), each) * size + coded.indices.to_numpy(zero_copy_only=False)
        key.sort()
        key, n = runs(key)
        found.append(Counts(key // size, key % size, n, coded.dictionary, totals))
    if len(found) == 1:
        return found[0]
    together = pa.table({"term": pa.concat_arrays([f.names.take(pa.array(f.code)) for f in found]), "n": np.concatenate([f.n for f in found])}).group_by("term").aggregate([("n", "sum")])
    size = together.num_rows
    return Counts(np.zeros(size, np.int64), np.arange(size), together["n_sum"].to_numpy(), together["term"].combine_chunks(), totals)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key)))


def grouped(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, how often each occurs, and the sums of the values over each."""
    order = np.argsort(key, kind="stable")
    distinct, n = runs(key[order])
    first = np.cumsum(n) - n
    return distinct, n, *(np.add.reduceat(v[order], first) if len(first) else np.zeros(0, np.int64) for v in values)
