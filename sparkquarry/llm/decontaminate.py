"""Benchmark decontamination: Wu-Manber multi-pattern search over word sequences.

Patterns are the WINDOW-word windows of the benchmark items (an item of fewer words is one pattern).
For the patterns of one length m, a shift table over blocks of two words says how far the search may
jump when a block stands at the end of the current window; a shift of 0 leads to the bucket of
patterns that end in that block, and the words themselves are compared. Many cursors, one for each
stretch of the slice's words, take their jumps together as numpy arrays.

The benchmark is read in parts of at most PART_BYTES of text, each one broadcast and searched for in
all documents; results of several parts are merged by document. So what is broadcast is bounded
whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.store import Shelf

WINDOW = 10
PART_BYTES = 8 << 20
SHIFT_BITS = 18
STRETCH = 512


def _words(buf: np.ndarray, w: K.Words, a: int, b: int) -> bytes:
    """Words a to b, lower-cased and joined by one space (no word holds a space)."""
    raw = K.LOWER[buf[w.s[a] : w.e[b - 1]]].tobytes()
    s = w.s[a]
    return b" ".join([raw[i - s : j - s] for i, j in zip(w.s[a:b].tolist(), w.e[a:b].tolist())])


def _blocks(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of the block that ends at each word; for one-word patterns a block is one word."""
    if m == 1:
        return h
    out = np.zeros(len(h), np.uint64)
    out[1:] = K.mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
    return out


class Patterns:
    """The patterns of one length, ready for search."""

    def __init__(self, m: int, found: dict[bytes, tuple[np.ndarray, set]]):
        self.m = m
        block = 1 if m == 1 else 2
        self.shift = np.full(1 << SHIFT_BITS, m - block + 1, np.uint8)
        self.bucket: dict[int, dict[bytes, frozenset]] = {}
        for text, (h, items) in found.items():
            b = _blocks(h, m)
            for end in range(block - 1, m):
                slot = int(b[end]) & ((1 << SHIFT_BITS) - 1)
                self.shift[slot] = min(self.shift[slot], m - 1 - end)
            self.bucket.setdefault(int(b[-1]), {})[text] = frozenset(items)
        self.suffixes = np.array(sorted(self.bucket), np.uint64)

    def search(self, buf: np.ndarray, w: K.Words):
        """(first word, items) of each occurrence inside a document."""
        n, m = len(w.h), self.m
        if n < m:
            return
        block = _blocks(w.h, m)
        slot = (block & np.uint64((1 << SHIFT_BITS) - 1)).astype(np.int32)
        begin = np.repeat(w.first[:-1], w.counts)
        at = np.arange(m - 1, n, STRETCH)
        stop = np.minimum(at + STRETCH, n)
        hits = []
        while len(at):
            jump = self.shift[slot[at]]
            zero = jump == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(jump, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        if not hits:
            return
        ends = np.concatenate(hits)
        ends = ends[ends - m + 1 >= begin[ends]]
        if len(self.suffixes):
            k = np.minimum(np.searchsorted(self.suffixes, block[ends]), len(self.suffixes) - 1)
            ends = ends[self.suffixes[k] == block[ends]]
        for end in ends.tolist():
            if items := self.bucket[int(block[end])].get(_words(buf, w, end - m + 1, end + 1)):
                yield end - m + 1, items


def compile_patterns(items: list[tuple[int, str | None]], window: int = WINDOW) -> list[Patterns]:
    """Of (item_id, text) rows; null ids and texts without words give no pattern."""
    by_length: dict[int, dict] = {}
    items = [(i, t) for i, t in items if i is not None and t]
    if not items:
        return []
    buf, offs = K.flat(pa.array([t for _, t in items], pa.large_string()))
    w = K.tokenize(buf, offs, K.ALNUM_WORDS)
    for k, (item, _) in enumerate(items):
        a, b = int(w.first[k]), int(w.first[k + 1])
        m = min(window, b - a)
        for start in range(a, b - m + 1) if m else ():
            found = by_length.setdefault(m, {})
            found.setdefault(_words(buf, w, start, start + m), (w.h[start : start + m].copy(), set()))[1].add(item)
    return [Patterns(m, found) for m, found in sorted(by_length.items())]


def scan(patterns: list[Patterns], buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[list]]:
    """Words of each document, the hit word numbers, the sorted item_ids."""
    w = K.tokenize(buf, offs, K.ALNUM_WORDS)
    edge = np.zeros(len(w.h) + 1, np.int64)
    doc_of: dict[int, set] = {}
    docs = None
    for p in patterns:
        for start, items in p.search(buf, w):
            edge[start] += 1
            edge[start + p.m] -= 1
            docs = w.doc if docs is None else docs
            doc_of.setdefault(int(docs[start]), set()).update(items)
    n_docs = len(w.counts)
    hit = np.cumsum(edge[:-1]) > 0 if doc_of else None
    where = [np.flatnonzero(hit[w.first[d] : w.first[d + 1]]) if d in doc_of else () for d in range(n_docs)]
    return w.counts, where, [sorted(doc_of.get(d, ())) for d in range(n_docs)]


def hit_documents(patterns: list[Patterns], buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """bool for each document: whether any pattern occurs in it. Keeps no places."""
    w = K.tokenize(buf, offs, K.ALNUM_WORDS)
    out = np.zeros(len(offs) - 1, bool)
    for p in patterns:
        for start, _ in p.search(buf, w):
            out[np.searchsorted(w.first, start, "right") - 1] = True
    return out


def _parts(benchmark: DataFrame):
    """The benchmark's rows in lists of at most PART_BYTES of text (or one row); one list at a time is on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= PART_BYTES:
        yield [tuple(r) for r in rows.collect()]
        return
    held, size = [], 0
    for r in rows.toLocalIterator():
        n = len((r[1] or "").encode())
        if held and size + n > PART_BYTES:
            yield held
            held, size = [], 0
        held.append(tuple(r))
        size += n
    yield held


def _digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def _of_part(docs: DataFrame, items: list, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(compile_patterns(items, window))

    def make():
        patterns = shared.value

        def kernel(buf, offs, part):
            n, where, found = scan(patterns, buf, offs)
            return {"doc_id": part.column("doc_id"), "row": part.column("row"), "n_words": n, "hits": pa.array([list(map(int, x)) for x in where], pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.int64()))}

        return kernel

    return K.map_text(docs, make, "doc_id long, row string, n_words long, hits array<int>, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs.

    Null and empty texts have no words and no hits. Items that are null, empty or without words
    match nothing; items with equal texts all count; repeated items count once by item_id. Repeated
    document rows each get their own result. Long texts are searched whole, a slice or one text at a
    time. Columns other than doc_id, item_id and text are not looked at. An empty benchmark leaves
    every document clean, an empty table of documents gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit("").alias("row"))
    parts = _parts(benchmark)
    first = next(parts, [])
    second = next(parts, None)
    if second is None:
        out = _of_part(docs, first, window)
    else:
        # Rows are merged by id and text digest, so that rows sharing a doc_id stay apart; equal rows are told apart by their count.
        shelf = Shelf(docs.sparkSession, "decontaminate")
        keyed = docs.withColumn("row", F.sha2(F.coalesce("text", F.lit("")), 256))
        count = keyed.groupBy("doc_id", "row").agg(F.count("*").alias("copies"))
        once = shelf.put("once", keyed.dropDuplicates(["doc_id", "row"]))
        found = None
        k = 0
        while first is not None:
            part = shelf.put(f"part_{k}", _of_part(once, first, window))
            found = part if found is None else found.unionByName(part)
            first, second, k = second, next(parts, None), k + 1
        merged = found.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        same = merged.doc_id.eqNullSafe(count.doc_id) & (merged.row == count.row)
        out = merged.join(count, same).select(merged.doc_id, "n_words", "hits", "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a hit, with all their columns.

    Null and empty texts have no hit and stay. Repeated rows stay or go together, whatever their
    doc_id; long texts are searched whole. Columns may have any other names. An empty benchmark keeps
    all rows, an empty table gives an empty result.
    """
    flag, text = K.free_name(docs, "contaminated"), K.free_name(docs, "searched_text")
    out = docs.withColumn(flag, F.lit(False))
    schema, columns = out.schema, docs.columns
    for items in _parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(compile_patterns(items, window))

        def make(shared=shared):
            patterns = shared.value

            def kernel(buf, offs, part):
                return {c: part.column(c) for c in columns} | {flag: pa.array(hit_documents(patterns, buf, offs))}

            return kernel

        out = K.map_text(out.withColumn(text, F.coalesce("text", F.lit(""))), make, schema, text=text).filter(~F.col(flag))
    return out.drop(flag)


def brute_force(docs: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> pd.DataFrame:
    """The same by plain comparison at every position, for tests."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    out = []
    for doc_id, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in benchmark:
            p = words(t)
            m = min(window, len(p))
            for x in range(len(p) - m + 1) if m else ():
                for i in range(len(w) - m + 1):
                    if w[i : i + m] == p[x : x + m]:
                        hit.update(range(i, i + m))
                        items.add(item)
        out.append((doc_id, len(w), len(hit), len(items), _digest(list(items)), bool(hit)))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM p),
pos AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)
), occ AS (SELECT doc_id, i, pos.m, item_id FROM pos JOIN p ON p.m = pos.m AND p.t = pos.t),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM occ) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
