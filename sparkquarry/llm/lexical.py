"""Ranked lexical search over inverted treaps.

The index has one row for each shard of documents (at most SHARD_BYTES of text or SHARD_DOCS documents,
or one longer text): for each term of the shard a treap over its documents, a search tree by doc_id
(documents of a shard are numbered in that order) and a heap by impact, the part of the score that a
term gives to a document before its weight. Equal impacts are ordered by a hash of the document's
number, so that treaps have logarithmic depth. Every document is indexed whole.

A query walks the treaps of its terms in one shard together. A state is an interval of documents and,
for each term, the root of its treap cut to the interval; the weighted impacts of the roots add up to a
bound of all scores inside. A state whose bound is below the k-th best score found so far is dropped with
all its subtrees. From any other, the root of the largest weighted impact gives the next document: one
descent in each treap finds whether the document holds the term and cuts the treap in two, for the
intervals before and after it. States of the largest bounds go first, many together as numpy arrays.

Shards are rows, so neither index nor search shuffles postings, and a frequent term is dealt over all
shards by nature. Only the k best of each query and shard meet in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.llm import terms as T
from sparkquarry.store import Shelf

SHARD_BYTES, SHARD_DOCS = 4 << 20, 1 << 15
#: Row groups of the index; writer and reader hold one of them.
BLOCK_BYTES = 16 << 20
TOP = 50
#: Bytes of query texts that are searched for in one pass over the index; states that are opened together; queries walked together.
PART_BYTES, STEP, TOGETHER = 4 << 20, 2048, 8
_NONE = -1
_INDEX = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("impacts", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])
_INDEX_DDL = "doc_ids array<long>, terms array<string>, sizes array<int>, docs binary, impacts binary, left binary, right binary"


# --- treaps -----------------------------------------------------------------------------------


def _nearest(rank: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int) -> np.ndarray:
    """Of each entry, the nearest one before (step -1) or behind (step 1) of larger rank inside its own run; -1 if none.

    Each round every open entry jumps over what its candidate is known to be larger than, so distances double.
    """
    n = len(rank)
    near = np.arange(n) + step
    near[(near < begin) | (near >= end)] = _NONE
    open_ = np.flatnonzero(near >= 0)
    while len(open_):
        c = near[open_]
        open_, c = open_[(low := rank[c] < rank[open_])], c[low]
        near[open_] = near[c]
        open_ = open_[near[open_] >= 0]
    return near


def link(impact: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, right and root (numbers of entries, -1: none) of the treaps whose entries stand one run behind the other, each in order of doc."""
    n = len(impact)
    last = np.repeat(np.cumsum(sizes), sizes)
    first = last - np.repeat(sizes, sizes)
    tie = (K.mix(doc.astype(np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((doc, tie, impact))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before, behind = _nearest(rank, first, last, -1), _nearest(rank, first, last, 1)
    left, right = np.full(n, _NONE, np.int32), np.full(n, _NONE, np.int32)
    of_before = (before >= 0) & ((behind < 0) | (rank[before] < rank[behind]))
    of_behind = (behind >= 0) & ~of_before
    at = np.arange(n, dtype=np.int32)
    right[before[of_before]] = at[of_before]
    left[behind[of_behind]] = at[of_behind]
    root = at[(before < 0) & (behind < 0)]
    return left, right, root


# --- index ------------------------------------------------------------------------------------


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def make():
        def kernel(buf, offs, part):
            each = np.zeros(len(offs) - 1, np.int64)
            for piece, at in T.parts(buf, offs, K.ALNUM_WORDS):
                s, _ = K.spans_of(K.ALNUM_WORDS[piece], at)
                each += np.diff(np.searchsorted(s, at))
            return {"docs": np.array([(each > 0).sum()]), "words": np.array([each.sum()])}

        return kernel

    row = K.map_text(docs.select("text"), make, "docs long, words long").agg(F.sum("docs"), F.sum("words")).first()
    return row[0] or 0, row[1] or 0


def _shard(doc_ids: list, held: list[T.Counts], n_docs: int, n_words: int) -> pa.RecordBatch:
    names = pa.chunked_array([c.names for c in held]).combine_chunks().dictionary_encode()
    shift = np.cumsum([0, *(len(c.names) for c in held)])
    base = np.cumsum([0, *(len(c.totals) for c in held)])
    to_code = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.concatenate([to_code[c.code + a] for c, a in zip(held, shift)])
    doc = np.concatenate([c.doc + a for c, a in zip(held, base)])
    tf, total = np.concatenate([c.n for c in held]), np.concatenate([c.totals for c in held])
    # Documents are numbered in order of doc_id, those without one last.
    known = np.array([d is not None for d in doc_ids])
    order = np.lexsort((np.array([d or 0 for d in doc_ids], np.int64), ~known))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    norm = 50 + (50 * total * n_docs) // max(1, n_words)
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * norm[doc])
    doc = number[doc]
    at = np.argsort(code * len(order) + doc)
    code, doc, impact = code[at], doc[at], impact[at]
    _, sizes = T.runs(code)  # every name occurs
    left, right, _ = link(impact, doc, sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = lambda x: np.where(x < 0, 0xFFFF, x - first).astype("<u2").tobytes()
    columns = [[[doc_ids[i] for i in order.tolist()]], [names.dictionary.to_pylist()], [sizes.tolist()], [doc.astype("<u2").tobytes()], [impact.astype("<i4").tobytes()], [inside(left)], [inside(right)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX)], schema=_INDEX)


def build(docs: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """The index of docs (doc_id, text), one row for each shard. Null and empty texts have no terms and stand in no treap; repeated rows are documents of their own; long texts are counted in parts; other columns are ignored; an empty table gives no row."""
    K.bound_batches(docs.sparkSession)

    def run(batches):
        doc_ids, held, size = [], [], 0
        for batch in batches:
            for part in K.slices(batch, "text"):
                n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if doc_ids and (size + n > SHARD_BYTES or len(doc_ids) + part.num_rows > SHARD_DOCS):
                    yield _shard(doc_ids, held, n_docs, n_words)
                    doc_ids, held, size = [], [], 0
                held.append(T.counts(*K.flat(part.column("text")), K.ALNUM_WORDS))
                doc_ids += part.column("doc_id").to_pylist()
                size += n
        if doc_ids:
            yield _shard(doc_ids, held, n_docs, n_words)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''")
    return rows.mapInArrow(run, _INDEX_DDL)


def shelved(spark, index: DataFrame) -> DataFrame:
    """The index as a table. A task writes, and reads back, any number of shards but holds BLOCK_BYTES of them (or one shard) at a time."""
    return Shelf(spark, "treaps").put("index", index, BLOCK_BYTES)


# --- search -----------------------------------------------------------------------------------


class Shard:
    """One row of the index with the treaps of the asked terms only."""

    def __init__(self, row: dict, asked: list[str]):
        names, sizes = row["terms"], row["sizes"].astype(np.int64)
        at = pc.index_in(pa.array(asked, pa.string()), names)
        self.slot = {t: k for t, k in zip(asked, at.to_pylist()) if k is not None}
        chosen = np.array(sorted(self.slot.values()), np.int64)
        place = np.cumsum(sizes) - sizes
        size, begin = sizes[chosen], place[chosen]
        own = np.cumsum(size) - size
        take = np.arange(int(size.sum())) + np.repeat(begin - own, size)
        base = np.repeat(own, size)
        raw = lambda c, kind: np.frombuffer(row[c], kind)[take].astype(np.int64)
        self.doc, self.impact = raw("docs", "<u2"), raw("impacts", "<i4")
        left, right = raw("left", "<u2"), raw("right", "<u2")
        self.left, self.right = np.where(left == 0xFFFF, _NONE, left + base), np.where(right == 0xFFFF, _NONE, right + base)
        child = np.zeros(len(take), bool)
        for side in (self.left, self.right):
            child[side[side >= 0]] = True
        self.root = dict(zip(chosen.tolist(), np.flatnonzero(~child).tolist()))
        self.doc_ids = row["doc_ids"]
        self.n = len(self.doc_ids)


def _cut(s: Shard, node: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each treap, cut to documents lo to hi (excluded) with root node: the entry of document at, and the roots of what lies before and behind it; -1: none."""
    n = len(node)
    found, before, behind = np.full(n, _NONE), np.full(n, _NONE), np.full(n, _NONE)
    on = np.flatnonzero(node >= 0)
    cur = node[on]
    while len(on):
        x = s.doc[cur]
        low, high = x < at[on], x > at[on]
        first = low & (x >= lo[on]) & (before[on] < 0)
        before[on[first]] = cur[first]
        first = high & (x < hi[on]) & (behind[on] < 0)
        behind[on[first]] = cur[first]
        here = ~(low | high)
        found[on[here]] = cur[here]
        cur = np.where(low, s.right[cur], s.left[cur])
        go = (cur >= 0) & ~here
        on, cur = on[go], cur[go]
    # Where the document has an entry, the sides not met on the way hang below it.
    for side, best, outside, on_way in ((s.left, before, lambda x, i: x < lo[i], s.right), (s.right, behind, lambda x, i: x >= hi[i], s.left)):
        on = np.flatnonzero((found >= 0) & (best < 0))
        cur = side[found[on]]
        on, cur = on[cur >= 0], cur[cur >= 0]
        while len(on):
            out = outside(s.doc[cur], on)
            best[on[~out]] = cur[~out]
            on, cur = on[out], on_way[cur[out]]
            on, cur = on[cur >= 0], cur[cur >= 0]
    return found, before, behind


def top_of_shard(s: Shard, queries: list[list[tuple[str, int]]], k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query of (term, weight) the numbers and scores of its k best documents with a score above 0, equal scores by number. least: scores known to be reached k times elsewhere; documents below are left out."""
    out = []
    for a in range(0, len(queries), TOGETHER):
        out += _walk(s, queries[a : a + TOGETHER], k, None if least is None else least[a : a + TOGETHER])
    return out


def _walk(s: Shard, queries: list[list[tuple[str, int]]], k: int, least: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
    kept = [[(s.root[s.slot[t]], w) for t, w in q if t in s.slot and w > 0] for q in queries]
    width = max(1, *(len(q) for q in kept))
    root, weight = np.full((len(kept), width), _NONE), np.zeros((len(kept), width), np.int64)
    for i, q in enumerate(kept):
        for j, (r, w) in enumerate(q):
            root[i, j], weight[i, j] = r, w
    floor = np.ones(len(kept), np.int64) if least is None else np.maximum(1, least)
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in kept]
    # States: query, interval, roots, bound.
    q, lo, hi, node = np.arange(len(kept)), np.zeros(len(kept), np.int64), np.full(len(kept), s.n), root
    bound = np.where(node >= 0, s.impact[node] if len(s.impact) else 0, 0)
    bound = (bound * weight[q]).sum(1)
    pool = [(q, lo, hi, node, bound)]
    while pool:
        q, lo, hi, node, bound = (np.concatenate(c) for c in zip(*pool)) if len(pool) > 1 else pool[0]
        live = bound >= floor[q]
        if not live.all():
            q, lo, hi, node, bound = q[live], lo[live], hi[live], node[live], bound[live]
        if not len(q):
            break
        if len(q) > STEP:  # the largest bounds first
            split = np.argpartition(-bound, STEP)
            first, rest = split[:STEP], split[STEP:]
            pool = [(q[rest], lo[rest], hi[rest], node[rest], bound[rest])]
            q, lo, hi, node = q[first], lo[first], hi[first], node[first]
        else:
            pool = []
        value = np.where(node >= 0, s.impact[node], 0) * weight[q]
        rows = np.arange(len(q))
        at = s.doc[node[rows, value.argmax(1)]]
        wide = lambda x: np.repeat(x, width)
        found, before, behind = (x.reshape(len(q), width) for x in _cut(s, node.ravel(), wide(lo), wide(hi), wide(at)))
        score = (np.where(found >= 0, s.impact[found], 0) * weight[q]).sum(1)
        good = score >= floor[q]
        for i in np.flatnonzero(np.bincount(q[good], minlength=len(kept))).tolist():
            mine = good & (q == i)
            docs, scores = np.concatenate([best[i][0], at[mine]]), np.concatenate([best[i][1], score[mine]])
            order = np.lexsort((docs, -scores))[:k]
            best[i] = docs[order], scores[order]
            if len(order) == k:
                floor[i] = max(floor[i], int(scores[order[-1]]))
        for l, h, nodes in ((lo, at, before), (at + 1, hi, behind)):
            up = (np.where(nodes >= 0, s.impact[nodes], 0) * weight[q]).sum(1)
            live = up >= floor[q]
            if live.any():
                pool.append((q[live], l[live], h[live], nodes[live], up[live]))
    return best


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct, sorted) of items (item_id, text); rows of one item_id are one item; null ids, and texts without terms, are none."""
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))))
    rows = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), term.alias("term"))
    return rows.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _parts(asked: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in lists of at most PART_BYTES of terms (or one item); one list at a time is on the driver."""
    held, size = [], 0
    for r in asked.orderBy("item_id").toLocalIterator():
        n = sum(len(t) for t in r.terms) + 8
        if held and size + n > PART_BYTES:
            yield held
            held, size = [], 0
        held.append((r.item_id, list(r.terms)))
        size += n
    if held:
        yield held


def _row(batch: pa.RecordBatch, k: int) -> dict:
    one = lambda c: batch.column(c)[k]
    numbers = lambda c: one(c).values.to_numpy(zero_copy_only=False)
    return {"doc_ids": one("doc_ids").values, "terms": one("terms").values, "sizes": numbers("sizes")} | {c: one(c).as_buffer() for c in ("docs", "impacts", "left", "right")}


def frequencies(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """Documents that hold each of the terms."""
    asked = index.sparkSession.sparkContext.broadcast(sorted(terms))

    def run(batches):
        wanted = pa.array(asked.value, pa.string())
        for batch in batches:
            names, sizes = batch.column("terms").flatten(), batch.column("sizes").flatten()
            here = pc.is_in(names, value_set=wanted)
            yield pa.RecordBatch.from_arrays([names.filter(here), sizes.filter(here).cast(pa.int64())], ["term", "n"])

    return {r.term: r.n for r in index.select("terms", "sizes").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0.

    Equal scores are ranked by ascending doc_id, documents without one last; repeated rows rank one by
    one. Items without terms, or whose terms no document holds, have no row; an empty index or item
    table gives none. Terms that the collection lacks score 0.
    """
    spark = index.sparkSession
    K.bound_batches(spark)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for part in _parts(query_terms(items)):
        df = frequencies(index, list({t for _, terms in part for t in terms}))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        shared = spark.sparkContext.broadcast([(i, [(t, weight[t]) for t in terms if t in weight]) for i, terms in part])

        def run(batches, shared=shared):
            asked = sorted({t for _, terms in shared.value for t, _ in terms})
            ids, queries = [i for i, _ in shared.value], [terms for _, terms in shared.value]
            for batch in batches:
                for r in range(batch.num_rows):
                    s = Shard(_row(batch, r), asked)
                    best = top_of_shard(s, queries, k)
                    item = np.repeat(np.array(ids, np.int64), [len(d) for d, _ in best])
                    docs = np.concatenate([np.zeros(0, np.int64), *(d for d, _ in best)]).astype(np.int64)
                    scores = np.concatenate([np.zeros(0, np.int64), *(x for _, x in best)]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(item), s.doc_ids.take(pa.array(docs)), pa.array(scores)], ["item_id", "doc_id", "score"])

        found = found.unionByName(index.mapInArrow(run, "item_id long, doc_id long, score long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n_docs, n_words = statistics(docs)
    index = shelved(spark, build(docs, n_docs, n_words))
    return search(index, n_docs, items)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY 1),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words))))::BIGINT AS score FROM b JOIN w USING (term) JOIN tf USING (term), size GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""
