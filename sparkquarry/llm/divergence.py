"""Source divergence audit: how the words of each source of a language differ from those of its other sources.

A baseline-correction inverted index. A kept term has a share p = 1 + floor(SCALE * (count + 1) / (N + V))
in each source, and a pair (own, other) of sources has the sum over all V kept terms of
f(p, q) = floor((p - q)^2 / q). Most terms occur in few sources, so each pair starts at V * f(a, b), where
a and b are the shares of a count of zero, and only postings correct it:

- a term that own holds adds f(p, b) - f(a, b), whatever other holds. This depends on p alone, so the
  postings of a source with one p are one row with their number, and meet each other source once;
- a term that other holds adds f(a, q) - f(a, b), the same with the roles changed;
- a term that both hold adds f(p, q) - f(p, b) - f(a, q) + f(a, b). Postings of a term are lists of at
  most BLOCK sources; two lists add up in a BLOCK x BLOCK matrix of the task, so no row is made for
  a pair in a posting, but one for a pair and task at the end.

All steps are sums of integers that are combined before each shuffle. A source with a third of all rows
only has larger counts; a term of every document has one posting for each source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.llm import terms as T
from sparkquarry.store import Shelf

SCALE, LEAST_DOCS, TOP, BLOCK = 1_000_000_000, 3, 200, 256
#: Entries that a task counts before it sends them; matrices that a task adds up before it sends them (half a MB each); salts of the join of shares with sources.
HELD, MATRICES, SALTS, PAIRS = 400_000, 64, 16, 1 << 20
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _of_slice(part: pa.RecordBatch) -> pa.Table:
    c = T.counts(*K.flat(part.column("text")), T.LETTER_WORDS)
    lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
    n_sources, n_terms = max(1, len(source.dictionary)), max(1, len(c.names))
    group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
    key, docs, n = T.grouped(group[c.doc] * n_terms + c.code, c.n)
    group, code = key // n_terms, key % n_terms
    return pa.table([lang.dictionary.take(pa.array(group // n_sources)), source.dictionary.take(pa.array(group % n_sources)), c.names.take(pa.array(code)).cast(pa.string()), n, docs], schema=_COUNTS)


def _together(held: list[pa.Table]) -> pa.Table:
    if len(held) == 1:
        return held[0]
    t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); null lang, source and text count as empty."""
    K.bound_batches(docs.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in K.slices(batch, "text"):
                held.append(_of_slice(part))
                size += held[-1].num_rows
                if size > HELD:
                    held = [_together(held)]
                    size = held[0].num_rows
                    if 2 * size > HELD:
                        yield from held[0].to_batches(max_chunksize=20_000)
                        held, size = [], 0
        if held:
            yield from _together(held).to_batches(max_chunksize=20_000)

    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, words: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (words + terms)), in decimals, as the product may pass 64 bits; null without terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    product = F.lit(SCALE).cast("decimal(10,0)") * whole(n + 1)
    return F.when(terms > 0, 1 + F.call_function("div", product, F.nullif(whole(words + terms), F.lit(0).cast("decimal(20,0)"))))


def gap(p: Column, q: Column) -> Column:
    """f(p, q); |p - q| is at most SCALE, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Starts, sizes and the fields of a list of structs."""
    offs = column.offsets.to_numpy().astype(np.int64)
    return offs[:-1], np.diff(offs), [column.values.field(k).to_numpy() for k in range(3)]


def _both_hold(pairs: DataFrame) -> DataFrame:
    """lang, own, other, value: the corrections of terms that both hold, summed in each task."""

    def flushed(acc):
        out = []
        for (lang, i, j), m in acc.items():
            at = np.flatnonzero(m)
            out.append(pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(i * BLOCK + at // BLOCK), pa.array(j * BLOCK + at % BLOCK), pa.array(m[at])], ["lang", "own", "other", "value"]))
        acc.clear()
        return out

    def run(batches):
        acc: dict = {}
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            i_block, j_block = (batch.column(c).to_numpy() for c in ("i", "j"))
            (at_a, n_a, a), (at_b, n_b, b) = _lists(batch.column("a")), _lists(batch.column("b"))
            ends = np.cumsum(n_a * n_b)
            begin = 0
            while begin < len(lang):
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
                of: dict = {}
                for r in range(begin, stop):
                    of.setdefault((lang[r], int(i_block[r]), int(j_block[r])), []).append(r)
                for (name, i, j), rows in of.items():
                    rows = np.array(rows)
                    each = n_a[rows] * n_b[rows]
                    row = np.repeat(rows, each)
                    k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
                    x, y = at_a[row] + k // n_b[row], at_b[row] + k % n_b[row]
                    if i == j:
                        x, y = x[(apart := a[0][x] != b[0][y])], y[apart]
                    (s, p, p0), (t, q, q0) = (f[x] for f in a), (f[y] for f in b)
                    for key, own, other, u, u0, v, v0 in ((i, j), s, t, p, p0, q, q0), ((j, i), t, s, q, q0, p, p0):
                        m = acc.setdefault((name, *key), np.zeros(BLOCK * BLOCK, np.int64))
                        np.add.at(m, own % BLOCK * BLOCK + other % BLOCK, _gap(u, v) - _gap(u, v0) - _gap(u0, v) + _gap(u0, v0))
                        if i == j:
                            break
                    if len(acc) > MATRICES:
                        yield from flushed(acc)
                begin = stop
        yield from flushed(acc)

    return pairs.mapInArrow(run, "lang string, own long, other long, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs (lang, source, text); other columns are ignored.

    Part `pair`: each other source of the language by value, the largest first; part `term`: the top
    terms that the source uses more than its language, by value; equal values by item. Null lang, source
    and text are empty strings; a source whose texts have no term is a source all the same (all counts
    zero). Without a kept term a language has pairs of value 0 and no terms. A row is a document,
    repeated ids and equal rows included; long texts are counted in parts. An empty table gives no row.
    """
    shelf = Shelf(docs.sparkSession, "divergence")
    of_term = Window.partitionBy("lang", "term")
    held = shelf.put("counts", term_counts(docs))
    post = held.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("in_docs"), F.count("*").over(of_term).alias("holders"), F.row_number().over(of_term.orderBy("source")).alias("nth"))
    post = shelf.put("post", post.filter(F.col("in_docs") >= least_docs).drop("in_docs"))
    shelf.drop("counts")
    sizes = post.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count_if(F.col("nth") == 1).alias("terms"))
    known = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = known.join(sizes, ["lang", "source"], "left").fillna(0, ["words", "terms"])
    langs = groups.groupBy("lang").agg(F.sum("words").alias("lang_words"), F.sum("terms").alias("v"))
    groups = groups.drop("terms").join(langs, "lang").withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    groups = shelf.put("groups", groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("words"), F.col("v"))))
    shares = post.join(groups, ["lang", "source"]).select("lang", "source", "number", "term", "holders", "zero", share(F.col("n"), F.col("words"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_words"), F.col("v")).alias("q"))
    shares = shelf.put("shares", shares)
    shelf.drop("post")

    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    ranked = ranked.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= top)

    g = groups.select("lang", "number", "zero", "v")
    other = g.select("lang", F.col("number").alias("other"), F.col("zero").alias("other_zero"))
    base = g.join(other, "lang").filter("number <> other").select("lang", F.col("number").alias("own"), "other", F.coalesce(F.col("v") * gap(F.col("zero"), F.col("other_zero")), F.lit(0).cast("long")).alias("value"))
    alike = shares.groupBy("lang", "number", "zero", "p").agg(F.count("*").alias("k")).withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int"))
    meet = alike.join(other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"]).filter("number <> other")
    p, a, b, k = (F.col(c) for c in ("p", "zero", "other_zero", "k"))
    single = meet.groupBy("lang", "number", "other").agg(F.sum(k * (gap(p, b) - gap(a, b))).alias("as_own"), F.sum(k * (gap(b, p) - gap(b, a))).alias("as_other"))
    single = single.select("lang", F.explode(F.array(F.struct(F.col("number").alias("own"), "other", F.col("as_own").alias("value")), F.struct(F.col("other").alias("own"), F.col("number").alias("other"), F.col("as_other").alias("value")))).alias("c")).select("lang", "c.*")
    lists = shares.filter("holders > 1").withColumn("block", F.floor(F.col("number") / BLOCK)).repartition("lang", "term").groupBy("lang", "term", "block").agg(F.collect_list(F.struct("number", "p", "zero")).alias("list"))
    left = lists.select("lang", "term", F.col("block").alias("i"), F.col("list").alias("a"))
    right = lists.select("lang", "term", F.col("block").alias("j"), F.col("list").alias("b"))
    both = _both_hold(left.join(right, ["lang", "term"]).filter("i <= j").select("lang", "i", "j", "a", "b"))
    value = base.unionByName(single).unionByName(both).groupBy("lang", "own", "other").agg(F.sum("value").alias("value"))
    own = groups.select("lang", F.col("number").alias("own"), "source")
    item = groups.select("lang", F.col("number").alias("other"), F.col("source").alias("item"))
    pairs = value.join(own, ["lang", "own"]).join(item, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(by_rank)).unionByName(ranked)


def op11_divergence_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v)::HUGEINT AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
words AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words) QUALIFY part = 'pair' OR rank <= 200
"""
