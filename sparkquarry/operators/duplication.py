"""Duplicate clusters over blocks(block_id, file_path, content)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.functions.rules import above, six
from sparkquarry.store import Shelf, bound_batches

#: Tokens that are put in order of their counts, at most (a list on the driver and in each task).
ORDERED = 1 << 20
#: Sets, and bytes of sets or sketches, of which two such parts are compared with each other at once; pairs whose sketches are compared at once, about.
CELL, CELL_BYTES, SKETCHED = 512, 4 << 20, 500_000
#: Contents of a structural cluster from which on it is first compared in disjoint pairs.
MATCHED = 8

# Fixed value: what makes up the structure of a text, keywords (not inside words of ASCII letters) and brackets.
SKELETON = r"(?<![A-Za-z0-9_])(?:if|else|for|while|function|class|return|var|let|const)(?![A-Za-z0-9_])|[{}\[\]();,.]"


def skeleton(content: str = "content"):
    return F.md5(F.array_join(F.regexp_extract_all(content, F.lit(SKELETON), F.lit(0)), ""))


def exact_clusters(blocks: DataFrame) -> DataFrame:
    """Blocks equal but for blanks and tabs, in groups of two or more. Texts meet by digest, so only digests are shuffled."""
    key = F.sha2(F.regexp_replace("content", "[ \t]", ""), 256)
    lines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1
    out = blocks.filter("content is not null").groupBy(key.alias("cluster")).agg(F.count("*").alias("n"), F.min("block_id").alias("first_block"), F.min(lines).cast("long").alias("lines"), F.count_distinct("file_path").alias("n_files")).filter("n > 1")
    out = out.withColumn("burden", six(F.col("n") * F.col("lines") * 0.9))
    return out.withColumn("priority", above(F.col("burden"), (100, "critical"), (50, "high"), (20, "medium"), default="low"))


def members(blocks: DataFrame, clusters: DataFrame) -> DataFrame:
    key = F.sha2(F.regexp_replace("content", "[ \t]", ""), 256)
    return blocks.filter("content is not null").select("block_id", "file_path", key.alias("cluster")).join(clusters, "cluster")


def structural_clusters(blocks: DataFrame) -> DataFrame:
    """Blocks of one skeleton digest."""
    key = skeleton()
    return blocks.filter("content is not null").groupBy(key.alias("skeleton")).agg(F.count("*").alias("n"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block")).filter("n > 1")


def _dealt_pairs(rows: DataFrame, order: str, block: int = 64, parts: int | None = None) -> DataFrame:
    """All pairs (a, b: structs of the row) of the rows of one skeleton, a before b by order, unique in it; large skeletons are dealt in blocks, every two of which meet in a group of their own."""
    size = rows.groupBy("skeleton").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    part = rows.join(size, "skeleton").withColumn("at", F.pmod(F.xxhash64(order), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = part.select("skeleton", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", F.struct(*rows.columns).alias("row"))
    if parts:
        part = part.repartition(parts, "skeleton", "i", "j")
    a, b = part.withColumnsRenamed({"row": "a", "at": "at_a"}), part.withColumnsRenamed({"row": "b", "at": "at_b"})
    both = a.join(b, ["skeleton", "i", "j"]).filter((F.col(f"a.{order}") < F.col(f"b.{order}")) & ((F.col("i") == F.col("j")) | (F.col("at_a") != F.col("at_b"))))
    return both.select("skeleton", "a", "b")


def _few_edits(a: list[bytes], b: list[bytes], most: np.ndarray) -> np.ndarray:
    """The Levenshtein distances of pairs, where they are `most` at most, else -1: how far each diagonal of the table is reached with so many edits, all pairs at once."""
    place, start, end = {}, [], 0
    for x in (*a, *b):
        if x not in place:
            place[x] = end
            end += len(x)
        start.append(place[x])
    raw = np.frombuffer(b"".join(place) + bytes(8), np.uint8)
    word = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view("<u8").ravel()  # the 8 bytes from each place on
    at_a, at_b = np.array(start[: len(a)]), np.array(start[len(a) :])
    len_a, len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    top, out, open_ = int(most.max(initial=0)), np.full(len(a), -1, np.int64), np.arange(len(a))
    reach = np.full((len(a), 2 * top + 3), -2, np.int64)  # column k + top + 1: diagonal k
    for e in range(top + 1):
        if not (ok := most[open_] >= e).all():
            open_, reach = open_[ok], reach[ok]
        if not len(open_):
            break
        k, x, y = np.arange(-e, e + 1), top + 1 - e, top + 2 + e
        i = np.maximum(np.maximum(reach[:, x:y] + 1, reach[:, x - 1 : y - 1]), reach[:, x + 1 : y + 1] + 1) if e else np.zeros((len(open_), 1), np.int64)
        n, m = len_a[open_], len_b[open_]
        i = np.minimum(np.minimum(i, n[:, None]), m[:, None] - k)
        i[(i < 0) | (i + k < 0)] = -2
        row, column = np.nonzero(i >= 0)
        p = i[row, column]
        q = p + k[column]
        rest, far = np.minimum(n[row] - p, m[row] - q), np.zeros(len(p), np.int64)
        p, q, on = p + at_a[open_][row], q + at_b[open_][row], np.flatnonzero(rest > 0)
        while len(on):
            d = word[p[on] + far[on]] ^ word[q[on] + far[on]]
            same = np.where(d == 0, 8, np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) >> 3)
            far[on] = np.minimum(far[on] + same, rest[on])
            on = on[(same == 8) & (far[on] < rest[on])]
        i[row, column] += far
        reach[:, x:y] = i
        goal = m - n
        done = (np.abs(goal) <= e) & (reach[np.arange(len(open_)), np.clip(goal, -e, e) + top + 1] == n)
        out[open_[done]] = e
        if done.any():
            open_, reach = open_[~done], reach[~done]
    return out


def distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The Levenshtein distances of pairs: by diagonals while these take a fraction of the time that the table takes, else one by one."""
    n = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b)), np.int64, len(a))
    most = (2.5 * np.sqrt(n * (1 + n / 4000))).astype(np.int64)
    out, order, x = np.empty(len(a), np.int64), np.argsort(n, kind="stable"), 0
    while x < len(order):  # pairs of like lengths, in few bytes
        y = x + 1
        while y < len(order) and (y + 1 - x) * 2 * most[order[y]] <= 1 << 19 and (y + 1 - x) * 2 * n[order[y]] <= 4 << 20:
            y += 1
        of = order[x:y]
        out[of] = _few_edits([a[k] for k in of], [b[k] for k in of], most[of])
        x = y
    for k in np.flatnonzero(out < 0):
        out[k] = levenshtein(a[k], b[k])
    return out


def levenshtein(a: bytes, b: bytes) -> int:
    """The Levenshtein distance; a column of its table is two bit vectors (Myers), so a step takes a few operations on whole numbers."""
    n, lo = min(len(a), len(b)), 0
    while lo < n and a[lo] == b[lo]:  # common start
        step = 1
        while lo + step <= n and a[lo : lo + step] == b[lo : lo + step]:
            lo, step = lo + step, 2 * step
    a, b = a[lo:], b[lo:]
    n, end = min(len(a), len(b)), 0
    while end < n and a[-1 - end] == b[-1 - end]:  # common end
        step = 1
        while end + step <= n and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
            end, step = end + step, 2 * step
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) or len(b)
    holds = dict.fromkeys(a)
    for c in holds:
        # Bit k: a[k] is c.
        holds[c] = int(a[::-1].translate(bytes(48 + (x == c) for x in range(256))), 2)
    mask, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = holds.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (mask & ~(diagonal | up)), diagonal & up
        if more & high:
            score += 1
        elif less & high:
            score -= 1
        more, less = (more << 1) | 1, less << 1
        up, down = mask & (less | ~(diagonal | more)), mask & more & diagonal
    return score


def distance():
    """distances as a function of two binary columns, without nulls."""

    @F.pandas_udf("long")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(distances([bytes(x) for x in a], [bytes(y) for y in b]))

    return of


def similar_clusters(blocks: DataFrame, least: float = 0.85) -> DataFrame:
    """Structural clusters whose mean pairwise similarity (1 - Levenshtein distance / longer length, in bytes) is at least `least`.

    Equal contents are compared once and count as often as they occur. A pair is at most as similar
    as its lengths allow; clusters that these bounds rule out are not compared. Of the others those of
    MATCHED contents or more are first compared in disjoint pairs, one for every two contents:
    2d / (length + length + d) of a distance d is a metric and at most the dissimilarity, so the sums
    of it from both ends of a pair to all members are together at least the members times its value, and half
    of that over all pairs bounds the sum for the cluster from below. This rules out clusters of
    unlike contents in linear time. Contents are cut up and hashed once; those to compare are fetched
    by one block each. Pairs are dealt over fixed partitions, as few bytes of them are much work.
    """
    shelf = Shelf(blocks.sparkSession, "similar")
    key = skeleton()
    rows = blocks.filter("content is not null").select(key.alias("skeleton"), F.sha2("content", 256).alias("digest"), "block_id", F.octet_length("content").alias("size"))
    kinds = shelf.put("kinds", rows.groupBy("skeleton", "digest").agg(F.count("*").alias("copies"), F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block"), F.first("size").alias("size")))
    half = lambda n: n * (n - 1) / 2
    found = kinds.groupBy("skeleton").agg(F.sum("copies").alias("n"), F.count("*").alias("kinds"), F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"), F.sum(half(F.col("copies"))).alias("same")).filter("n > 1")
    found = shelf.put("clusters", found)
    pairs_of = half(F.col("n"))
    # Bounds by lengths: contents of one length count as alike, of others as the shorter over the longer.
    lengths = kinds.join(found.filter("kinds > 1"), "skeleton", "left_semi").groupBy("skeleton", "size").agg(F.sum("copies").alias("copies"))
    shorter = F.coalesce(F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("skeleton").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    apart = F.when(F.col("size") > 0, F.col("copies") * shorter / F.col("size")).otherwise(0.0)
    alike = lengths.select("skeleton", (half(F.col("copies")) + apart).alias("alike")).groupBy("skeleton").agg(F.sum("alike").alias("alike"))
    open_ = found.filter("kinds > 1").join(alike, "skeleton").filter(F.col("alike") / pairs_of >= least - 1e-9).select("skeleton", "n", "kinds")
    wanted = kinds.join(open_, "skeleton").select("skeleton", "n", "kinds", "digest", "copies", "size", "first_block", F.row_number().over(Window.partitionBy("skeleton").orderBy(F.desc("copies"), "digest")).alias("at"))
    texts = blocks.filter("content is not null").join(wanted, F.col("block_id").eqNullSafe(F.col("first_block"))).filter(F.sha2("content", 256) == F.col("digest"))
    once = ("n", "kinds", "copies", "size", "at")
    texts = shelf.put("texts", texts.groupBy("skeleton", "digest").agg(*(F.first(c).alias(c) for c in once), F.first(F.encode("content", "UTF-8")).alias("bytes")), 16 << 20)
    session = blocks.sparkSession
    bound_batches(session)
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 16 * session.sparkContext.defaultParallelism)
    two = texts.filter(F.col("kinds") >= MATCHED).select("skeleton", "n", F.expr("(at + 1) div 2").alias("two"), F.struct("copies", "size", "bytes").alias("row")).repartition(max(1, parts // 4), "skeleton", "two")
    two = two.groupBy("skeleton", "two").agg(F.first("n").alias("n"), F.collect_list("row").alias("rows")).filter("size(rows) = 2").select("skeleton", "n", F.col("rows")[0].alias("a"), F.col("rows")[1].alias("b"))
    two = two.withColumn("d", distance()("a.bytes", "b.bytes"))
    bound = F.sum(F.least("a.copies", "b.copies") * 2 * F.col("d") / (F.col("a.size") + F.col("b.size") + F.col("d")))
    unlike = two.groupBy("skeleton", "n").agg((bound * F.col("n") / 2).alias("bound")).filter(F.col("bound") / pairs_of > 1 - least + 1e-6)
    live = texts.join(shelf.put("unlike", unlike.select("skeleton")), "skeleton", "left_anti").select("skeleton", "digest", "copies", "size", "bytes")
    similarity = 1 - distance()("a.bytes", "b.bytes") / F.greatest("a.size", "b.size")
    weight = F.col("a.copies") * F.col("b.copies")
    sums = _dealt_pairs(live, "digest", 16, parts).groupBy("skeleton").agg(F.sum(weight * similarity).alias("unlike"))
    out = found.filter("kinds = 1").withColumn("unlike", F.lit(0.0)).unionByName(found.filter("kinds > 1").join(sums, "skeleton"))
    mean = (F.col("same") + F.col("unlike")) / pairs_of
    return out.filter(mean >= least).select("skeleton", "n", "first_block", "last_block", six(mean).alias("similarity"))


def cross_file_pairs(found: DataFrame) -> DataFrame:
    """File pairs by shared clusters; a cluster has as many rows here as files, which are few."""
    per = found.groupBy("cluster", "file_path").agg(F.count("*").alias("own"), F.first("lines").alias("lines"))
    a, b = per.select("cluster", F.col("file_path").alias("file_a"), "lines"), per.select("cluster", F.col("file_path").alias("file_b"))
    return a.join(b, "cluster").filter("file_a < file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("n_clusters"), F.sum("lines").alias("shared_lines"))


def file_hotspots(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Duplicated lines of each file against all its lines."""
    lines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + 1
    total = blocks.filter("content is not null").groupBy("file_path").agg(F.sum(lines).alias("total"))
    dup = found.groupBy("file_path").agg(F.sum("lines").alias("duplicated"), F.count_if(F.col("n_files") > 1).alias("n_external"))
    out = total.join(dup, "file_path", "left").fillna(0, ["duplicated", "n_external"])
    ratio = F.col("duplicated") / F.col("total")
    return out.withColumn("hotspot", six(100 * ratio)).withColumn("priority", above(ratio, (0.3, "critical"), (0.2, "high"), (0.1, "medium"), default="low"))


def _vocabulary(rows: DataFrame, shelf: Shelf) -> tuple[int, DataFrame]:
    """A seed for which no two tokens of rows (tokens) have one hash, told by a second hash, and (token, often) by that hash."""
    seed = 0
    while True:
        t = F.explode("tokens").alias("t")
        v = rows.select(t).select(F.xxhash64("t", F.lit(seed)).alias("token"), F.xxhash64(F.lit(-1 - seed), "t").alias("other"))
        v = shelf.put(f"vocabulary_{seed}", v.groupBy("token").agg(F.count("*").alias("often"), (F.min("other") != F.max("other")).alias("shared")))
        if v.filter("shared").isEmpty():
            return seed, v.select("token", "often")
        seed += 1


def _frequent(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the highest counts, sorted, and their places from 1 by count: ORDERED at most, whole counts only. The others come before them, in order of hash."""
    steps, total, least = vocabulary.groupBy("often").agg(F.count("*").alias("n")).orderBy(F.desc("often")), 0, None
    for r in steps.toLocalIterator():
        total += r.n
        if total > ORDERED:
            break
        least = r.often
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = vocabulary.filter(F.col("often") >= least).toArrow()
    token, often = t["token"].to_numpy(), t["often"].to_numpy()
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, often))] = np.arange(1, len(token) + 1)
    at = np.argsort(token)
    return token[at], place[at]


def _prefixes(sets: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """token, k, size, at, before, before2: the first tokens of each set in the common order, one of which two similar sets share, each with the two ahead of it (0: none)."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        known, place = shared.value
        for batch in batches:
            h = batch.column("h")
            n = pc.list_value_length(h).to_numpy().astype(np.int64)
            token = h.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            at = np.searchsorted(known, token)
            at[at == len(known)] = 0
            rank = np.where(known[at] == token, place[at], 0) if len(known) else np.zeros(len(token), np.int64)
            token = token[np.lexsort((token, rank, row))]
            pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            before, before2 = np.where(pos > 0, np.roll(token, 1), 0), np.where(pos > 1, np.roll(token, 2), 0)
            keep = pos < np.repeat(n + (-n * percent) // 100 + 1, n)
            k = batch.column("k").to_numpy()
            for x in range(0, len(k), 1 << 10):  # few rows at once
                part = np.flatnonzero(keep[(first := int(n[:x].sum())) : first + int(n[x : x + (1 << 10)].sum())]) + first
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token[part], k[row[part]], n[row[part]].astype(np.int32), pos[part].astype(np.int32), before[part], before2[part])], ["token", "k", "size", "at", "before", "before2"])

    return sets.select("k", "h").mapInArrow(run, "token long, k long, size int, at int, before long, before2 long")


def _sketched(sets: DataFrame) -> DataFrame:
    """sets with the parities of their tokens, a power of two of them, 512 at least and one for each token: two sets differ in as many tokens as their parities at least."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    def run(batches):
        for batch in batches:
            h = batch.column("h")
            n = pc.list_value_length(h).to_numpy().astype(np.int64)
            token, end = h.flatten().to_numpy(), np.cumsum(n)
            bits = 1 << np.ceil(np.log2(np.maximum(n, 512))).astype(np.int64)
            out = []
            x = 0
            while x < len(n):  # few rows of one width at once
                same = np.flatnonzero(bits[x:] != bits[x])
                y = min(x + max(1, (1 << 20) // int(bits[x])), x + int(same[0]) if len(same) else len(n))
                w = int(bits[x])
                row = np.repeat(np.arange(y - x), n[x:y])
                odd = np.bincount(row * w + (token[end[x] - n[x] : end[y - 1]] & (w - 1)), minlength=w * (y - x)) & 1
                packed = np.packbits(odd.astype(np.uint8)).tobytes()
                out += [packed[i : i + w // 8] for i in range(0, len(packed), w // 8)]
                x = y
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "sketch"])

    return sets.mapInArrow(run, StructType([*sets.schema.fields, StructField("sketch", BinaryType())]))


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches, of this many bytes or a multiple, as rows of so many: the parities of the tokens modulo fewer numbers."""
    out = np.empty((len(sketches), width), np.uint8)
    for k, x in enumerate(sketches):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sketches of their sets leave possible. Sketches are dealt in parts; every two parts meet in a group with the pairs between them, so no pair carries sketches."""
    total = sets.agg(F.sum(F.octet_length("sketch"))).first()[0] or 0
    n = max(1, -(-total // CELL_BYTES), math.isqrt(pairs.count() // SKETCHED))
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
    left = pairs.select(F.least(at("a"), at("b")).alias("i"), F.greatest(at("a"), at("b")).alias("j"), "a", "b")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    right = sets.select("k", "size", "sketch", at("k").alias("at"), other).select(F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "k", "size", "sketch")

    def run(left, right):
        k, size = right["k"].to_numpy(), right["size"].to_numpy().astype(np.int64)
        sketch = right["sketch"].to_pylist()
        width = np.fromiter((len(x) for x in sketch), np.int64, len(sketch))
        order = np.argsort(k)
        a, b = left["a"].to_numpy(), left["b"].to_numpy()
        x, y = (order[np.searchsorted(k, c, sorter=order)] for c in (a, b))
        keep = np.zeros(len(a), bool)
        narrow = np.minimum(width[x], width[y])
        for w in np.unique(narrow).tolist():
            of = np.flatnonzero(narrow == w)
            used = np.unique(np.concatenate([x[of], y[of]]))
            words = _folded([sketch[d] for d in used.tolist()], w)
            step = max(1, (1 << 22) // w)
            for part in (of[z : z + step] for z in range(0, len(of), step)):
                unlike = np.bitwise_count(words[np.searchsorted(used, x[part])] ^ words[np.searchsorted(used, y[part])]).sum(axis=1, dtype=np.int64)
                both = size[x[part]] + size[y[part]]
                keep[part] = (100 + percent) * (both - unlike) >= 2 * percent * both
        return pa.table({"a": a[keep], "b": b[keep]})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, "a long, b long")


def _cells(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """k, cell, part of the sets in pairs: those with one least partner (or that are it) are near each other and share a cell, parted by sets and bytes."""
    ends = pairs.select(F.col("a").alias("k"), F.col("a").alias("cell")).unionByName(pairs.select(F.col("b").alias("k"), F.col("a").alias("cell")))
    of = ends.groupBy("k").agg(F.min("cell").alias("cell")).join(sets.select("k", "size"), "k")
    parts = of.groupBy("cell").agg(F.ceil(F.greatest(F.count("*") / CELL, 8 * F.sum("size") / CELL_BYTES)).cast("int").alias("parts"))
    return of.join(parts, "cell").select("k", "cell", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"))


def _confirmed(work: DataFrame, id_type: str, percent: int) -> DataFrame:
    """a, b, copies_a, copies_b, shared, total of the pairs that are similar; a row of work holds pairs and the sets that they need."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                docs, pairs = batch.column("docs")[r].values, batch.column("pairs")[r].values
                k, h = docs.field("k").to_numpy(), docs.field("h")
                n = pc.list_value_length(h).to_numpy().astype(np.int64)
                names, code = np.unique(h.flatten().to_numpy(), return_inverse=True)
                end = np.cumsum(n)
                order = np.argsort(k)
                a, b = (order[np.searchsorted(k, pairs.field(c).to_numpy(), sorter=order)] for c in ("a", "b"))
                by = np.argsort(a, kind="stable")
                a, b = a[by], b[by]
                count, mark = np.zeros(len(a), np.int64), np.zeros(len(names), bool)
                cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]])).tolist()
                for x, y in zip(cuts, cuts[1:]):
                    own = code[end[a[x]] - n[a[x]] : end[a[x]]]
                    mark[own] = True
                    other = b[x:y]
                    count[x:y] = np.add.reduceat(mark[np.concatenate([code[end[d] - n[d] : end[d]] for d in other.tolist()])].astype(np.int64), np.cumsum(n[other]) - n[other])
                    mark[own] = False
                total = n[a] + n[b] - count
                good = 100 * count >= percent * total
                a, b = a[good], b[good]
                ids, copies = docs.field("block_id"), docs.field("copies")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), copies.take(pa.array(a)), copies.take(pa.array(b)), pa.array(count[good]), pa.array(total[good])], ["x", "y", "copies_x", "copies_y", "shared", "total"])

    found = work.select("docs", "pairs").mapInArrow(run, f"x {id_type}, y {id_type}, copies_x long, copies_y long, shared long, total long").filter("x <> y")
    first = F.col("x") < F.col("y")
    of = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    return found.select(of("x", "y").alias("a"), of("y", "x").alias("b"), of("copies_x", "copies_y").alias("copies_a"), of("copies_y", "copies_x").alias("copies_b"), "shared", "total")


def token_pairs(blocks: DataFrame, percent: int = 75) -> DataFrame:
    """a, b, copies_a, copies_b, jaccard: pairs of different token sets, of all files, with a Jaccard coefficient at or above percent.

    Blocks with equal sets are one class, named by its least id, so copies make no pairs; blocks
    without tokens are in none. Exact: two such sets share one of their rarest tokens (prefix
    filter); pairs are confirmed by the full sets. Tokens stand as hashes of 64 bits under a seed for
    which no two of the collection meet. Of the tokens that two prefixes share the first finds the pair;
    at a later one it is left out where one of the two tokens ahead is shared too, so near copies are
    not found once for each token. Sketches, as wide as the sets are large, rule out nearly all other
    pairs. Sets are sent to cells of sets that are near each other, and to every two such cells with
    pairs between them, not to each pair; so a set goes to few groups.
    """
    shelf = Shelf(blocks.sparkSession, "tokens")
    split = F.array_sort(F.array_distinct(F.filter(F.split("content", "[ \n]+"), lambda t: t != "")))
    rows = blocks.filter("content is not null and block_id is not null").select("block_id", split.alias("tokens")).filter("size(tokens) > 0")
    seed, vocabulary = _vocabulary(rows, shelf)
    hashed = rows.select("block_id", F.sha2(F.array_join("tokens", " "), 256).alias("digest"), F.transform("tokens", lambda t: F.xxhash64(t, F.lit(seed))).alias("h"))
    sets = hashed.groupBy("digest").agg(F.min("block_id").alias("block_id"), F.count("*").alias("copies"), F.first("h").alias("h"))
    sets = shelf.put("sets", _sketched(sets.select(F.monotonically_increasing_id().alias("k"), "block_id", "copies", F.size("h").alias("size"), "h")))
    prefix = _prefixes(sets, percent, _frequent(vocabulary))
    side = lambda k: prefix.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("k", "size", "at", "before", "before2")))
    # What may still be shared from the first shared token on must reach the overlap that percent asks for.
    need = F.ceil(percent * (F.col("size_a") + F.col("size_b")) / (100 + percent))
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    again = F.lit(False)
    for p in ("before_a", "before2_a"):
        again = again | ((F.col(p) != 0) & ((F.col(p) == F.col("before_b")) | (F.col(p) == F.col("before2_b"))))
    fit = (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & (rest >= need) & ~again
    met = side("a").join(side("b"), "token").filter((F.col("k_a") < F.col("k_b")) & fit)
    met = shelf.put("met", met.select(F.col("k_a").alias("a"), F.col("k_b").alias("b")).distinct())
    pairs = shelf.put("pairs", _alike(met, sets, percent))
    shelf.drop(f"vocabulary_{seed}", "met")
    cells = shelf.put("cells", _cells(pairs, sets))
    of = lambda k: cells.select(F.col("k").alias(k), F.struct("cell", "part").alias(f"of_{k}"))
    dealt = shelf.put("dealt", pairs.join(of("a"), "a").join(of("b"), "b").select(F.least("of_a", "of_b").alias("i"), F.greatest("of_a", "of_b").alias("j"), "a", "b"))
    key = ["i", "j"]
    needed = dealt.select(*key, F.explode(F.array("a", "b")).alias("k")).distinct().join(sets.select("k", "block_id", "copies", "h"), "k")
    docs = needed.groupBy(*key).agg(F.collect_list(F.struct("k", "block_id", "copies", "h")).alias("docs"))
    work = dealt.groupBy(*key).agg(F.collect_list(F.struct("a", "b")).alias("pairs")).join(docs, key)
    found = shelf.put("found", _confirmed(work, blocks.schema["block_id"].dataType.simpleString(), percent))
    shelf.drop("sets", "pairs", "cells", "dealt")
    return found.select("a", "b", "copies_a", "copies_b", six(F.col("shared") / F.col("total")).alias("jaccard"))


def consolidation(clusters: DataFrame) -> DataFrame:
    """cluster, hours (2 for each instance), saved_lines, roi of the clusters of critical and high priority."""
    hours = 2.0 * F.col("n")
    return clusters.filter(F.col("priority").isin("critical", "high")).select("cluster", hours.alias("hours"), (F.col("lines") * (F.col("n") - 1)).alias("saved_lines"), six(0.2 * F.col("burden") / hours).alias("roi"), F.when(F.col("n_files") > 1, "new_utility_file").otherwise("same_file").alias("target"))


def impact(clusters: DataFrame) -> DataFrame:
    """One row: clusters, instances, multiplier, debt and health above 50, 30, 15."""
    out = clusters.agg(F.count("*").alias("n_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_instances"), six(F.coalesce(F.sum("burden"), F.lit(0.0)) / 100).alias("debt"))
    out = out.withColumn("multiplier", F.when(F.col("n_clusters") > 0, six(F.col("n_instances") / F.col("n_clusters"))).otherwise(0.0))
    return out.withColumn("health", above(F.col("debt"), (50, "critical"), (30, "poor"), (15, "fair"), default="good"))
