"""Near-duplicate detection: chosen-path set similarity join over minwise tokens.

Documents with equal shingle sets form one class first. Each class then enters the root of TREES
independent trees, where its minwise token under the tree's own hash function selects a child. A
node with at most SMALL classes is compared exhaustively, and so is one with few pairs of different
components (SMALL for each class at most). A larger one branches again: two further minwise tokens,
under hash functions that root and level pick, select two children for each class; where one child
holds all classes of its node, the other is not followed. Nodes whose classes already belong to one
component are done. A node of at most LOCAL classes is searched with all its descendants in one
task, depth first over arrays, so branching makes no rows; only larger nodes branch as rows of a
table, level by level. Where the classes of a node are so alike that branching would not part them
(the children's sizes tell their mean similarity: DENSE or more), and at LEVELS, the node is compared
in blocks that carry the full sets, so nothing is capped. Comparisons use EQUALS minwise tokens of
each class and let all pairs through that have a Jaccard coefficient of 0.75 with a chance over
1 - 1e-6; every pair let through is confirmed on the full sets. A pair at exactly 0.75 is missed by
all trees with a chance of about 1e-5 (a tree finds it with 0.75 * 0.9375 ** (level - 1)); at 0.8 it
is 1e-6.

Before the trees are searched, each class is compared with the class that most of its level-1 nodes
have as their centre: the member whose tokens are the most common ones. That settles large groups of
near copies with one comparison for each member; the search then only looks at pairs of different
components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm import kernels as K
from sparkquarry.operators.graph import connected_components
from sparkquarry.store import Shelf

WORDS, PERCENT = 5, 75
TREES, HASHES, LEVELS, SMALL = 12, 44, 5, 32
#: Tokens for comparisons, a byte each; as many are equal at least: 5 standard deviations below the mean at 0.75.
EQUALS, LEAST_EQUAL = 240, 146
#: Classes of a node that one task searches with all its descendants (some 0.5 KB each).
LOCAL = 8192
#: Mean similarity from which a node is compared in blocks; classes and shingles of a block.
DENSE, BLOCK, BLOCK_SHINGLES = 0.4, 1024, 1 << 20
#: Shingles of one matrix product in a block.
SLICE_SHINGLES = 1024
#: Pairs joined with one copy of a hot set.
HOT = 256

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, EQUALS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each document, and their offsets. Fewer words than a shingle has: the whole sequence is one."""
    w = K.tokenize(buf, offs, K.BLANK_WORDS)
    count = w.counts
    h, at = K.windows(w, words)
    doc = w.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        extra = np.array([K.fold(w.h[w.first[d] : w.first[d + 1]], int(count[d]))[0] for d in short], np.uint64)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    first = np.searchsorted(doc, np.arange(len(count) + 1))
    K.sort_within(h, first)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    total = np.zeros(len(h) + 1, np.int64)
    np.cumsum(new, out=total[1:])
    return h[new], total[first]


def _sketch():
    def kernel(buf, offs, part):
        u, first = shingles(buf, offs)
        n = np.diff(first)
        some = np.flatnonzero(n)
        d1, d2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        sig, low = np.zeros((len(n), HASHES), np.uint32), np.zeros((len(n), EQUALS), np.uint8)
        if len(some):
            at = first[some]
            d1[some] = np.add.reduceat(K.mix(u), at).view(np.int64)
            d2[some] = np.bitwise_xor.reduceat(K.mix(u ^ np.uint64(0xA5A5F00DBEEF1234)), at).view(np.int64)
            for k in range(EQUALS):
                least = np.minimum.reduceat(((u * _A[k]) >> np.uint64(32)).astype(np.uint32), at)
                low[some, k] = least & 255
                if k < HASHES:
                    sig[some, k] = least
        flat = np.hstack([sig.view(np.uint8).reshape(len(n), -1), low]).tobytes()
        step = 4 * HASHES + EQUALS
        return {"doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_shingles": n, "d1": d1, "d2": d2, "sig": pa.array([flat[i : i + step] for i in range(0, len(flat), step)], pa.binary())}

    return kernel


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, two digests of the shingle set, minwise tokens."""
    return K.map_text(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")), _sketch, "doc_id long, text_key long, n_shingles long, d1 long, d2 long, sig binary")


def _sets():
    def kernel(buf, offs, part):
        u, first = shingles(buf, offs)
        return {"cls": part.column("cls"), "shingle_set": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(u.view(np.int64)))}

    return kernel


def _sets_of(ids: DataFrame, docs: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """Sets of the classes ids (cls, rep_id, rep_key), each from the row of its representative."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep_id"), F.xxhash64("text").alias("rep_key"), "text").join(ids, ["rep_id", "rep_key"]).select("cls", "text")
    return shelf.put(f"{name}_sets", K.map_text(texts, _sets, "cls long, shingle_set array<long>"))


def _attach(pairs: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """pairs with the set of column key. A set that many pairs need is copied for each HOT of them, and the pairs are dealt over the copies."""
    other = "b" if key == "a" else "a"
    need = pairs.groupBy(key).agg(F.ceil(F.count("*") / HOT).alias("copies"))
    dealt = pairs.join(need, key).withColumn("salt", F.pmod(F.xxhash64(other), F.col("copies")))
    copies = sets.withColumnRenamed("cls", key).join(need, key).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(key, "salt", F.col("shingle_set").alias(f"set_{key}"))
    return dealt.join(copies, [key, "salt"]).drop("copies", "salt")


def _confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """Of the pairs (a, b) those that are similar on their full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = _sets_of(ids.join(reps.select("cls", "rep_id", "rep_key"), "cls"), docs, shelf, name)
    both = _attach(_attach(pairs, sets, "a"), sets, "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    links = both.withColumn("shared", shared).filter(100 * F.col("shared") >= PERCENT * (F.size("set_a") + F.size("set_b") - F.col("shared"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = shelf.put(f"{name}_links", links)
    shelf.drop(f"{name}_sets")
    return links


def _token(position) -> F.Column:
    return F.substring("sig", position * 4 + 1, 4)


def _shared(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets values[ends[i]:ends[i + 1]], by products of 0/1 matrices, a slice of the shingles at a time."""
    m = len(ends) - 1
    owner = np.repeat(np.arange(m), np.diff(ends))
    keys, inverse, count = np.unique(values[ends[0] : ends[-1]], return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1  # only shingles of two sets or more count
    on = count[inverse] > 1
    owner, column = owner[on], number[inverse[on]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, part = np.zeros((m, m), np.float32), np.empty((m, m), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, SLICE_SHINGLES):
        i, j = np.searchsorted(column, (a, a + SLICE_SHINGLES))
        x = np.zeros((m, SLICE_SHINGLES), np.float32)
        x[owner[i:j], column[i:j] - a] = 1
        out += np.matmul(x, x.T, out=part)
    return out


def _forest(link: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that connect what the symmetric link matrix connects, one for each row that is reached."""
    a, b, new = [], [], np.ones(len(link), bool)
    for start in range(len(link)):
        if not new[start]:
            continue
        new[start], front = False, [start]
        while front:
            x = front.pop()
            reached = np.flatnonzero(link[x] & new).tolist()
            new[reached] = False
            a += [x] * len(reached)
            b += reached
            front += reached
    return a, b


def _blocks(batches):
    """Links in each block: pairs of different components, by the sizes of the full sets' intersections, as many as connect what is similar."""
    for batch in batches:
        group = batch.column("members")
        for g in range(len(group)):
            rows = group.slice(g, 1).flatten()
            cls, label, n, side = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("cls", "label", "n", "side"))
            sets = rows.field("shingle_set")
            shared = _shared(sets.values.to_numpy(), sets.offsets.to_numpy())
            link = np.empty(shared.shape, bool)
            for i in range(len(cls)):
                both = shared[i].astype(np.int64)
                link[i] = (100 * both >= PERCENT * (n[i] + n - both)) & (label != label[i]) & ((side != side[i]) | (side[i] == 2))
            a, b = _forest(link)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(cls[a].astype(np.int64)), pa.array(cls[b].astype(np.int64))], names=["src", "dst"])


def _alike(at: np.ndarray, other: np.ndarray, label, n, low) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (at[k], other[k]) those of different components that the minwise tokens and the set sizes let through."""
    out = []
    for k in range(0, len(at), 1 << 14):
        i, j = at[k : k + (1 << 14)], other[k : k + (1 << 14)]
        on = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        i, j = i[on], j[on]
        on = (low[i] == low[j]).sum(1) >= LEAST_EQUAL
        out.append((i[on], j[on]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _pick(root: int, level: int) -> int:
    """The first of the two hash functions that part a node of this root at this level; no two levels of a path share one."""
    pairs = (HASHES - TREES) // 2
    return TREES + 2 * ((root + 5 * level) % pairs)


def _descend(root: int, level: int, cls, label, n, sig, low):
    """Candidate pairs (positions) below a node, and its leaves to be compared in blocks (arrays of positions)."""
    pairs, leaves, stack = [], [], [(level, np.arange(len(cls)))]
    while stack:
        level, at = stack.pop()
        m = len(at)
        of, inverse, count = np.unique(label[at], return_inverse=True, return_counts=True)
        if len(of) < 2:
            continue
        if m <= SMALL:
            i, j = np.triu_indices(m, 1)
            pairs.append(_alike(at[i], at[j], label, n, low))
            continue
        if m * m - int((count.astype(np.int64) ** 2).sum()) <= 2 * SMALL * m:
            main = inverse == count.argmax()
            few, many = at[~main], at[main]
            i, j = np.triu_indices(len(few), 1)
            pairs.append(_alike(np.concatenate([np.repeat(few, len(many)), few[i]]), np.concatenate([np.tile(many, len(few)), few[j]]), label, n, low))
            continue
        if level >= LEVELS:
            leaves.append(at)
            continue
        parts, pick = [], _pick(root, level)
        for token in (sig[at, pick], sig[at, pick + 1]):
            order = np.argsort(token, kind="stable")
            parts.append(np.split(at[order], np.flatnonzero(np.diff(token[order])) + 1))
        full = [x for part in parts if len(part) == 1 for x in part]
        if not full and sum(len(x) ** 2 for part in parts for x in part) >= DENSE * 2 * m * m:
            leaves.append(at)
            continue
        stack += [(level + 1, x) for x in (full[:1] or parts[0] + parts[1]) if len(x) > 1]
    return pairs, leaves


def _subtrees(batches):
    """Of each group of members the candidate pairs (0, a, b) and the rows (1, leaf, class) of its dense leaves, which are named by a digest of their classes."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[], [], []]
        groups = batch.column("members")
        for g in range(batch.num_rows):
            rows = groups.slice(g, 1).flatten()
            cls, label, n = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("cls", "label", "n"))
            raw = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint8).reshape(-1, 4 * HASHES + EQUALS)
            sig, low = np.ascontiguousarray(raw[:, : 4 * HASHES]).view(np.uint32), raw[:, 4 * HASHES :]
            pairs, leaves = _descend(batch.column("root")[g].as_py(), batch.column("level")[g].as_py(), cls, label, n, sig, low)
            for i, j in pairs:
                out[0].append(np.zeros(len(i), np.int64))
                out[1].append(np.minimum(cls[i], cls[j]))
                out[2].append(np.maximum(cls[i], cls[j]))
            for at in leaves:
                name = K.mix(cls[at].astype(np.uint64)).sum(dtype=np.uint64).astype(np.int64)
                out[0].append(np.ones(len(at), np.int64))
                out[1].append(np.full(len(at), name))
                out[2].append(cls[at])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["kind", "a", "b"])


def _search(members: DataFrame, labels: DataFrame, reps: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of different components from all trees; rows (node, cls) of the nodes to be compared in blocks."""

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of nodes that hold more than one component, with the node's size."""
        size = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").drop("lo", "hi")
        return rows.join(size, "node")

    rows = members.join(labels.withColumnRenamed("node", "cls").withColumnRenamed("component", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    rows = mixed(rows.withColumn("root", F.pmod("node", F.lit(1 << 20))))
    local, dense = [], []
    for level in range(1, LEVELS + 1):
        rows = shelf.put(f"level_{level}", rows)
        local.append(rows.filter(F.col("size") <= LOCAL).withColumn("level", F.lit(level)))
        rows = rows.filter(F.col("size") > LOCAL)
        if rows.isEmpty():
            break
        if level == LEVELS:
            dense.append(rows)
            break
        pick = TREES + 2 * F.pmod(F.col("root") + 5 * level, F.lit((HASHES - TREES) // 2)).cast("int")
        tokens = rows.join(reps.select("cls", "sig"), "cls")
        children = tokens.withColumn("child", F.explode(F.array(*(F.xxhash64("node", F.lit(j), _token(pick + j)) for j in (0, 1))))).drop("sig")
        counts = children.groupBy("node", "child").agg(F.count("*").alias("c"), F.first("size").alias("size"))
        shape = counts.groupBy("node").agg((F.sum(F.col("c") * F.col("c")) / (2.0 * F.first("size") * F.first("size"))).alias("alike"), F.max(F.when(F.col("c") == F.col("size"), F.col("child"))).alias("full"))
        shape = shelf.put(f"shape_{level}", shape.select("node", "full", (F.col("full").isNull() & (F.col("alike") >= DENSE)).alias("is_dense")))
        dense.append(rows.join(shape.filter("is_dense"), "node", "left_semi"))
        followed = children.join(shape.filter("not is_dense"), "node").filter("full is null or child = full")
        rows = mixed(followed.select("cls", F.col("child").alias("node"), "label", "root"))
    found = None
    for part in local:
        found = part if found is None else found.unionByName(part)
    wide = found.join(reps.select("cls", F.col("n_shingles").alias("n"), "sig"), "cls")
    groups = wide.groupBy("node", "level").agg(F.first("root").alias("root"), F.collect_list(F.struct("cls", "label", "n", "sig")).alias("members"))
    found = shelf.put("found", groups.select("root", "level", "members").mapInArrow(_subtrees, "kind long, a long, b long"))
    blocks = found.filter("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("cls")).distinct()
    for part in dense:
        blocks = blocks.unionByName(part.select("node", "cls"))
    return found.filter("kind = 0").select("a", "b").distinct(), blocks


def _in_blocks(rows: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, shelf: Shelf) -> DataFrame | None:
    """Links (src, dst) among the classes of each large node (node, cls).

    A block holds BLOCK classes or BLOCK_SHINGLES shingles; a node that fits is one block. Of larger
    ones, the classes of the largest component are not compared with each other; they are dealt over
    blocks, and meet the blocks of the other classes; of these every two blocks meet.
    """
    rows = shelf.put("dense", rows)
    if rows.isEmpty():
        return None
    rows = rows.join(labels.withColumnRenamed("node", "cls").withColumnRenamed("component", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls")).join(reps.select("cls", F.col("n_shingles").alias("n")), "cls")
    per_label = rows.groupBy("node", "label").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"))
    main = per_label.groupBy("node").agg(F.max(F.struct("c", "label", "shingles")).alias("main"), F.sum("c").alias("all_c"), F.sum("shingles").alias("all_s")).filter("main.c < all_c")
    parts = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES, F.lit(1.0)))
    fits = parts(F.col("all_c"), F.col("all_s")) == 1
    main = main.withColumn("main", F.when(fits, F.lit(None)).otherwise(F.col("main")))
    main = main.select("node", F.col("main.label").alias("main"), F.when(F.col("main").isNull(), 0).otherwise(parts(F.col("main.c"), F.col("main.shingles"))).alias("mains"), F.when(F.col("main").isNull(), 1).otherwise(parts(F.col("all_c") - F.col("main.c"), F.col("all_s") - F.col("main.shingles"))).alias("others"))
    inside = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    dealt = rows.join(main, "node").withColumn("own", F.pmod(F.xxhash64("cls"), F.when(inside, F.col("mains")).otherwise(F.col("others"))))
    # Blocks of other classes have the numbers from 0, those of the main component the negative ones.
    many = F.when(inside, F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).otherwise(F.sequence(-F.col("mains"), F.col("others") - 1))
    dealt = dealt.withColumn("own", F.when(inside, -1 - F.col("own")).otherwise(F.col("own"))).withColumn("to", F.explode(many))
    dealt = dealt.select("node", "cls", "label", "n", F.least("own", "to").alias("lo"), F.greatest("own", "to").alias("hi"), F.when(F.col("own") == F.col("to"), 2).when(F.col("own") < F.col("to"), 0).otherwise(1).alias("side"))
    sets = _sets_of(rows.select("cls").distinct().join(reps.select("cls", "rep_id", "rep_key"), "cls"), docs, shelf, "dense")
    groups = dealt.join(sets, "cls").groupBy("node", "lo", "hi").agg(F.collect_list(F.struct("cls", "label", "n", "side", "shingle_set")).alias("members"))
    return shelf.put("dense_links", groups.select("members").mapInArrow(_blocks, "src long, dst long"))


def near_duplicates(docs: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key for each row of docs (doc_id, text, ...).

    Null and empty texts and texts without a word have no shingles and are linked with nothing.
    Texts of fewer than five words have one shingle, the whole sequence. Rows that share a doc_id
    are judged each by its own text: classes of equal sets have ids made from the set's digests (63
    bits), and the least doc_id of a component is taken at the end. Rows without a doc_id are linked with nothing: component_id is
    null and they are kept. Texts of any length are read whole. Of pairs exactly at the line the link
    counts. Other columns are not looked at. An empty table gives an empty result.
    """
    shelf = shelf or Shelf(docs.sparkSession, "minhash")
    sk = shelf.put("sketches", sketches(docs))
    some = sk.filter("n_shingles > 0 and doc_id is not null")
    reps = shelf.put("reps", some.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("sig").alias("sig")).select("d1", "d2", "n_shingles", "sig", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), F.shiftrightunsigned(F.xxhash64("d1", "d2", "n_shingles"), 1).alias("cls")))
    tokens = reps.select("cls", F.posexplode(F.array(*(_token(F.lit(t)) for t in range(TREES)))).alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "cls")
    sizes = tokens.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    members = shelf.put("members", tokens.join(sizes, "node"))
    common = members.groupBy("cls").agg(F.sum("size").alias("common"))
    ranked = shelf.put("ranked", members.join(common, "cls").withColumn("rank", F.struct("common", (-F.col("cls")).alias("cls"))).select("node", "cls", "rank"))
    centre = ranked.groupBy("node").agg((-F.max("rank")["cls"]).alias("pivot"))
    star = ranked.join(centre, "node").filter("cls <> pivot").groupBy("cls", "pivot").agg(F.count("*").alias("hits")).groupBy("cls").agg(F.max(F.struct("hits", "pivot")).alias("best")).filter(f"best.hits >= {TREES // 3}")
    star = shelf.put("star", star.select(F.col("best.pivot").alias("a"), F.col("cls").alias("b")))
    labels = connected_components(_confirm(star, reps, docs, shelf, "star"), shelf, "cc_star")
    pairs, blocks = _search(members.select("node", "cls"), labels, reps, shelf)
    pairs = shelf.put("pairs", pairs)
    dense = _in_blocks(blocks, labels, reps, docs, shelf)
    shelf.drop("ranked", "dense", "dense_sets", *(f"{x}_{k}" for x in ("level", "shape") for k in range(1, LEVELS + 1)))
    links = _confirm(pairs, reps, docs, shelf, "search")
    links = links if dense is None else links.unionByName(dense)
    if not links.isEmpty():
        at = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"l_{side}"))
        lifted = links.join(at("src"), "src", "left").join(at("dst"), "dst", "left").select(F.coalesce("l_src", "src").alias("src"), F.coalesce("l_dst", "dst").alias("dst"))
        upper = connected_components(lifted, shelf, "cc_all")
        upper = upper.select(F.col("node").alias("label"), F.col("component").alias("top"))
        nodes = reps.select("cls").join(labels.select(F.col("node").alias("cls"), F.col("component").alias("label")), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        labels = nodes.join(upper, "label", "left").select(F.col("cls").alias("node"), F.coalesce("top", "label").alias("component"))
    of = reps.join(labels, reps.cls == labels.node, "left").select("d1", "d2", F.col("n_shingles").alias("n"), "rep_id", F.coalesce("component", "cls").alias("top"))
    of = of.join(of.groupBy("top").agg(F.min("rep_id").alias("found")), "top").select("d1", "d2", "n", "found")
    at = sk.drop("sig")
    out = at.join(of, (at.d1 == of.d1) & (at.d2 == of.d2) & (at.n_shingles == of.n) & at.doc_id.isNotNull() & (at.n_shingles > 0), "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"), "text_key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns; of rows with one doc_id and one text, one stays.

    Of each group of near copies the document with the smallest doc_id stays. Null and empty texts are
    linked with nothing and stay; so do rows without a doc_id.
    Rows that share a doc_id but not the text are judged each by their own. Long texts count with all
    their shingles. Columns may have any other names. An empty table gives an empty result.
    """
    found = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    key = K.free_name(docs, "text_key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    return rows.join(found, rows["doc_id"].cast("long").eqNullSafe(found.kept_id) & (rows[key] == found.kept_key), "left_semi").dropDuplicates(["doc_id", key]).drop(key)


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS sh
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp c ON c.doc_id = d.doc_id
"""
