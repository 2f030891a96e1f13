"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.operators.layout import ranked
from sparkquarry.store import Shelf


def connected_components(edges: DataFrame, shelf: Shelf, name: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (src, dst).

    Neighbour minimum and pointer jumping in turn, so that paths halve each round; each round is
    written to the shelf. Rows are two numbers wide and minima are combined before the shuffle, so
    a hub with many edges costs one row for each task. Joins are by shuffle whatever their size, so no
    labels pass through the driver. Self-loops make a node its own component;
    edges with a null end are ignored.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src is not null and dst is not null").distinct()
    both = shelf.put(f"{name}_edges", both)
    labels = shelf.put(f"{name}_0", both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")))
    k = 0
    while True:
        k += 1
        near = both.join(labels.hint("merge"), both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        lowered = labels.join(near.hint("merge"), labels.node == near.src, "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        jumped = lowered.join(up.hint("merge"), "low", "left").select("node", F.least("low", F.coalesce("root", "low")).alias("component"), (F.least("low", F.coalesce("root", "low")) < F.col("component")).alias("moved"))
        written = shelf.put(f"{name}_{k}", jumped)
        shelf.drop(f"{name}_{k - 1}")
        labels = written.select("node", "component")
        if written.filter("moved").isEmpty():
            shelf.drop(f"{name}_edges")
            return labels


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, centrality, weight (half the centrality, 1 at least)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out.withColumn("centrality", F.col("in_degree") + F.col("out_degree")).withColumn("weight", F.greatest(F.col("centrality") / 2, F.lit(1.0)))


def density(edges: DataFrame) -> DataFrame:
    n = degrees(edges).agg(F.count("*").alias("n_nodes"), F.max("centrality").alias("max_centrality"))
    e = edges.agg(F.count("*").alias("n_edges"))
    return n.join(F.broadcast(e)).withColumn("density", F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 6))  # one row each


def bfs_depth(edges: DataFrame, shelf: Shelf, name: str = "bfs") -> DataFrame:
    """node, depth: fewest steps from a node without incoming edges; nodes that none reaches stay at 0. Ends when a round reaches no new node."""
    e = shelf.put(f"{name}_edges", edges.select("src", "dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    seen = shelf.put(f"{name}_0", nodes.join(e.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("depth", F.lit(0).cast("long")))
    front, k = seen, 0
    while True:
        k += 1
        step = front.join(e, front.node == e.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = shelf.put(f"{name}_{k}", step.withColumn("depth", F.lit(k).cast("long")))
        if front.isEmpty():
            return nodes.join(seen, "node", "left").select("node", F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))
        seen = seen.unionByName(front)
        if k % 16 == 0:  # so that plans stay short on long chains
            seen = shelf.put(f"{name}_seen_{k}", seen)
            shelf.drop(f"{name}_seen_{k - 16}", *(f"{name}_{i}" for i in range(k - 16, k)))


def critical_nodes(edges: DataFrame, depths: DataFrame, shelf: Shelf) -> DataFrame:
    """Score of each node, and the top tenth (5 at least), ranked over ranges of scores."""
    d = degrees(edges).join(depths, "node")
    most = depths.agg(F.max("depth").alias("most"))
    score = F.least(F.col("in_degree"), F.lit(5)) + F.least(0.1 * F.col("out_degree"), F.lit(3.0)) + F.when(F.col("most") > 0, 2.0 * (F.col("most") - F.col("depth")) / F.col("most")).otherwise(0.0)
    out = d.join(F.broadcast(most)).withColumn("score", F.round(score.cast("double"), 6))
    out = ranked(out, [F.desc("score"), F.col("node")], shelf, "scores", "position")
    keep = out.agg(F.greatest(F.floor(F.count("*") * 0.1), F.lit(5)).alias("keep"))
    return out.join(F.broadcast(keep)).filter("position <= keep").select("node", "score", "position")  # keep is one row


def target_clusters(edges: DataFrame) -> DataFrame:
    """Nodes with the same set of targets: cluster, size, main, cohesion (inner edges of the possible ones), coupling (outer edges of all)."""
    key = edges.groupBy("src").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("dst").cast("string"))), ","), 256).alias("cluster"), F.count("*").alias("out_degree"))
    key = key.join(degrees(edges).select(F.col("node").alias("src"), "weight"), "src")
    size = key.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by("src", F.struct(-F.col("weight"), F.col("src"))).alias("main"), F.sum("out_degree").alias("edges")).filter("size > 1")
    member = key.select("src", "cluster")
    inner = edges.join(member, "src").join(member.select(F.col("src").alias("dst"), F.col("cluster").alias("to")), "dst").filter("cluster = to").groupBy("cluster").agg(F.count("*").alias("inner"))
    out = size.join(inner, "cluster", "left").fillna(0, ["inner"])
    return out.select("main", "size", F.round(F.col("inner") / (F.col("size") * (F.col("size") - 1)), 6).alias("cohesion"), F.round((F.col("edges") - F.col("inner")) / F.col("edges"), 6).alias("coupling"))


def cycles(edges: DataFrame, longest: int = 5) -> DataFrame:
    """All simple cycles of 2 to longest nodes, once each, from their smallest node: path array, length, severity."""
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    paths = e.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    found = None
    for length in range(2, longest + 1):
        closed = paths.join(e, (paths.last == e.src) & (paths.start == e.dst), "left_semi").select("path", F.lit(length).cast("long").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if length < longest:
            step = paths.join(e, paths.last == e.src)
            paths = step.filter((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))
    return found.withColumn("severity", F.when(F.col("length") >= 5, "critical").when(F.col("length") >= 3, "high").otherwise("medium"))


def cycle_impact(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, length, severity, impact of cycles() by the rule for packages, with nodes(node, weight): up to 2 critical, 4 high, 6 medium, counted with the closing node, which is the first one again; ten times the mean weight over that count."""
    steps = found.select("path", F.explode(F.concat("path", F.slice("path", 1, 1))).alias("node"))
    mean = steps.join(nodes.select("node", "weight"), "node").groupBy("path").agg(F.avg("weight").alias("mean"))
    n = F.size("path") + 1
    severity = F.when(n <= 2, "critical").when(n <= 4, "high").when(n <= 6, "medium").otherwise("low")
    return mean.select("path", F.size("path").cast("long").alias("length"), severity.alias("severity"), F.round(10 * F.col("mean") / n, 6).alias("impact"))


def cycle_hotspots(found: DataFrame, top: int = 5) -> DataFrame:
    """node, n: the nodes that occur most in cycles() (the first node of a cycle counts twice, as it closes it)."""
    return found.select(F.explode(F.concat("path", F.slice("path", 1, 1))).alias("node")).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(top)


def core(edges: DataFrame, shelf: Shelf, name: str = "core") -> DataFrame:
    """The edges whose both ends have edges in and out, repeated until none falls away: no others can lie on a cycle."""
    e, k = shelf.put(f"{name}_0", edges.select("src", "dst").filter("src <> dst").distinct()), 0
    n = e.count()
    while True:
        k += 1
        left = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = shelf.put(f"{name}_{k}", left.select("src", "dst"))
        shelf.drop(f"{name}_{k - 1}")
        before, n, e = n, left.count(), left
        if n == before:
            return e


def shortest_cycles(edges: DataFrame, shelf: Shelf, name: str = "short") -> DataFrame:
    """path, length, severity: a shortest cycle through each node that lies on one, of any length, once each, from its smallest node; of equal ones the least path.

    The search goes breadth first from all nodes of the core at once and keeps one path for each
    start and node reached, so rows are bounded by the square of the core's nodes.
    """
    e = core(edges, shelf, f"{name}_core")
    front = shelf.put(f"{name}_0", e.select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path")))
    seen, found, k = front.select("start", "last"), [], 0
    while not front.isEmpty():
        k += 1
        closed = front.join(e, (front.last == e.src) & (front.start == e.dst), "left_semi").groupBy("start").agg(F.min("path").alias("path"))
        closed = shelf.put(f"{name}_closed_{k}", closed)
        found.append(closed)
        live = front.join(closed.select("start"), "start", "left_anti").join(e, F.col("last") == e.src).select("start", e.dst.alias("next"), F.concat("path", F.array(e.dst)).alias("path")).filter("next <> start")
        live = live.groupBy("start", "next").agg(F.min("path").alias("path")).join(seen.withColumnRenamed("last", "next"), ["start", "next"], "left_anti")
        front = shelf.put(f"{name}_{k}", live.withColumnRenamed("next", "last").select("start", "last", "path"))
        seen = seen.unionByName(front.select("start", "last"))
    out = None
    for part in found:
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = front.select("start", "path")
    least = F.array_position("path", F.array_min("path")).cast("int")
    turned = F.concat(F.slice("path", least, F.size("path") - least + 1), F.slice("path", 1, least - 1))
    out = out.select(turned.alias("path")).distinct().withColumn("length", F.size("path").cast("long"))
    return out.withColumn("severity", F.when(F.col("length") >= 5, "critical").when(F.col("length") >= 3, "high").otherwise("medium"))


def cycle_type(path) -> F.Column:
    """By words of the members, in order of weight: type, component, service, utility, import."""
    has = lambda *words: F.exists(path, lambda p: F.greatest(*(F.lower(p).contains(w).cast("int") for w in (*words, "\0"))) == 1)
    return F.when(has("/types/", ".d.ts"), "type").when(has("component"), "component").when(has("service"), "service").when(has("util", "helper"), "utility").otherwise("import")


def cycle_stats(found: DataFrame) -> DataFrame:
    """Counts by severity, mean length and the score (25, 15, 8, 3 for each cycle; 100 at most)."""
    weight = F.when(F.col("severity") == "critical", 25).when(F.col("severity") == "high", 15).when(F.col("severity") == "medium", 8).otherwise(3)
    return found.agg(F.count("*").alias("n_cycles"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("critical", "high", "medium")), F.round(F.avg("length"), 6).alias("mean_length"), F.least(F.sum(weight), F.lit(100)).cast("long").alias("score"))
