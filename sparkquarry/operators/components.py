"""Strongly connected components of directed graphs, which edges to cut, and the layers that remain.

Every round is a table on the shelf. Nodes are any orderable type; rows are edges and one label for
each node, so work grows with the edges, not with paths or reachable pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkquarry.store import Shelf


def clean_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without nulls."""
    return edges.select("src", "dst").filter("src is not null and dst is not null").distinct()


def least_reaching(nodes: DataFrame, edges: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(node, label): the smallest node from which each node can be reached, itself included.

    In each round a node takes the smallest label of its predecessors and the label of its own label:
    what reaches a node that reaches me reaches me. So labels travel over distances that grow by a
    factor each round, and a ring of n nodes takes about log n rounds.
    """
    labels, k = shelf.put(f"{name}_0", nodes.select("node", F.col("node").alias("label"))), 0
    while True:
        k += 1
        near = edges.join(labels, edges.src == labels.node).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        lowered = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("low"))
        above = labels.select(F.col("node").alias("low"), F.col("label").alias("over"))
        jumped = lowered.join(above, "low").select("node", F.least("low", "over").alias("next"), (F.least("low", "over") < F.col("label")).alias("moved"))
        written = shelf.put(f"{name}_{k}", jumped.select("node", F.col("next").alias("label"), "moved"))
        shelf.drop(f"{name}_{k - 1}")
        labels = written.select("node", "label")
        if written.filter("moved").isEmpty():
            return labels


def trimmed(edges: DataFrame, shelf: Shelf, name: str, rounds: int) -> DataFrame:
    """Edges whose both ends have edges in and out, a few times over: the fringe that no cycle touches. More rounds would peel a long chain node by node; colouring takes it at once."""
    for k in range(rounds):
        sources, targets = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = shelf.put(f"{name}_{k}", edges.join(sources, "src", "left_semi").join(targets, "dst", "left_semi").select("src", "dst"))
        if k:
            shelf.drop(f"{name}_{k - 1}")
    return edges


def strong_components(edges: DataFrame, shelf: Shelf, name: str = "scc", trims: int = 1) -> DataFrame:
    """(node, component, size) of all nodes of edges (src, dst): component is the smallest node that reaches the node and is reached by it.

    Forward-backward colouring: the colour of a node is the smallest node that reaches it; of the nodes
    of one colour, those that reach the colour's node back are its component. The others, in none of
    whose edges colours differ, go on in the next round. A node on no cycle is a component of size 1
    (a self-loop makes no difference); edges with a null end are ignored; an empty table gives no row.
    """
    all_ = shelf.put(f"{name}_edges", clean_edges(edges))
    nodes = all_.select(F.col("src").alias("node")).union(all_.select("dst")).distinct()
    live = trimmed(all_.filter("src <> dst"), shelf, f"{name}_trim", trims)
    found, k = [], 0
    while not live.isEmpty():
        k += 1
        on = shelf.put(f"{name}_nodes_{k}", live.select(F.col("src").alias("node")).union(live.select("dst")).distinct())
        forth = least_reaching(on, live, shelf, f"{name}_forth_{k}")
        same = live.join(forth.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(forth.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b")
        turned = shelf.put(f"{name}_turned_{k}", same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = least_reaching(on, turned, shelf, f"{name}_back_{k}")
        pair = shelf.put(f"{name}_pair_{k}", forth.join(back.withColumnRenamed("label", "back"), "node"))
        found.append(pair.filter("label = back").select("node", F.col("label").alias("component")))
        rest = pair.filter("label <> back")
        here = turned.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        here = here.join(rest.select(F.col("node").alias("src"), F.col("back").alias("a")), "src").join(rest.select(F.col("node").alias("dst"), F.col("back").alias("b")), "dst").filter("a = b")
        live = shelf.put(f"{name}_live_{k}", here.select("src", "dst"))
        shelf.drop(f"{name}_nodes_{k}", f"{name}_turned_{k}", *((f"{name}_live_{k - 1}",) if k > 1 else ()))
    component = nodes.withColumn("component", F.col("node"))
    if found:
        cyclic = found[0]
        for part in found[1:]:
            cyclic = cyclic.unionByName(part)
        component = nodes.join(cyclic, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    size = component.groupBy("component").agg(F.count("*").alias("size"))
    return shelf.put(f"{name}_out", component.join(size, "component").select("node", "component", "size"))


def inner_edges(edges: DataFrame, components: DataFrame, *carry: str) -> DataFrame:
    """The edges inside a component of several nodes, self-loops left out."""
    many = components.filter("size > 1")
    a, b = (many.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")) for c in ("src", "dst"))
    return edges.filter("src <> dst").join(a, "src").join(b, "dst").filter("src_component = dst_component").select("src", "dst", *carry, F.col("src_component").alias("component"))


def cut_edges(edges: DataFrame, shelf: Shelf, name: str = "cut") -> DataFrame:
    """(src, dst, weight, round): edges of (src, dst, weight) to cut so that no cycle remains; self-loops go in round 0.

    Rounds, until no component has two nodes. The nodes of a component stand in the order of outgoing
    minus incoming weight (the largest first; equal ones by node), and every cycle has an edge that goes
    back in that order. Of those, an edge (u, v) costs its weight over the cycles it may close, the
    pairs of an edge into u and one out of v, in millionths; those that cost no more than the mean of
    their component are cut, one at least. So about half of them go each round, and what is left falls
    apart into smaller components. All is sums by node and component, no window and no paths. Parallel
    edges count once with the sum of their weights (whole numbers from 0); rows with a null are ignored.
    """
    e = edges.filter("src is not null and dst is not null and weight is not null").groupBy("src", "dst").agg(F.sum("weight").cast("long").alias("weight"))
    e = shelf.put(f"{name}_edges", e)
    cut, k, live = [e.filter("src = dst").withColumn("round", F.lit(0))], 0, e.filter("src <> dst")
    while True:
        k += 1
        inner = shelf.put(f"{name}_inner_{k}", inner_edges(live, strong_components(live, shelf, f"{name}_scc_{k}", 1 if k == 1 else 0), "weight"))
        if inner.isEmpty():
            break
        ends = inner.select(F.col("src").alias("node"), F.col("weight").alias("w"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(inner.select(F.col("dst").alias("node"), (-F.col("weight")).alias("w"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        node = shelf.put(f"{name}_node_{k}", ends.groupBy("node").agg(F.sum("w").alias("score"), F.sum("o").alias("out"), F.sum("i").alias("into")))
        a = node.select(F.col("node").alias("src"), F.col("score").alias("a"), "into")
        b = node.select(F.col("node").alias("dst"), F.col("score").alias("b"), "out")
        back = inner.join(a, "src").join(b, "dst").filter("b > a or (b = a and dst < src)")
        back = back.select("src", "dst", "weight", "component", F.expr("(weight * 1000000L) div (into * out)").alias("cost"))
        mean = back.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.col("cost").cast("decimal(25,0)")).alias("total"))
        gone = back.join(mean, "component").filter("cast(cost as decimal(19,0)) * cast(n as decimal(18,0)) <= total")
        gone = shelf.put(f"{name}_gone_{k}", gone.select("src", "dst", "weight", F.lit(k).alias("round")))
        cut.append(gone)
        live = shelf.put(f"{name}_live_{k}", inner.select("src", "dst", "weight").join(gone.select("src", "dst"), ["src", "dst"], "left_anti"))
        shelf.drop(f"{name}_inner_{k}", f"{name}_node_{k}", *((f"{name}_live_{k - 1}",) if k > 1 else ()))
    out = cut[0]
    for part in cut[1:]:
        out = out.unionByName(part)
    return out


def peel(edges: DataFrame, shelf: Shelf, name: str = "peel") -> tuple[DataFrame, bool]:
    """(node, layer) by topological peeling, and whether all nodes went: then the edges have no cycle. The layer of a node is the length of the longest path to it."""
    e = shelf.put(f"{name}_edges", clean_edges(edges))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    layers, rest = peeled(nodes, e, shelf, name)
    return layers, rest is None


def peeled(nodes: DataFrame, edges: DataFrame, shelf: Shelf, name: str) -> tuple[DataFrame, DataFrame | None]:
    """(node, layer) of the nodes that go, and the edges between the others (None if all go). Edges are on the shelf, distinct and without nulls.

    A node goes once its count of edges from nodes that stay is 0, so a round joins the edges with the
    nodes that went in the round before and rewrites only the counts; edges are rewritten when half of
    them have done their part, so all rewriting together is no more than their number.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("into"))
    left = shelf.put(f"{name}_nodes_0", nodes.join(into, "node", "left").select("node", F.coalesce("into", F.lit(0).cast("long")).alias("into")))
    kept, written, layers, k = edges, None, [], 0
    while True:
        free, live = left.agg(F.count_if(F.col("into") == 0), F.coalesce(F.sum("into"), F.lit(0))).first()
        layer = shelf.put(f"{name}_layer_{k}", left.filter("into = 0").select("node", F.lit(k).cast("long").alias("layer")))
        layers.append(layer)
        if not free or not live:
            break
        if written is None:
            written = live
        elif 2 * live <= written:
            kept, written = shelf.put(f"{name}_left_{k}", kept.join(left.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")), live
        gone = kept.join(layer.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("gone"))
        k += 1
        left = shelf.put(f"{name}_nodes_{k}", left.filter("into > 0").join(gone, "node", "left").select("node", (F.col("into") - F.coalesce("gone", F.lit(0))).alias("into")))
        shelf.drop(f"{name}_nodes_{k - 1}")
    out = layers[0]
    for part in layers[1:]:
        out = out.unionByName(part)
    return out, kept.join(left.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst") if live else None
