"""Distributed ranks, and layers and places of the nodes of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquarry.operators.components import clean_edges, peel, peeled, strong_components
from sparkquarry.store import Shelf


def ranked(rows: DataFrame, order: list[Column], shelf: Shelf, name: str, as_: str = "rank") -> DataFrame:
    """rows with their number from 1 in the given order, equal rows in any order. Rows are dealt by ranges and sorted there; only the sizes of the ranges are added up in one place (one row for each)."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = shelf.put(name, sorted_.select("*", F.shiftright("_id", 33).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).drop("_id"))
    sizes = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), "_range").withColumn(as_, F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def layered(edges: DataFrame, shelf: Shelf, sweeps: int = 2, name: str = "layout") -> DataFrame:
    """node, component, layer, position: a drawing order for the nodes of edges (src, dst).

    The nodes of a strong component share a layer: the length of the longest path to the component over
    the others. Positions in a layer count from 1, first by node; each sweep orders every layer by the
    mean position of a node's predecessors in other layers (its own position without any), equal ones by
    node. There are as many peeling rounds as layers; what no cycle reaches is peeled first, and only where
    something is left are components looked for, in it. Edges with a null end are ignored; an empty table gives no row.
    """
    e = shelf.put(f"{name}_edges", clean_edges(edges))
    all_ = shelf.put(f"{name}_all", e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    across = e.filter("src <> dst")
    nodes, rest = peeled(all_, across, shelf, f"{name}_first")
    if rest is None:
        nodes = nodes.select("node", F.col("node").alias("component"), "layer")
    else:
        c = strong_components(shelf.put(f"{name}_rest", rest), shelf, f"{name}_scc").select("node", "component")
        c = shelf.put(f"{name}_components", all_.join(c, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        a, b = (c.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c")) for x in ("src", "dst"))
        across = shelf.put(f"{name}_across", e.join(a, "src").join(b, "dst").filter("src_c <> dst_c"))
        layer, _ = peel(across.select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")), shelf, f"{name}_peel")
        nodes = shelf.put(f"{name}_nodes", c.join(layer.withColumnRenamed("node", "component"), "component", "left").select("node", "component", F.coalesce("layer", F.lit(0).cast("long")).alias("layer")))
    at = _in_layers(nodes, [F.col("node")], shelf, f"{name}_at_0")
    for k in range(1, sweeps + 1):
        pull = across.join(at.select(F.col("node").alias("src"), "position"), "src").groupBy(F.col("dst").alias("node")).agg((F.sum("position") / F.count("*")).alias("pull"))
        moved = at.join(pull, "node", "left").withColumn("pull", F.coalesce("pull", F.col("position").cast("double"))).drop("position")
        at = _in_layers(moved, [F.col("pull"), F.col("node")], shelf, f"{name}_at_{k}")
    return at.select("node", "component", "layer", "position")


def _in_layers(nodes: DataFrame, order: list[Column], shelf: Shelf, name: str) -> DataFrame:
    all_ = ranked(nodes, [F.col("layer"), *order], shelf, name)
    first = all_.groupBy("layer").agg(F.min("rank").alias("first"))
    return all_.join(first, "layer").withColumn("position", F.col("rank") - F.col("first") + 1).select("node", "component", "layer", "position")
