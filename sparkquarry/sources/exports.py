"""Sinks: graphs and reports as text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot_lines(edges: DataFrame) -> DataFrame:
    """A DOT statement for each edge, to be written in order between the head and the foot."""
    return edges.select(F.concat(F.lit('  "'), F.col("src").cast("string"), F.lit('" -> "'), F.col("dst").cast("string"), F.lit('";')).alias("line"))


def dot(edges: DataFrame) -> DataFrame:
    """The whole graph as one text; for graphs of a display's size."""
    return dot_lines(edges).agg(F.concat(F.lit("digraph g {\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n}")).alias("dot"))


def node_link(edges: DataFrame) -> DataFrame:
    """JSON objects of links."""
    return edges.select(F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"))).alias("link"))


def node_objects(nodes: DataFrame) -> DataFrame:
    """JSON objects of nodes(node, in_degree, out_degree)."""
    return nodes.select(F.to_json(F.struct(F.col("node").alias("id"), F.col("in_degree").alias("in"), F.col("out_degree").alias("out"))).alias("node"))


def graph_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One JSON object of totals: nodes, edges, the most neighbours, self-loops, nodes without incoming and without outgoing edges."""
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    n = nodes.agg(F.count("*").alias("nodes"), F.max("centrality").alias("most"), F.count_if(F.col("in_degree") == 0).alias("sources"), F.count_if(F.col("out_degree") == 0).alias("sinks"))
    return e.join(F.broadcast(n)).select(F.to_json(F.struct("nodes", "edges", "most", "loops", "sources", "sinks")).alias("summary"))  # one row each


def markdown(rows: DataFrame) -> DataFrame:
    """Table rows."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.col(c).cast("string") for c in rows.columns)), F.lit(" |")).alias("line"))


def graphml_lines(edges: DataFrame) -> DataFrame:
    """GraphML elements of nodes and edges as rows (part 0 and 1, to be written in order between head and foot); names are escaped."""
    def escaped(c):
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(char), F.lit(name))
        return c

    e = edges.select(escaped(F.col("src").cast("string")).alias("src"), escaped(F.col("dst").cast("string")).alias("dst"))
    nodes = e.select("src").union(e.select("dst")).distinct().select(F.lit(0).cast("long").alias("part"), F.concat(F.lit('<node id="'), F.col("src"), F.lit('"/>')).alias("line"))
    return nodes.unionByName(e.select(F.lit(1).cast("long").alias("part"), F.concat(F.lit('<edge source="'), F.col("src"), F.lit('" target="'), F.col("dst"), F.lit('"/>')).alias("line")))
