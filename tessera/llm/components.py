"""Connected components by contraction: nodes hook on to their least neighbour, and edges follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, table


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): rows (node, root), one for each node of an edge; root is the same within a component.

    Each round, a node's label is the least of itself and its neighbours, taken twice (the label's label), and edges are replaced by
    those between labels, without loops and repeats. Nodes should be hashes: random labels shrink any graph, chains too, by a factor in each round.
    Everything stays in tables; the driver sees only whether edges are left.
    """
    edges = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    roots = None
    while edges.limit(1).take(1):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "cc-labels")
        up = label.select(F.col("node").alias("label"), F.col("label").alias("next"))
        label2 = table(label.join(up, "label").select("node", F.col("next").alias("label")), "cc-labels")
        drop(label)
        if roots is None:
            new = label2.withColumnRenamed("label", "root")
        else:
            new = roots.join(label2.withColumnRenamed("node", "root"), "root", "left_outer").select("node", F.coalesce("label", "root").alias("root"))
        new_roots = table(new, "cc-roots")
        moved = edges.join(label2.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(label2.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
        new_edges = table(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).filter("a <> b").distinct(), "cc-edges")
        for old in (edges, roots, label2):
            if old is not None:
                drop(old)
        edges, roots = new_edges, new_roots
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
