"""Connected components as joins on a graph that shrinks with every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent < node`` pointers to their ends, doubling the step each time."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = written(
            parents.join(above, "parent", "left").select(
                "node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")
            ),
            "parents",
        )
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Each round every node that has a smaller neighbour hangs itself under the
    smallest one, pointers are shortened to their roots, and the edges between
    roots make the next, smaller graph. Stars need one round, a path of n nodes
    about log n. A node with many edges is only ever aggregated or joined, both
    of which split. No edges give no rows; loops and repeated edges are harmless.
    """
    labels = None
    while True:
        both = edges.filter("a <> b").select(
            F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")
        )
        parents = written(both.groupBy("node").agg(F.min("parent").alias("parent")), "hung")
        if parents.isEmpty():
            break
        roots = _roots(parents)
        if labels is None:
            named = roots.select("node", F.col("parent").alias("component"))
        else:
            moved = roots.select(F.col("node").alias("component"), F.col("parent").alias("to"))
            named = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            # nodes that were roots until now
            named = named.unionByName(
                roots.select("node", F.col("parent").alias("component")).join(labels.select("node"), "node", "left_anti")
            )
        labels = written(named, "labels")
        of = {x: roots.select(F.col("node").alias(x), F.col("parent").alias(f"{x}_root")) for x in "ab"}
        edges = written(
            edges.join(of["a"], "a", "left").join(of["b"], "b", "left")
            .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
            .filter("a <> b").distinct(),
            "contracted",
        )
    empty = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    if labels is None:
        return empty
    heads = labels.select(F.col("component").alias("node"), "component").distinct()
    return labels.unionByName(heads.join(labels.select("node"), "node", "left_anti"))
