"""Connected components of an edge table, without ever gathering them.

Each round hooks every node to its smallest neighbour, follows these parents to their roots by doubling, and contracts the
edges to roots, until no edge is left. Every step is a join or an aggregation with partial sums; the tables between steps
are written to the shared folder, so that a join's sides are both plain exchanges, whose hot keys Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch


def roots(parent: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, parent), each parent smaller than its node, as (node, parent) with roots as parents."""
    while True:
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        step = scratch.save(parent.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        scratch.drop(parent)
        moved = step.where("moved").limit(1).count()
        parent = step
        if not moved:
            return parent


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for the nodes of the edges (a, b): label is a node of the component, the same for all of it."""
    edges = scratch.save(edges.select("a", "b").where("a <> b"))
    labels = None
    while edges.limit(1).count():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        parent = scratch.save(both.groupBy("node").agg(F.least(F.min("other"), "node").alias("parent")))
        hooked = roots(scratch.save(parent.where("parent < node")), scratch)
        found = scratch.save(
            parent.select("node").join(hooked.select(F.col("node").alias("n"), "parent"), F.col("node") == F.col("n"), "left").select("node", F.coalesce("parent", "node").alias("label"))
        )
        scratch.drop(parent, hooked)
        if labels is None:
            labels = found
        else:
            newer = labels.join(found.select(F.col("node").alias("n"), F.col("label").alias("l")), F.col("label") == F.col("n"), "left")
            newer = scratch.save(newer.select("node", F.coalesce("l", "label").alias("label")))
            scratch.drop(labels)
            labels = newer
        at = lambda side: found.select(F.col("node").alias(side), F.col("label").alias(f"to_{side}"))
        once = scratch.save(edges.join(at("a"), "a").select("to_a", "b"))
        contracted = scratch.save(once.join(at("b"), "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        scratch.drop(once, edges, *([] if found is labels else [found]))
        edges = contracted
    scratch.drop(edges)
    return labels if labels is not None else scratch.spark.createDataFrame([], "node long, label long")
