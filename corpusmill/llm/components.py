"""Connected components of a link table, by hooking each node to its least neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _flat(up: DataFrame) -> DataFrame:
    """(node, up), where ``up`` is the node itself or a smaller one -> the same with the root of each tree as ``up``."""
    while True:
        top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hop = store.keep(up.join(top, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "cc-hop")
        moved = not hop.filter("moved").isEmpty()
        store.discard(up)
        up = hop.select("node", "up")
        if not moved:
            return up


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, label), the label being the smallest node of its component.

    Each round hooks every node to its least neighbour, walks to the roots of the trees this makes, and
    goes on with the links between different roots, each once. So a link is read in the first round only,
    and what is left shrinks to the links between trees. Every round is a table in the shared folder.
    """
    edges = links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = store.keep(edges.distinct(), "cc-links")
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("node"), F.col("a").alias("up")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("up")))
        roots = _flat(store.keep(ends.groupBy("node").agg(F.min("up").alias("up")), "cc-up"))
        if labels is None:
            labels = roots.select("node", F.col("up").alias("label"))
        else:
            over = roots.select(F.col("node").alias("label"), F.col("up").alias("root"))
            labels = store.keep(labels.join(over, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "cc-labels")
        left = edges.join(roots.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("x", "b")
        left = left.join(roots.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").filter("x != y")
        left = store.keep(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-links")
        store.discard(edges)
        edges = left
        if edges.isEmpty():
            store.discard(edges)
            return labels
