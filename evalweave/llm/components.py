"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import pinned


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that ``edges`` (a, b) connect to node.

    Each round hooks every node to its smallest neighbour, halves the chains that
    arise, and contracts the edges; the edges left shrink geometrically. Every round
    is written to the shared folder, so a lost executor costs one round at most.
    """
    left = pinned(edges.where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = pinned(both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("root")), "hooks")
        step = _compose(hooked, hooked)
        step = pinned(_compose(step, step), "hooks")
        up = step.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        ends = left.join(up, F.col("a") == F.col("__n"), "left").select(F.coalesce("__r", "a").alias("a"), "b")
        ends = ends.join(up, F.col("b") == F.col("__n"), "left").select("a", F.coalesce("__r", "b").alias("b"))
        left = pinned(ends.where("a != b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        found = step if found is None else pinned(_compose(found, step), "roots")
    return found if found is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _compose(first: DataFrame, second: DataFrame) -> DataFrame:
    up = second.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    return first.join(up, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root"))
