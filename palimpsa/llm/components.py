"""Connected components by contraction: every node joins its least neighbour until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsa.llm.common import settle

LINKS_PER_TASK = 250_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; nodes of a component share the root.

    Small rounds run in few tasks: their number follows the counted links. Each round maps a node to the least of itself and its neighbours and keeps the links between different images,
    so at least half of the nodes of each component with links go. Links, rounds and results stay in tables;
    the driver sees counts only. Empty links give an empty table.
    """
    edges = settle(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    roots: DataFrame | None = None
    tasks = 1 + edges.count() // LINKS_PER_TASK
    while left_over := edges.count():
        few = 1 + left_over // LINKS_PER_TASK
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("_least"))
        step = step.select(F.col("a").alias("node"), F.least("a", "_least").alias("to")).coalesce(few)
        step = settle(step, "step")
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
        else:
            onward = step.select(F.col("node").alias("root"), "to")
            roots = roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = settle(roots.coalesce(tasks), "roots")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges = settle(moved.filter("a <> b").distinct().coalesce(few), "links")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
