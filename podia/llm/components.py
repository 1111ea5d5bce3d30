"""Connected components by joins: nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podia.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); nodes of a component share a root, one of them.

    Each round every node hooks to its smallest neighbour, pointers are
    doubled, and edges are contracted to the hooked nodes, so the graph
    shrinks until no edge is left. Rounds are written to the shared folder,
    which keeps the plan short. A hub's edges are counted by partial
    aggregation and its joins split by AQE. Self-loops and repeated edges do
    no harm; an empty table gives an empty result.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        hook = materialise(hook, "hooks")
        over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jump = materialise(hook.join(over, "up").select("node", F.col("top").alias("up")), "jumps")
        if labels is None:
            labels = jump.select("node", F.col("up").alias("root"))
        else:
            moved = jump.select(F.col("node").alias("root"), "up")
            labels = materialise(labels.join(moved, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        left, right = jump.select(F.col("node").alias("a"), F.col("up").alias("ra")), jump.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct()
        edges = materialise(edges, "edges")
    return labels
