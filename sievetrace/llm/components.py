"""Connected components by repeated contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetrace.llm.runtime import table


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent) with parent <= node, by pointer jumping."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        step = table(parents.join(above, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), (F.coalesce("next", "parent") < F.col("parent")).alias("moved")))
        parents = step.select("node", "parent")
        if step.filter("moved").isEmpty():
            return parents.withColumnRenamed("parent", "root")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each component, for every node of an edge between two nodes.

    Each round hooks every node to its smallest neighbour, flattens those trees by pointer jumping, and keeps
    the distinct edges between trees.  Minima are aggregated before they are shuffled, so a node with a third
    of all edges costs no more than others; a hot join key is left to the skew join.  Rounds are logarithmic
    for ids in no particular order.  Nulls and loops are no edges; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    left = table(edges.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        parents = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent"))
        roots = _roots(table(parents))
        maps.append(roots)
        to_a, to_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        moved = left.join(to_a, "a").join(to_b, "b").filter("root_a <> root_b")
        left = table(moved.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    if not maps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0]
    for later in maps[1:]:
        out = out.join(later.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out.withColumnRenamed("root", "component")
