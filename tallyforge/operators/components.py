"""Connected components by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import materialise


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the edge table ``(a, b)``; the root is the smallest node.

    Each round links the larger neighbours of a node, then the smaller ones, to the smallest
    neighbour. Neighbourhoods are only aggregated, never listed, and the lineage is cut by a
    reliable checkpoint per round. The rounds grow with the logarithm of the longest path.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a <> b").distinct())
    for _ in range(rounds):
        if _settled(links):
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        links = materialise(small.filter("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _settled(links: DataFrame) -> bool:
    """Every node hangs on one root and no root hangs on anything."""
    inner = links.select(F.col("b").alias("a")).distinct()
    if not links.join(inner, "a", "left_semi").isEmpty():
        return False
    return links.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
