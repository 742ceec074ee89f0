"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalis.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root``: every node of ``links (a, b)`` with the same root as all it reaches.

    Each round sends every node to its least neighbour, relabels the links and drops those that
    became loops, so hot nodes vanish in the first round.  Node numbers should be hashes: then
    the number of rounds grows with the logarithm of the longest path.  No rows, no nodes; loops
    and repeated links change nothing."""
    edges = stored(links.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "links")
    nodes = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = stored(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents")
        up = parents.withColumnsRenamed({"a": "root", "p": "_p"})
        if nodes is None:
            nodes = up.withColumnsRenamed({"root": "node", "_p": "root"})
        else:
            nodes = stored(nodes.join(up, "root", "left").select("node", F.coalesce("_p", "root").alias("root")), "nodes")
        one = parents.withColumnsRenamed({"a": "a", "p": "pa"})
        two = parents.withColumnsRenamed({"a": "b", "p": "pb"})
        edges = stored(
            edges.join(one, "a").join(two, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .where(F.col("a") != F.col("b")).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if nodes is None else nodes
