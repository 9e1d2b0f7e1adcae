"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, node, root) of all nodes of (within, a, b): root is the least node of the component.

    Large and small stars in turn: a node's larger neighbours are linked to its least one, then a node and its lesser
    neighbours are. Rounds grow with the logarithm of the nodes, each a grouping and a join on a node; a node with
    very many neighbours is a skewed key of a plain join, which adaptive execution splits.
    """
    keys = [*within, "a"]
    once = edges.where("a <> b").select(*within, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(once)
    while True:
        both = links.unionByName(links.select(*within, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, keys).where("b > a").select(*within, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(*keys).agg(F.min("b").alias("m"))
        small = large.join(low, keys).where("b <> m").select(*within, F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).distinct()
        after = cut(small)
        if after.exceptAll(links).isEmpty() and links.exceptAll(after).isEmpty():
            break
        links = after
    return links.select(*within, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(*within, F.col("b").alias("node"), F.col("b").alias("root")).distinct())
