"""Connected components of a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least node among u and all v beside u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("of")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the least node that it is joined to.

    Each round points every node's larger neighbours at its least neighbour,
    then every node and its smaller neighbours at the least one; rounds are of
    the order of the logarithm of the number of nodes. Only a count and a sum
    come to the driver. An edge from a node to itself makes it a component.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    alone = now.filter("u = v").select(F.col("u").alias("node"), F.col("u").alias("label"))
    now, last = cut(now.filter("u <> v")), None
    if not now.limit(1).count():
        return alone
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _least(large)
        now = cut(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last:
            break
        last = state
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return labels.unionByName(roots).unionByName(alone.join(labels.unionByName(roots), "node", "left_anti"))
