"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.runtime import cut


def _anew(c: str) -> Column:
    """The same value as an expression the planner can't see through, so that a join on it gets an exchange of its own, which adaptive execution can split where a node has very many links."""
    return F.shiftleft(F.col(c), 0)


def _stars(oriented: DataFrame, keep: Column) -> DataFrame:
    """Each neighbour v of u that `keep` allows, linked to the least of u and all its neighbours."""
    least = oriented.groupBy("u").agg(F.min("v").alias("m")).select(_anew("u").alias("w"), F.least("u", "m").alias("m"))
    return oriented.where(keep).join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: a row per node that has a link; component is the least node reachable. edges: a, b (long), in either direction, repeated or not.

    Each round shuffles the links a few times and ends in a checkpoint; the rounds grow with the logarithm of the longest
    path, and end when one changes nothing. Only a count and a checksum reach the driver."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    e = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, F.col("v") > F.col("u")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        e = cut(_stars(large, F.lit(True)).where("u != v").unionByName(least).distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
