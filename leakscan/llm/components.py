"""Connected components by alternating large and small stars.

Every round is a few aggregates and joins over the edge table, written to the
shared folder, so a lost executor costs one round at most and no node's
neighbours are ever gathered in one place. The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.sources.workspace import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): hang the neighbours of each node on their minimum."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written first, so that both sides of the join are exchanged and a hub's rows can be split.
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    hung = pairs.join(least, "u")
    if large:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) that is not its component's smallest.

    Loops and repeated or reversed edges change nothing; an empty table gives an
    empty one. Rows with a null end are ignored.
    """
    edges = materialise(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = materialise(_star(materialise(_star(edges, True), "edges"), False), "edges")
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
