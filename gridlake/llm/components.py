"""Connected components of an edge table, by alternating star contractions on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.session import write_table


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``pairs`` (a > b): every node's larger (or smaller) neighbours move to the smallest
    neighbour.  The smallest neighbour is a partial aggregate; the join back on a hub can be split by AQE."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("n", "m").alias("m"))
    moved = both.join(low, F.col("a") == F.col("n"))
    if large:
        moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                               F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
                             ).select("e.a", "e.b")
    return moved.where("a <> b")


def _settled(pairs: DataFrame) -> bool:
    """Whether all pairs point from a leaf to the centre of a star: no node has two centres or is both."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("leaf")),
                                          F.struct(F.col("b").alias("n"), F.lit(0).alias("leaf")))).alias("e")).select("e.*")
    odd = ends.groupBy("n").agg(F.sum("leaf").alias("s"), F.min("leaf").alias("low")).where("s > 1 or (s = 1 and low = 0)")
    return not odd.head(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round is two joins and one written table, so a lost executor replays one round at most.  The rounds
    grow with the logarithm of the longest chain.  Null ends and loops are ignored.
    """
    pairs = (edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    pairs = write_table(pairs, "edges")
    while not _settled(pairs):
        pairs = write_table(_stars(_stars(pairs, True), False).distinct(), "edges")
    leaves = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
