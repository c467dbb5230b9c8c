"""Connected components by alternating large and small stars.

An edge is stored from its larger node to its smaller one.  A large star moves
each edge's smaller end to that end's least neighbour, a small star points all
smaller neighbours of a node at the least of them; repeated, this turns each
component into one star around its least node.  Lookups are salted, so a hub
with a third of all edges is spread.  Each round is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_lookup, written


def _least_neighbour(edges: DataFrame, key: str, value: str) -> DataFrame:
    """The least smaller neighbour of each node that has one."""
    return edges.groupBy(F.col("u").alias(key)).agg(F.min("v").alias(value), F.count("*").alias("_degree"))


def _directed(edges: DataFrame) -> DataFrame:
    return (
        edges.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Label the nodes of ``edges`` (u, v; any one orderable type).

    Returns (node, root) for every node that is not the least of its component,
    and for no other.  Self loops and repeated edges are allowed; null ends are
    not.  No edges give an empty result.
    """
    spark = edges.sparkSession
    now, path = written(_directed(edges), "edges")
    for _ in range(max_rounds):
        least = _least_neighbour(now, "v", "_m").drop("_degree")
        large = salted_lookup(now, "v", F.col("u"), least, "left")
        moved = _directed(large.select("u", F.coalesce("_m", "v").alias("v")))
        least = _least_neighbour(moved, "u", "_m")
        small = salted_lookup(moved, "u", F.col("v"), least, "inner")
        # Each edge (u, v) gives (v, m); u keeps its edge to m, which is its own row with v = m.
        ends = F.when(F.col("v") == F.col("_m"), F.struct("u", "v")).otherwise(
            F.struct(F.col("v").alias("u"), F.col("_m").alias("v"))
        )
        after, after_path = written(_directed(small.select(ends.alias("e")).select("e.u", "e.v")), "edges")
        discard(spark, path)
        now, path = after, after_path
        # A forest of stars: no node has two smaller neighbours or is both an end and a centre.
        heads = now.groupBy("u").agg(F.count("*").alias("n"))
        centres = now.select(F.col("v").alias("u")).distinct().withColumn("centre", F.lit(1))
        if heads.join(centres, "u", "left").where("n > 1 or centre = 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
