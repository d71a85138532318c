"""Connected components by alternating star contraction, all in DataFrame operations.

Each round is two grouped minima and two equi joins, so a vertex with millions of neighbours is
pre-aggregated on the map side and its join rows can be split by adaptive execution; no vertex's
neighbours are ever collected. Rounds are O(log n); every round's edges go to the shared
checkpoint folder, in place of those of the round before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.operators.lineage import Scratch


def _lowest_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_lowest_neighbour(both), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them; edges have u > v."""
    low = _lowest_neighbour(edges)
    joined = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, held: Scratch | None = None) -> DataFrame:
    """``node, component`` (the least node reachable) of every node in ``edges`` (u, v; any order).

    Loops and repeated edges are allowed, edges with a null end are ignored. Nodes without an edge
    to another node are not returned. An empty input gives an empty output. The result reads a table of
    ``held``, if given, or one that stays as long as the program.
    """
    held = held or Scratch(edges.sparkSession)
    now = held.keep(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        last, now = now, held.keep(_small_star(_large_star(now)))
        held.drop(last)
        # Stars are reached when one more round leaves the same edges; sums of hashes tell.
        found = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if found == state or found[0] == 0:
            break
        state = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
