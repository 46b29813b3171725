"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node that an edge ``(u, v)`` names; ``component`` is the smallest node.

    The large star links each larger neighbour of a node to the smallest one, the
    small star each smaller neighbour; in turn they shrink every component to a
    star. Minima are combined before the shuffle, so that a hub costs one row for
    each task; the join back is a plain shuffled join, which adaptive execution
    splits where a hub is hot. Edges are written after each round, and those of the round before deleted. Loops, null
    ends and repeated edges are allowed and change nothing; an empty table gives
    an empty result.
    """
    edges = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") > F.col("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        last, edges = edges, stored(_small_star(_large_star(edges)).distinct(), "edges")
        discard(last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
