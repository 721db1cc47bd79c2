"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is one aggregate and one join over the links; each link comes out as one link, so nothing grows with the
square of a group. Every state is a written table, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tradelattice.session import stage

STEPS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each end of the links (a, b) reaches. Nodes without links are absent."""
    edges = stage(
        links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    for _ in range(STEPS):
        seen = Observation()
        edges = small_star(large_star(edges), seen)
        state = seen.get
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
    raise RuntimeError(f"components did not settle in {STEPS} steps")


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    # A larger neighbour v of u is a link (v, u): the node to look up is the smaller end.
    joined = edges.join(least.withColumnRenamed("u", "v"), "v")
    return stage(joined.select("u", F.col("m").alias("v")).distinct(), "large-star")


def small_star(edges: DataFrame, seen: Observation) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, to its smallest neighbour."""
    least = stage(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return stage(moved.unionByName(kept).distinct().observe(seen, F.count(F.lit(1)).alias("links"), digest.alias("digest")), "small-star")
