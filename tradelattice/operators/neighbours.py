"""Neighbourhood link scores for given candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


EDGES_IN_PART = 1024


def neighbour_scores(adj: DataFrame, candidates: DataFrame) -> DataFrame:
    """(node_u, node_v, adamic_adar, jaccard, cn) for every candidate pair of an undirected simple graph.

    The neighbours of the end with fewer of them are looked up among the edges of the other end, so a pair costs the smaller
    degree. The edges of a node are dealt to parts of about a thousand by hash and a pair meets each part on its own, so a
    hub's list is spread over many keys. ``adj`` is read several times: pass a written table. The two ends of a pair must be
    different nodes.
    """
    degree = degrees(adj)
    side = lambda end: degree.select(F.col("node").alias(end), F.col("degree").alias(f"_{end}"))
    pairs = candidates.select("node_u", "node_v").distinct().join(side("node_u"), "node_u", "left").join(side("node_v"), "node_v", "left")
    u_first = F.coalesce(F.col("_node_u") <= F.col("_node_v"), F.lit(False))
    parts = F.ceil(F.least("_node_u", "_node_v") / EDGES_IN_PART).cast("int")
    asked = pairs.where("_node_u IS NOT NULL AND _node_v IS NOT NULL").select(
        "node_u", "node_v", F.when(u_first, F.col("node_u")).otherwise(F.col("node_v")).alias("_few"),
        F.when(u_first, F.col("node_v")).otherwise(F.col("node_u")).alias("src"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"),
    )
    # Only one join knows the degree of the shared neighbour; the other asks whether the edge is there.
    own = degree.select(F.col("node").alias("_few"), F.ceil(F.col("degree") / EDGES_IN_PART).cast("int").alias("_parts"))
    lists = (
        adj.select(F.col("src").alias("_few"), "dst").join(own, "_few")
        .join(degree.select(F.col("node").alias("dst"), F.col("degree").alias("_w")), "dst")
        .select("_few", F.pmod(F.xxhash64("dst"), F.col("_parts")).cast("int").alias("_part"), "dst", "_w")
    )
    common = (
        asked.join(lists, ["_few", "_part"]).join(adj.select("src", "dst"), ["src", "dst"], "left_semi")
        .groupBy("node_u", "node_v").agg(F.count(F.lit(1)).alias("cn"), F.sum(1.0 / F.log("_w")).alias("adamic_adar"))
    )
    cn = F.coalesce("cn", F.lit(0).cast("bigint"))
    union = F.coalesce("_node_u", F.lit(0)) + F.coalesce("_node_v", F.lit(0)) - cn
    return pairs.join(common, ["node_u", "node_v"], "left").select(
        "node_u", "node_v", F.coalesce("adamic_adar", F.lit(0.0)).alias("adamic_adar"),
        F.when(union > 0, cn / union).otherwise(0.0).alias("jaccard"), cn.alias("cn"),
    )
