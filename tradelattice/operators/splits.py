"""Train, validation and test splits, negative pairs and neighbour samples, all by stable hashes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tradelattice.functions import constants as K, scalars as S
from tradelattice.operators.ordering import ranked, top_k_per
from tradelattice.session import stage

SPLITS = ["train", "val", "test"]


def temporal_split(
    edges: DataFrame, train_end: int = K.TRAIN_END_YEAR, val_year: int = K.VAL_YEAR,
    test_years: Sequence[int] = tuple(K.TEST_YEARS), new_links_only: bool = True, by_year: bool = False,
) -> DataFrame:
    """Positive pairs (src, dst, split) by year.

    With ``new_links_only`` a pair belongs to the first split it occurs in, so validation and test hold
    links that did not exist before; one aggregation decides it. ``by_year`` keeps the year instead: the
    links (src, dst, year, split) of every year are links of their own.
    """
    order = (
        F.when(F.col("year") <= train_end, 0).when(F.col("year") == val_year, 1)
        .when(F.col("year").isin(list(test_years)), 2)
    )
    name = F.element_at(F.lit(SPLITS), F.col("_k") + 1).alias("split")
    if by_year:
        dated = edges.select("src", "dst", "year").distinct().withColumn("_k", order)
        return dated.where("_k IS NOT NULL").select("src", "dst", "year", name)
    tagged = edges.select("src", "dst", order.alias("_k")).where("_k IS NOT NULL")
    if new_links_only:
        tagged = tagged.groupBy("src", "dst").agg(F.min("_k").alias("_k"))
    else:
        tagged = tagged.distinct()
    return tagged.select("src", "dst", name)


def random_split(
    edges: DataFrame, ratios: tuple[float, float, float] = K.SPLIT_RATIOS, seed: int = K.SEED
) -> DataFrame:
    """Pairs (src, dst, split) by a stable hash of the pair: the same pair always falls in the same split."""
    bucket = S.hash_bucket(["src", "dst"], seed, 10000)
    first, second = round(ratios[0] * 10000), round((ratios[0] + ratios[1]) * 10000)
    split = F.when(bucket < first, "train").when(bucket < second, "val").otherwise("test")
    return edges.select("src", "dst").distinct().withColumn("split", split)


def propagation_edges(edges: DataFrame, positives: DataFrame) -> DataFrame:
    """Edges left for message passing: without the validation and test links, by year where both have one."""
    keys = ["src", "dst", *(["year"] if "year" in edges.columns and "year" in positives.columns else [])]
    return edges.join(positives.where("split <> 'train'").select(keys), keys, "left_anti")


def shuffle_key(*parts: str, seed: int = K.SEED) -> Column:
    """Random-looking total order that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def numbered(nodes: DataFrame, column: str) -> DataFrame:
    """(column, _i): the distinct values with their place in order, from 0."""
    return ranked(nodes.select(column).distinct(), [F.asc(column)], rank="_i").withColumn("_i", F.col("_i") - 1)


def negatives(
    positives: DataFrame, sources: DataFrame, targets: DataFrame, ratio: int = 1, keys: Sequence[str] = (), seed: int = K.SEED,
    or_all_free: bool = False,
) -> DataFrame:
    """``ratio`` negative links per positive of each split: (src, dst, *keys, split).

    ``sources`` (src) and ``targets`` (dst) are the nodes; ``keys`` such as the year belong to a link. A link is drawn by
    number: a hash of the draw picks the place of its source, its target and, per key, one of the values that the split's
    positives have. Draws that repeat one another, a positive of any split, or a negative of a split before are passed over,
    and draws go on until there are enough, so the product of the nodes is never built. The first that are left are taken.
    A split that asks for more links than are free raises or, with ``or_all_free``, gets every free link.
    """
    link = ["src", "dst", *keys]
    nodes = {c: stage(numbered(df, c), "numbered") for c, df in (("src", sources), ("dst", targets))}
    count = {c: df.count() for c, df in nodes.items()}
    wanted = {r["split"]: r["count"] * ratio for r in positives.groupBy("split").count().collect()}
    taken, parts = stage(positives.select(link).distinct(), "taken"), []
    for split in SPLITS:
        need = wanted.get(split, 0)
        if not need:
            continue
        places = dict(nodes)
        places |= {c: stage(numbered(positives.where(F.col("split") == split), c), "numbered") for c in keys}
        size = {c: count[c] if c in count else places[c].count() for c in places}
        domain = math.prod(size.values())
        free = domain - _inside(taken, places).count()
        if need > free and not or_all_free:
            raise ValueError(f"{split}: {need} negative links wanted, {free} free")
        if need >= free:
            first = _every(places, size).join(taken, link, "left_anti")
        else:
            draws = 2 * need * domain // free + 100
            while True:
                drawn = stage(_drawn(draws, split, places, size, seed).join(taken, link, "left_anti"), "drawn")
                if drawn.count() >= need:
                    break
                draws *= 2
            first = ranked(drawn, [F.asc("_n")], rank="_rank").where(F.col("_rank") <= need)
        parts.append(stage(first.select(*link, F.lit(split).alias("split")), "negatives"))
        taken = taken.unionByName(parts[-1].select(link))
    if not parts:
        return positives.select(*link, "split").limit(0)
    return reduce(DataFrame.unionByName, parts)


def _inside(links: DataFrame, places: dict[str, DataFrame]) -> DataFrame:
    """The links whose every column is among the places."""
    for column, values in places.items():
        links = links.join(values.select(column), column, "left_semi")
    return links


def _drawn(draws: int, split: str, places: dict[str, DataFrame], size: dict[str, int], seed: int) -> DataFrame:
    """Distinct links of the first ``draws`` draws, each with its first draw ``_n``."""
    rows = places["src"].sparkSession.range(draws).select(F.col("id").alias("_n"))
    for column in places:
        pick = F.pmod(S.hash32([F.lit(split), F.lit(column), "_n"], seed), F.lit(size[column]))
        rows = rows.withColumn("_i", pick).join(places[column], "_i").drop("_i")
    return rows.groupBy(*places).agg(F.min("_n").alias("_n"))


def _every(places: dict[str, DataFrame], size: dict[str, int]) -> DataFrame:
    """All links there are. Asked for only where no more are free than wanted, so they are a few for every link that is taken."""
    rows, below = places["src"].sparkSession.range(math.prod(size.values())), 1
    for column in places:
        place = F.expr(f"id div {below} % {size[column]}")
        rows = rows.withColumn("_i", place).join(places[column], "_i").drop("_i")
        below *= size[column]
    return rows.drop("id")


def labelled(positives: DataFrame, negative: DataFrame) -> DataFrame:
    """The columns of the positives, with label 1 for them and 0 for the negatives."""
    one = positives.withColumn("label", F.lit(1))
    return one.unionByName(negative.select(positives.columns).withColumn("label", F.lit(0)))


def sample_neighbours(edges: DataFrame, k: int, seed: int = K.SEED) -> DataFrame:
    """At most ``k`` incoming edges per (dst, rel), uniformly by hash order."""
    keyed = edges.withColumn("_key", shuffle_key("src", "rel", "dst", seed=seed))
    return top_k_per(keyed, ["dst", "rel"], [F.col("_key"), F.col("src")], k, "_n").drop("_key", "_n")


def sample_layers(edges: DataFrame, per_layer: Sequence[int] = tuple(K.NEIGHBOUR_SAMPLES), seed: int = K.SEED) -> list[DataFrame]:
    """The edges that each propagation layer uses, first layer first.

    Samples are drawn from the outputs inwards: ``per_layer[0]`` incoming edges per node and relation for the last layer,
    ``per_layer[1]`` for the one before it, and so on, each with a seed of its own.
    """
    return [stage(sample_neighbours(edges, k, seed + hop), "sample") for hop, k in enumerate(per_layer)][::-1]
