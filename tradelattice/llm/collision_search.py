"""Nearest neighbours by collision counting over query-centred windows of single projections.

Rows are dealt into blocks of bounded size. In a block, every projection is a sorted array. A query opens a window around its
own projection in each array and widens all windows round by round (virtual rehashing); a row that has fallen into
more than ``share`` of them is verified by its exact distance. A query ends when its k-th verified distance is within
the radius of its windows, or the block is exhausted. Blocks' best rows are merged per query.

Defined results: rows without id, without vector, with null or non-finite components or zero vectors take no part;
of rows that repeat an id the smallest vector takes part; vectors of different length never meet; a query is never its
own neighbour; ties go to the smaller id; with fewer candidates than k all are returned; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelattice.llm.common import shares
from tradelattice.session import stage


@dataclass(frozen=True)
class Settings:
    """``width``: of a window at radius 1; ``growth``: of the radius a round; ``share``: of windows that a row must be in."""

    projections: int = 64
    width: float = 2.7
    growth: float = 1.25
    share: float = 0.65
    block_rows: int = 8192
    block_queries: int = 4096
    seed: int = 3


class SortedProjections:
    def __init__(self, vectors: np.ndarray, settings: Settings):
        self.vectors, self.settings = vectors, settings
        self.lines = np.random.default_rng([settings.seed, vectors.shape[1]]).normal(size=(vectors.shape[1], settings.projections))
        projected = vectors @ self.lines
        self.order = np.argsort(projected, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(projected.T, self.order, axis=1)

    def first_radius(self, k: int, probes: int = 8) -> float:
        """Half the usual distance of a row's k-th nearest, by a few rows evenly taken; at copies, what one row's share of the spread is worth.

        A larger first radius only verifies more rows in the first round, so it loses none.
        """
        n = len(self.vectors)
        taken = self.vectors[np.linspace(0, n - 1, min(n, probes)).astype(np.int64)]
        usual = np.median([np.partition(((self.vectors - row) ** 2).sum(axis=1), min(k, n - 1))[min(k, n - 1)] for row in taken])
        spread = np.median(self.values[:, -1] - self.values[:, 0])
        return max(float(np.sqrt(usual)) / 2, float(spread) / (n + 1) / self.settings.width, 1e-12)

    def nearest(self, query: np.ndarray, k: int, left_out: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact distances of the rows verified, nearest first, at most all but ``left_out``."""
        s, n = self.settings, len(self.vectors)
        centre = query @ self.lines
        low = np.array([np.searchsorted(v, c) for v, c in zip(self.values, centre)])
        high, counts = low.copy(), np.zeros(n, np.int32)
        verified = left_out.copy()
        found, distances = [np.zeros(0, np.int64)], [np.zeros(0)]
        radius, need = first, int(s.share * s.projections)
        while True:
            half = s.width * radius / 2
            for j in range(s.projections):
                values, order = self.values[j], self.order[j]
                a, b = np.searchsorted(values, centre[j] - half, "left"), np.searchsorted(values, centre[j] + half, "right")
                if a < low[j]:
                    counts[order[a:low[j]]] += 1
                    low[j] = a
                if b > high[j]:
                    counts[order[high[j]:b]] += 1
                    high[j] = b
            fresh = np.flatnonzero((counts > need) & ~verified)
            if len(fresh):
                verified[fresh] = True
                found.append(fresh)
                distances.append(np.sqrt(((self.vectors[fresh] - query) ** 2).sum(axis=1)))
            near = np.concatenate(distances)
            if (len(near) >= k and np.partition(near, k - 1)[k - 1] <= radius) or (high - low).min() == n:
                return np.concatenate(found), near
            radius *= s.growth


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    return rows.where(good).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def search(rows: DataFrame, is_query: Column, k: int, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (over vec_id) its k nearest by Euclidean distance."""
    clean = stage(usable(rows).withColumn("is_query", is_query).withColumn("length", F.size("vector")), "vectors")
    total, asked = clean.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    blocks, query_blocks = shares(total, settings.block_rows), shares(asked, settings.block_queries)
    mixed = F.xxhash64("vec_id")
    held = clean.withColumn("block", F.pmod(mixed, F.lit(blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select("length", "block", "part", "vec_id", "vector")
    queries = clean.where("is_query").withColumn("part", F.pmod(mixed, F.lit(query_blocks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select("length", "block", "part", "vec_id", "vector")

    def run(key, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            own = own.sort_values("vec_id")
            ids = own["vec_id"].to_numpy()
            index = SortedProjections(np.stack(own["vector"].to_numpy()).astype(np.float64), settings)
            first = index.first_radius(k)
            for query_id, query in zip(asked["vec_id"], asked["vector"]):
                places, distances = index.nearest(np.asarray(query, np.float64), k, ids == query_id, first)
                best = np.lexsort([ids[places], distances])[:k]
                out += [(query_id, ids[places[b]], distances[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    keys = ["length", "block", "part"]
    found = held.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
