"""Node embeddings by propagation and by random walks. Vectors are ``(node, vector array<double>)`` tables.

A propagation step is one join of the edges with the vectors and one grouped aggregate with a buffer per
dimension, so edges are combined inside each task before the exchange and a hub's edges never meet in
one place. Loops write their state once per step, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tradelattice.functions import constants as K, scalars as S
from tradelattice.operators.neighbours import degrees
from tradelattice.operators.ordering import ranked
from tradelattice.session import stage


def _sums(vector: str, dim: int) -> list[Column]:
    return [F.sum(F.col(vector)[i]).alias(f"_d{i}") for i in range(dim)]


def _vector(dim: int, over: Column | None = None) -> Column:
    return F.array(*[F.col(f"_d{i}") if over is None else F.col(f"_d{i}") / over for i in range(dim)]).alias("vector")


def _mean(joined: DataFrame, keys: list, dim: int) -> DataFrame:
    """Mean vector per key: one sum per dimension and one shared count, which halves the aggregation buffer."""
    names = [k if isinstance(k, str) else "node" for k in keys]
    sums = joined.groupBy(*keys).agg(*_sums("vector", dim), F.count(F.lit(1)).alias("_n"))
    return sums.select(*names, _vector(dim, F.col("_n")))


def _scaled(vector: str, by: Column) -> Column:
    return F.transform(F.col(vector), lambda x: x * by)


def propagate(adj: DataFrame, vectors: DataFrame, dim: int, mode: str = "mean") -> DataFrame:
    """One neighbourhood aggregation over directed edges (src to dst).

    ``mean`` averages the in-neighbours; ``gcn`` sums them with 1 / sqrt(d_src d_dst), self loops included.
    """
    if mode == "mean":
        joined = adj.join(vectors.withColumnRenamed("node", "src"), "src")
        return _mean(joined, [F.col("dst").alias("node")], dim)
    if mode != "gcn":
        raise ValueError(f"unknown mode {mode}")
    # Both square roots are applied to node rows, before and after the sum over edges.
    degree = degrees(adj).withColumn("degree", F.col("degree") + 1)
    scaled = (
        vectors.join(degree, "node", "left")
        .withColumn("_w", F.lit(1.0) / F.sqrt(F.coalesce("degree", F.lit(1))))
        .select("node", _scaled("vector", F.col("_w")).alias("vector"), "_w")
    )
    sent = adj.join(scaled.select(F.col("node").alias("src"), "vector"), "src").select(F.col("dst").alias("node"), "vector")
    summed = (
        sent.unionByName(scaled.select("node", "vector")).groupBy("node")
        .agg(*_sums("vector", dim)).select("node", _vector(dim))
    )
    return summed.join(scaled.select("node", "_w"), "node").select("node", _scaled("vector", F.col("_w")).alias("vector"))


def propagate_hops(
    adj: DataFrame | Sequence[DataFrame], features: DataFrame, dim: int, layers: int = 2, mode: str = "mean"
) -> DataFrame:
    """Features, then 1 .. ``layers`` propagations of them, concatenated; a node not reached gets zeros.

    ``adj`` may be one table of sampled edges per layer instead of one for all.
    """
    zeros = F.array_repeat(F.lit(0.0), dim)
    current, out = features, features
    for used in [adj] * layers if isinstance(adj, DataFrame) else adj:
        current = stage(propagate(used, current, dim, mode), "hop")
        out = out.join(current.withColumnRenamed("vector", "_n"), "node", "left").select(
            "node", F.concat("vector", F.coalesce("_n", zeros)).alias("vector")
        )
    return out


def propagate_relations(
    edges: DataFrame | Sequence[DataFrame], features: DataFrame, dim: int, relations: Sequence[str], layers: int = 2, seed: int = K.SEED
) -> DataFrame:
    """The node's own vector and the mean over its neighbours by each of ``relations``, in blocks; ``layers`` times.

    Between layers the blocks go through a seeded sign projection back to ``dim`` numbers, negative ones cut off at zero.
    ``edges`` may be one table of sampled edges per layer instead of one for all.
    """
    first, *rest = [edges] * layers if isinstance(edges, DataFrame) else edges
    current = _relation_blocks(first, features, dim, relations)
    for layer, used in enumerate(rest, 1):
        current = stage(current, "relation-blocks").select("node", _projected("vector", (len(relations) + 1) * dim, dim, layer, seed).alias("vector"))
        current = _relation_blocks(used, stage(current, "relations"), dim, relations)
    return current


def _relation_blocks(edges: DataFrame, vectors: DataFrame, dim: int, relations: Sequence[str]) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), dim)
    per_rel = _mean(edges.join(vectors.withColumnRenamed("node", "src"), "src"), [F.col("dst").alias("node"), "rel"], dim)
    blocks = per_rel.groupBy("node").agg(
        *[F.max_by("vector", F.when(F.col("rel") == rel, 1)).alias(f"_r{k}") for k, rel in enumerate(relations)]
    )
    parts = [F.coalesce(f"_r{k}", zeros) for k in range(len(relations))]
    return vectors.join(blocks, "node", "left").select("node", F.concat("vector", *parts).alias("vector"))


def project(vectors: DataFrame, width: int, dim: int, seed: int = K.SEED) -> DataFrame:
    """Vectors of ``width`` numbers brought to ``dim`` numbers by a seeded sign projection."""
    return vectors.select("node", _projected("vector", width, dim, 0, seed, least=None).alias("vector"))


def _projected(vector: str, width: int, dim: int, layer: int, seed: int, least: float | None = 0.0) -> Column:
    """P x for a matrix of signs by hash, +1 or -1 for a sixth each, scaled to keep lengths; at least ``least``."""
    def sign(i: int, j: int) -> int:
        h = int(hashlib.md5(f"{layer}|{i}|{j}|{seed}".encode()).hexdigest()[:8], 16) % 6
        return {0: 1, 1: -1}.get(h, 0)

    rows = ", ".join(f"array({', '.join(str(sign(i, j)) for i in range(width))})" for j in range(dim))
    scale = math.sqrt(3.0 / dim)
    kept = (lambda x: x) if least is None else (lambda x: F.greatest(x, F.lit(least)))
    return F.transform(F.expr(f"array({rows})"), lambda row: kept(S.dot(row, vector) * scale))


def sparse_signs(nodes: DataFrame, dim: int, seed: int = K.SEED) -> DataFrame:
    """Very sparse random projection rows: +sqrt(3), 0, -sqrt(3) with probability 1/6, 2/3, 1/6, by hash."""
    root = F.lit(3.0 ** 0.5)

    def sign(i: Column) -> Column:
        h = F.pmod(S.hash32([F.col("node"), i], seed), F.lit(6))
        return F.when(h == 0, root).when(h == 1, -root).otherwise(F.lit(0.0))

    return nodes.select("node", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), sign).alias("vector"))


def fastrp(
    adj: DataFrame, dim: int = K.EMBEDDING_DIM, iterations: int = K.FASTRP_ITERATIONS,
    weights: Sequence[float] | None = None, seed: int = K.SEED,
) -> DataFrame:
    """Fast random projection: weighted sum of the length-normalised neighbourhood averages, normalised again.

    Default weights are 0 for the first iteration and 1 for the rest.
    """
    weights = list(weights) if weights is not None else [0.0] + [1.0] * (iterations - 1)
    current = sparse_signs(adj.select(F.col("src").alias("node")).distinct(), dim, seed)
    total = None
    for weight in weights[:iterations]:
        current = stage(propagate(adj, current, dim, "mean"), "projection")
        if weight == 0:
            continue
        part = current.select("node", _scaled_unit("vector", weight).alias("vector"))
        total = part if total is None else total.join(part.withColumnRenamed("vector", "_n"), "node").select(
            "node", F.zip_with("vector", "_n", lambda x, y: x + y).alias("vector")
        )
    if total is None:
        raise ValueError("all iteration weights are zero")
    return total.select("node", S.l2_normalised("vector").alias("vector"))


def _scaled_unit(vector: str, weight: float) -> Column:
    return F.transform(S.l2_normalised(vector), lambda x: x * F.lit(float(weight)))


# --- random walks --------------------------------------------------------------------------------


def indexed_neighbours(adj: DataFrame) -> DataFrame:
    """Neighbour lists as rows (src, idx, dst, dst_degree), idx from 0.

    A walker picks a neighbour by one equi join on (src, idx), so a hub's list is spread over many keys.
    """
    numbered = ranked(adj.select("src", "dst"), [F.asc("dst")], by=["src"], rank="idx")
    degree = degrees(adj).select(F.col("node").alias("dst"), F.col("degree").alias("dst_degree"))
    return numbered.withColumn("idx", F.col("idx") - 1).join(degree, "dst").select("src", "idx", "dst", "dst_degree")


def random_walks(
    adj: DataFrame, length: int = K.WALK_LENGTH, per_node: int = K.WALKS_PER_NODE, p: float = 1.0, q: float = 1.0,
    seed: int = K.SEED, write_every: int = 10,
) -> DataFrame:
    """``per_node`` walks of ``length`` nodes from every node: (start, walk, path).

    Choices are hashes of (start, walk, step), so walks do not depend on partitioning. With p = q = 1 the
    next node is a uniform neighbour; otherwise it also depends on the node before (second order).

    A walker carries the nodes of its last ``write_every`` steps only; then they are written and it goes on with none. The
    stretches are put together once at the end, so what is shuffled grows with the length and not with its square.
    """
    index = stage(indexed_neighbours(adj), "neighbours")
    walkers = degrees(adj).select(
        F.col("node").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"),
        F.array("node").alias("path"), F.lit(None).cast(adj.schema["src"].dataType).alias("before"), F.col("node").alias("at"),
        F.col("degree").alias("at_degree"),
    )
    stretches = []
    for step in range(1, length):
        if step == 1 or (p == 1.0 and q == 1.0):
            walkers = _move(walkers, index, step, seed)
        else:
            walkers = _move_second_order(stage(walkers, "walkers"), index, step, p, q, seed)
        if step % write_every == 0:
            walkers = stage(walkers, "walkers")
            stretches.append(walkers.select("start", "walk", F.lit(step).alias("_upto"), "path"))
            walkers = walkers.withColumn("path", F.expr("filter(path, x -> false)"))
    stretches.append(walkers.select("start", "walk", F.lit(length).alias("_upto"), "path"))
    if len(stretches) == 1:
        return stretches[0].drop("_upto")
    every = reduce(DataFrame.unionByName, stretches).groupBy("start", "walk").agg(F.sort_array(F.collect_list(F.struct("_upto", "path"))).alias("_s"))
    return every.select("start", "walk", F.flatten(F.transform("_s", lambda s: s["path"])).alias("path"))


def _move(walkers: DataFrame, index: DataFrame, step: int, seed: int) -> DataFrame:
    pick = F.pmod(S.hash32(["start", "walk", F.lit(step)], seed), F.col("at_degree"))
    to = index.select(F.col("src").alias("at"), F.col("idx").alias("_pick"), "dst", "dst_degree")
    return _arrived(walkers.withColumn("_pick", pick).join(to, ["at", "_pick"]), F.col("dst"), F.col("dst_degree"))


def _arrived(walkers: DataFrame, node: Column, degree: Column) -> DataFrame:
    return walkers.select(
        "start", "walk", F.concat("path", F.array(node)).alias("path"), F.col("at").alias("before"), node.alias("at"), degree.alias("at_degree"),
    )


def _unit(*parts: Column | str, seed: int) -> Column:
    return (S.hash32(parts, seed) + F.lit(0.5)) / F.lit(float(2 ** 32))


def _move_second_order(
    walkers: DataFrame, index: DataFrame, step: int, p: float, q: float, seed: int, tries: int = 8
) -> DataFrame:
    """Biased step by rejection: uniform proposals, accepted with weight / largest weight.

    Weights are 1/p back to the node before, 1 to its neighbours, 1/q elsewhere. Walkers whose proposals
    are all rejected draw from their full weighted neighbour list, which keeps the step exact.
    """
    top = max(1.0 / p, 1.0, 1.0 / q)
    walkers = walkers.withColumnRenamed("before", "_before")
    edges = index.select(F.col("src").alias("_before"), "dst").withColumn("_near", F.lit(True))
    to = index.select(F.col("src").alias("at"), F.col("idx").alias("_pick"), "dst", "dst_degree")
    weight = F.when(F.col("dst") == F.col("_before"), 1.0 / p).when(F.col("_near"), 1.0).otherwise(1.0 / q)
    key = ["start", "walk"]

    proposals = walkers.select(
        *key, "at", "at_degree", "_before", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("_try")
    ).withColumn("_pick", F.pmod(S.hash32(["start", "walk", F.lit(step), "_try"], seed), F.col("at_degree")))
    accepted = (
        proposals.join(to, ["at", "_pick"]).join(edges, ["_before", "dst"], "left")
        .where(_unit("start", "walk", F.lit(step), "_try", F.lit("accept"), seed=seed) * top < weight)
        .groupBy(*key).agg(F.min_by(F.struct("dst", "dst_degree"), "_try").alias("_to"))
    )
    # Exponential clocks: the smallest -ln(u) / weight is neighbour x with probability proportional to its weight.
    left = walkers.join(accepted, key, "left_anti").join(to, "at").join(edges, ["_before", "dst"], "left")
    clock = -F.log(_unit("start", "walk", F.lit(step), "dst", seed=seed)) / weight
    drawn = left.withColumn("_clock", clock).groupBy(*key).agg(F.min_by(F.struct("dst", "dst_degree"), "_clock").alias("_to"))
    return _arrived(walkers.join(accepted.unionByName(drawn), key), F.col("_to.dst"), F.col("_to.dst_degree"))


# --- skip-gram -----------------------------------------------------------------------------------


def window_counts(walks: DataFrame, window: int = 5) -> DataFrame:
    """(center, context, n): how often two nodes stand within ``window`` steps of one another in a path, both ways."""
    def apart(o: int) -> Column:
        left = F.greatest(F.size("path") - o, F.lit(0))
        return F.zip_with(F.slice("path", F.lit(1), left), F.slice("path", F.lit(1 + o), left), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    met = walks.select(F.explode(F.flatten(F.array(*[apart(o) for o in range(1, window + 1)]))).alias("m")).groupBy("m.a", "m.b").agg(
        F.count(F.lit(1)).alias("n"))
    both = met.select(F.col("a").alias("center"), F.col("b").alias("context"), "n").unionByName(
        met.select(F.col("b").alias("center"), F.col("a").alias("context"), "n"))
    return both.groupBy("center", "context").agg(F.sum("n").alias("n"))


NODES_IN_BLOCK = 4096
UNIGRAM = 0.75


def skip_gram(
    counts: DataFrame, dim: int = K.EMBEDDING_DIM, negatives: int = 5, seed: int = K.SEED, tolerance: float = 5e-3, max_epochs: int = 40,
    steps: int = 25, blocks: int | None = None,
) -> DataFrame:
    """Vectors by skip-gram with negative sampling from (center, context, n): (node, vector) of the centers.

    Vectors are rows keyed by node, one as center and one as context. Nodes are dealt to ``blocks`` by hash, by default of
    about 4096; a group of one block of centers and one of contexts takes their vectors, their counts and negative contexts
    drawn by count to the power 3/4, and follows the gradient for some steps. In one round every block is in one group, so
    groups work side by side and each vector changes in one place; as many rounds as blocks make an epoch, in which every
    count was used. Epochs end when the mean loss falls by less than ``tolerance`` of itself, or raise.
    """
    counts = stage(counts.select(F.col("center").cast("string").alias("center"), F.col("context").cast("string").alias("context"), "n"), "counts")
    sizes = counts.agg(F.approx_count_distinct("center"), F.sum("n")).first()
    if not sizes[1]:
        return counts.select(F.col("center").alias("node"), F.array(F.lit(0.0)).alias("vector")).limit(0)
    blocks = blocks or max(1, -(-sizes[0] // NODES_IN_BLOCK))
    block = lambda c: F.pmod(S.hash32([c], seed), F.lit(blocks)).cast("int")
    totals = counts.groupBy(F.col("context").alias("node")).agg(F.sum("n").alias("n"))
    mass = totals.agg(F.sum((F.pow("n", F.lit(UNIGRAM)) * 1e6).cast("decimal(38,0)"))).first()[0]  # the same in any order
    mass = float(mass) / 1e6
    spread = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (S.hash32(["node", "side", i], seed) / F.lit(2.0 ** 32) - 0.5) / dim)
    of = lambda side, df: df.select("node", F.lit(side).alias("side"), "weight")
    centers = counts.groupBy(F.col("center").alias("node")).agg(F.sum("n").cast("double").alias("weight"))
    vectors = of("center", centers).unionByName(of("context", totals.withColumn("weight", F.pow("n", F.lit(UNIGRAM)) / mass)))
    vectors = stage(vectors.withColumns({
        "block": block(F.col("node")), "vector": spread, "squares": F.array_repeat(F.lit(0.0), dim), "loss": F.lit(0.0),
    }), "vectors")
    pairs = stage(counts.withColumns({"i": block(F.col("center")), "j": block(F.col("context"))}), "pairs")
    before = float("inf")
    for _ in range(max_epochs):
        loss = 0.0
        for shift in range(blocks):
            vectors = stage(_round(pairs, vectors, shift, blocks, dim, negatives, seed, steps), "vectors")
            loss += vectors.agg(F.sum("loss")).first()[0]
        if before - loss <= tolerance * before:
            return vectors.where("side = 'center'").select("node", "vector")
        before = loss
    raise RuntimeError(f"skip-gram did not settle in {max_epochs} epochs: loss {loss:.6g}")


VECTOR_ROWS = "node string, side string, weight double, block int, vector array<double>, squares array<double>, loss double"


def _round(pairs: DataFrame, vectors: DataFrame, shift: int, blocks: int, dim: int, negatives: int, seed: int, steps: int) -> DataFrame:
    """The vectors after the groups (block of centers i, block of contexts i + shift) have worked on theirs."""
    group = F.when(F.col("side") == "center", F.col("block")).otherwise(F.pmod(F.col("block") - shift, F.lit(blocks)))
    rows = vectors.drop("loss").withColumn("group", group)
    used = pairs.where(F.pmod(F.col("j") - F.col("i"), F.lit(blocks)) == shift).select(
        F.col("i").alias("group"), F.col("center").alias("node"), F.lit("pair").alias("side"), F.col("n").cast("double").alias("weight"), "context")

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["side", "node", "context"], ignore_index=True, na_position="first")
        kept = own[own["side"] != "pair"].drop(columns=["group", "context"])
        found = own[own["side"] == "pair"]
        center, context = kept[kept["side"] == "center"], kept[kept["side"] == "context"]
        kept = kept.assign(loss=0.0)
        if len(found):
            c, x = np.searchsorted(center["node"].to_numpy(str), found["node"].to_numpy(str)), np.searchsorted(context["node"].to_numpy(str), found["context"].to_numpy(str))
            u, v = (np.array(side["vector"].tolist()) for side in (center, context))
            su, sv = (np.array(side["squares"].tolist()) for side in (center, context))
            share = context["weight"].to_numpy()
            drawn = np.random.default_rng([seed, key[0], shift]).choice(len(context), len(c) * negatives, p=share / share.sum())
            against = np.repeat(c, negatives)
            # All of a center's negatives in these contexts weigh as much as the counts would have them.
            weigh = negatives * center["weight"].to_numpy() * share.sum() / np.maximum(np.bincount(against, minlength=len(center)), 1)
            cells, at = np.unique(np.concatenate([c, against]) * len(context) + np.concatenate([x, drawn]), return_inverse=True)
            rows_c, rows_x = cells // len(context), cells % len(context)
            scale = center["weight"].to_numpy().mean()
            with_ = np.bincount(at[:len(c)], found["weight"].to_numpy(), len(cells)) / scale
            without = np.bincount(at[len(c):], weigh[against], len(cells)) / scale
            gradient = _gradient(rows_c, rows_x, with_, without, (len(center), len(context)))
            for _ in range(steps):
                gu, gv = gradient(u, v)
                su, sv = su + gu * gu, sv + gv * gv
                u, v = u + LEARNING_RATE * gu / np.sqrt(su + 1e-12), v + LEARNING_RATE * gv / np.sqrt(sv + 1e-12)
            s = np.einsum("ij,ij->i", u[rows_c], v[rows_x])
            loss = float(scale * (with_ @ np.logaddexp(0, -s) + without @ np.logaddexp(0, s)))
            kept = kept.assign(vector=[*u, *v], squares=[*su, *sv])
            kept.iloc[0, kept.columns.get_loc("loss")] = loss
        return kept[["node", "side", "weight", "block", "vector", "squares", "loss"]]

    return rows.unionByName(used, allowMissingColumns=True).groupBy("group").applyInPandas(work, VECTOR_ROWS)


LEARNING_RATE = 0.1


def _gradient(
    rows: np.ndarray, columns: np.ndarray, with_: np.ndarray, without: np.ndarray, shape: tuple[int, int]
) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The gradient by both sides of sum(with log s(uv) + without log s(-uv)) over cells sorted by row and column.

    Cells that fill much of the block are multiplied as a matrix, few ones as a list.
    """
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    if shape[0] * shape[1] <= 4 * len(rows):
        plus, minus = np.zeros(shape), np.zeros(shape)
        plus[rows, columns], minus[rows, columns] = with_, without

        def dense(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            close = sigmoid(u @ v.T)
            pull = plus * (1 - close) - minus * close
            return pull @ v, pull.T @ u

        return dense
    by_row, by_column = _summing(rows, shape[0]), _summing(columns, shape[1])

    def sparse(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, other = u[rows], v[columns]
        close = sigmoid(np.einsum("ij,ij->i", own, other))
        pull = (with_ * (1 - close) - without * close)[:, None]
        return by_row(pull * other), by_column(pull * own)

    return sparse


def _summing(places: np.ndarray, count: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of rows by place, in a fixed order."""
    order = np.argsort(places, kind="stable")
    present, begins = np.unique(places[order], return_index=True)

    def summed(rows: np.ndarray) -> np.ndarray:
        total = np.zeros((count, rows.shape[1]))
        total[present] = np.add.reduceat(rows[order], begins, axis=0)
        return total

    return summed


def node2vec(
    adj: DataFrame, dim: int = K.EMBEDDING_DIM, length: int = K.WALK_LENGTH, per_node: int = K.WALKS_PER_NODE,
    p: float = 1.0, q: float = 1.0, seed: int = K.SEED, window: int = 5,
) -> DataFrame:
    """Skip-gram vectors of random-walk paths: (node, vector)."""
    walks = stage(random_walks(adj, length, per_node, p, q, seed), "walks")
    return skip_gram(window_counts(walks, window), dim, seed=seed)
