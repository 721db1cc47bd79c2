"""Decoders: scores of node pairs out of their vectors, fitted with Spark ML, and model selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tradelattice.functions import constants as K, scalars as S
from tradelattice.operators import embeddings as E, splits as Z
from tradelattice.operators.evaluation import average_precision
from tradelattice.session import stage


def pair_vectors(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (src, dst, ...) with the vectors of both ends as ``zu`` and ``zv``; an end without a vector has a zero vector."""
    end = lambda node, z: vectors.select(F.col("node").alias(node), F.col("vector").alias(z))
    zero = F.array_repeat(F.lit(0.0), vectors.agg(F.max(F.size("vector"))).first()[0] or 0)
    both = pairs.join(end("src", "zu"), "src", "left").join(end("dst", "zv"), "dst", "left")
    return both.withColumns({z: F.coalesce(z, zero) for z in ("zu", "zv")})


def dot_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    return pair_vectors(pairs, vectors).withColumn("score", S.dot("zu", "zv")).drop("zu", "zv")


def distmult_scores(pairs: DataFrame, vectors: DataFrame, relation: Sequence[float]) -> DataFrame:
    """z_u' diag(R) z_v for the given diagonal of the relation."""
    weights = F.lit([float(w) for w in relation])
    product = F.zip_with(S.hadamard("zu", "zv"), weights, lambda x, w: x * w)
    total = F.aggregate(product, F.lit(0.0), lambda a, x: a + x)
    return pair_vectors(pairs, vectors).withColumn("score", total).drop("zu", "zv")


def hadamard_features() -> Column:
    return S.hadamard("zu", "zv")


def concatenated_features() -> Column:
    return F.concat("zu", "zv")


def geometry_features() -> Column:
    """Element products, squared distance and cosine of the two vectors."""
    gap = F.zip_with("zu", "zv", lambda x, y: (x - y) * (x - y))
    distance = F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)
    cosine = F.coalesce(F.try_divide(S.dot("zu", "zv"), S.l2_norm("zu") * S.l2_norm("zv")), F.lit(0.0))
    return F.concat(S.hadamard("zu", "zv"), F.array(distance, cosine))


FEATURES: dict[str, Callable[[], Column]] = {
    "distmult": hadamard_features, "embedding": geometry_features, "mlp": concatenated_features,
}
DECODERS = ["dot_product", *FEATURES]
MOST_STEPS, PERCEPTRON_STEPS = 500, 100


def _literal(values: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


@dataclass(frozen=True)
class Layer:
    """Weights by output and input, and a bias by output; every output goes through a sigmoid."""

    weights: Sequence[Sequence[float]]
    bias: Sequence[float]

    def apply(self, x: Column) -> Column:
        rows = F.expr(f"array({', '.join(map(_literal, self.weights))})")
        return F.zip_with(rows, F.expr(_literal(self.bias)), lambda w, b: _sigmoid(b + S.dot(w, x)))


@dataclass(frozen=True)
class Decoder:
    """A decoder as numbers: its name, which says how ``zu`` and ``zv`` become features, and its layers, the last of one output.

    Scores are column expressions of these numbers, so no fitted model travels with a plan. ``dot_product`` has no layers.
    """

    name: str
    layers: Sequence[Layer] = ()
    converged: bool = True

    def expression(self) -> Column:
        """The score of ``zu`` and ``zv``."""
        if not self.layers:
            return S.dot("zu", "zv")
        x = FEATURES[self.name]()
        for layer in self.layers:
            x = layer.apply(x)
        return x[0]

    def score(self, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
        """``pairs`` with ``score``; every pair has a score."""
        return score_all({"score": self}, pairs, vectors)

    def relation(self) -> list[float]:
        """Diagonal of the relation, for the decoder that is linear in the element products."""
        return list(self.layers[0].weights[0])


def score_all(decoders: dict[str, Decoder], pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with a score column for each decoder, in one join with the vectors."""
    return pair_vectors(pairs, vectors).withColumns({n: d.expression() for n, d in decoders.items()}).select(*pairs.columns, *decoders)


def fit_model(name: str, training: DataFrame, vectors: DataFrame, dim: int, seed: int = K.SEED) -> Model:
    """The Spark ML model of a decoder on labelled training pairs, ``features`` to ``probability``."""
    if name in ("distmult", "embedding"):
        learner = LogisticRegression(maxIter=MOST_STEPS, regParam=1e-4)
    elif name == "mlp":
        learner = MultilayerPerceptronClassifier(layers=[2 * dim, K.MLP_HIDDEN, 2], maxIter=PERCEPTRON_STEPS, seed=seed)
    else:
        raise ValueError(f"unknown decoder {name}")
    # Iterative fits read their input many times, so it is written once.
    return learner.fit(stage(model_inputs(name, training.select("src", "dst", "label"), vectors), "training"))


def model_inputs(name: str, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    return pair_vectors(pairs, vectors).withColumn("features", array_to_vector(FEATURES[name]())).drop("zu", "zv")


def fit_decoder(name: str, training: DataFrame, vectors: DataFrame, dim: int, seed: int = K.SEED) -> Decoder:
    """Fit ``dot_product`` (nothing to fit), ``distmult``, ``mlp`` or ``embedding`` on labelled training pairs.

    A convex fit that has not settled raises; the perceptron, which is not convex, says so in ``converged``.
    """
    if name == "dot_product":
        return Decoder(name)
    return decoder_of(name, fit_model(name, training, vectors, dim, seed), dim)


def decoder_of(name: str, model: Model, dim: int) -> Decoder:
    """The numbers of a fitted model."""
    if name == "mlp":
        return Decoder(name, perceptron_layers(model.weights.toArray(), 2 * dim), model.summary().totalIterations < PERCEPTRON_STEPS)
    if model.summary.totalIterations >= MOST_STEPS:
        raise RuntimeError(f"{name} did not settle in {MOST_STEPS} steps")
    return Decoder(name, (Layer([[float(x) for x in model.coefficients]], [float(model.intercept)]),))


def perceptron_layers(weights: np.ndarray, inputs: int) -> tuple[Layer, Layer]:
    """Two layers out of the flat weights of a perceptron with two classes: per layer a matrix by columns, then its bias.

    The softmax of two outputs is the sigmoid of their difference, so the last layer has one output.
    """
    hidden = K.MLP_HIDDEN
    first, rest = np.split(np.asarray(weights, float), [hidden * (inputs + 1)])
    matrix = lambda flat, n_in, n_out: (flat[:n_in * n_out].reshape(n_in, n_out).T, flat[n_in * n_out:])
    (w, b), (v, c) = matrix(first, inputs, hidden), matrix(rest, hidden, 2)
    return Layer(w.tolist(), b.tolist()), Layer([(v[1] - v[0]).tolist()], [float(c[1] - c[0])])


# --- link prediction -----------------------------------------------------------------------------


def encode(
    edges: DataFrame, features: DataFrame, encoder: str, dim: int, layers: int = 2, relations: Sequence[str] = K.RELATIONS,
    samples: Sequence[int] | None = None,
) -> tuple[DataFrame, int]:
    """Vectors of an encoder by name and their width.

    ``edges`` is (src, rel, dst) in both directions; ``sage`` and ``gcn`` ignore the relation, ``rgcn`` keeps
    one block per relation, ``fastrp`` and ``node2vec`` use the structure only. ``samples`` bounds the incoming
    edges per node and relation that ``sage`` and ``rgcn`` use, the last layer's first; it replaces ``layers``.
    """
    if encoder in ("sage", "rgcn") and samples is not None:
        used = Z.sample_layers(edges, samples)
    else:
        used = [edges] * layers
    simple = lambda df: df.select("src", "dst").distinct()
    if encoder == "sage":
        return E.propagate_hops([simple(e) for e in used], features, dim, mode="mean"), dim * (len(used) + 1)
    if encoder == "gcn":
        return E.propagate_hops(simple(edges), features, dim, layers, "gcn"), dim * (layers + 1)
    if encoder == "rgcn":
        return E.propagate_relations(used, features, dim, relations), dim * (len(relations) + 1)
    if encoder == "fastrp":
        return E.fastrp(simple(edges), dim), dim
    if encoder == "node2vec":
        return E.node2vec(simple(edges), dim), dim
    raise ValueError(f"unknown encoder {encoder}")


def link_scores(
    edges: DataFrame, features: DataFrame, labelled: DataFrame, candidates: DataFrame, encoder: str, decoder: str,
    dim: int, layers: int = 2, relations: Sequence[str] = K.RELATIONS, samples: Sequence[int] | None = None,
) -> DataFrame:
    """Encode, fit the decoder on the training pairs and score the candidates: (src, dst, score)."""
    vectors, width = encode(edges, features, encoder, dim, layers, relations, samples)
    vectors = stage(vectors, "vectors")
    fitted = fit_decoder(decoder, labelled.where("split = 'train'"), vectors, width)
    return fitted.score(candidates.select("src", "dst"), vectors)


def score_models(fitted: dict[str, tuple[Decoder, DataFrame]], pairs: DataFrame) -> DataFrame:
    """``pairs`` scored by every model (its decoder and vectors) in long form, with ``model``.

    Models that share vectors share one join. Each part is written before they are put together.
    """
    groups: dict[int, tuple[DataFrame, dict[str, Decoder]]] = {}
    for name, (decoder, vectors) in fitted.items():
        groups.setdefault(id(vectors), (vectors, {}))[1][name] = decoder
    scored = None
    for vectors, decoders in groups.values():
        columns = {f"_s{k}": d for k, d in enumerate(decoders.values())}
        rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("score")) for n, c in zip(decoders, columns)])
        part = stage(score_all(columns, pairs, vectors).select(*pairs.columns, F.inline(rows)), "scores")
        scored = part if scored is None else scored.unionByName(part)
    return scored


def select_model(
    edges: DataFrame, features: DataFrame, labelled: DataFrame, dim: int, encoders: Sequence[str], decoders: Sequence[str] = DECODERS,
    layers: int = 2, relations: Sequence[str] = K.RELATIONS, samples: Sequence[int] | None = None,
) -> tuple[str, Decoder, DataFrame, DataFrame]:
    """Fit every encoder and decoder pair, choose by average precision on the validation pairs.

    Returns the name of the best, its decoder, its vectors, and the table (model, average_precision).
    """
    training = stage(labelled.where("split = 'train'"), "training-pairs")
    fitted: dict[str, tuple[Decoder, DataFrame]] = {}
    for encoder in encoders:
        vectors, width = encode(edges, features, encoder, dim, layers, relations, samples)
        vectors = stage(vectors, "vectors")
        for decoder in decoders:
            fitted[f"{encoder}+{decoder}"] = fit_decoder(decoder, training, vectors, width), vectors
    scored = score_models(fitted, labelled.where("split = 'val'").select("src", "dst", "label"))
    table = stage(average_precision(scored, by=["model"]), "selection")
    best = table.orderBy(F.desc("average_precision"), "model").first()["model"]
    return best, *fitted[best], table
