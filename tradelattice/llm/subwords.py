"""Text classifier over learned hashed word and character n-gram vectors.

A word is the bag of its hashed whole form and its character n-grams; its vector is the mean of their vectors, a
passage's vector is the mean over its words, and a two-class softmax reads it. Vectors and softmax are trained
together by stochastic gradient descent (AdaGrad steps) in numpy on a bounded sample of labelled rows. Because the
softmax is linear, the trained model folds into one number per bucket, which is what the executors get.

Two ways to pool a document: ``mean`` averages all its words; ``max`` averages overlapping windows of ``window``
words and keeps the highest window, so that a short passage counts as much in a long document as in a short one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelattice.llm.common import fold, text_of

CACHED_WORDS = 300_000  # per worker, a few dozen MB
BATCH_ROWS = 256
FIT_WORDS = 10_000  # whose features are worked out at once in training
AGAIN = "\x00again"
WHOLE, GRAM, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """``sample_per_class`` and ``sample_chars`` bound what is learnt from: so many labelled rows of a class at most,
    each of at most so many characters (longer rows are scored, not learnt from)."""

    pooling: str = "mean"
    window: int = 24
    buckets: int = 1 << 18
    dim: int = 8
    shortest: int = 3
    longest: int = 5
    epochs: int = 8
    batch: int = 64
    rate: float = 0.3
    seed: int = 7
    sample_per_class: int = 2000
    sample_chars: int = 50_000


def words_of(text: str | None) -> list[str]:
    """Lower-case words; a word that repeats the one before it is read as the marker of a repetition."""
    words = (text or "").lower().split()
    return [AGAIN if word == before else word for word, before in zip(words, [None, *words])]


def word_features(words: list[str], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's whole form and character n-grams, end to end, and where each word's buckets begin.

    Characters are code points; a repeated n-gram counts each time. Hashes are polynomials modulo 2^64, so all
    n-grams of all words come from a few array operations.
    """
    marked = [f"<{word}>" for word in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths) - np.arange(len(points))  # characters up to the word's end
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=1)), WHOLE, np.uint64))
    hashes, owners = [np.add.reduceat(points * powers[place], ends - lengths)], [np.arange(len(words))]
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, settings.longest + 1):
        rolled = rolled[:len(points) - n + 1] * GRAM + points[n - 1:]
        if n >= settings.shortest:
            inside = left[:len(rolled)] >= n
            hashes.append(rolled[inside] + np.uint64(n))
            owners.append(owner[:len(rolled)][inside])
    hashed = np.concatenate(hashes)
    hashed = (hashed ^ (hashed >> np.uint64(31))) * MIX
    of = np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    buckets = ((hashed >> np.uint64(33)) & np.uint64(settings.buckets - 1)).astype(np.int32)[order]
    return buckets, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])


@dataclass
class Model:
    """Softmax logit difference per bucket, and of the bias."""

    settings: Settings
    weight: np.ndarray
    bias: float
    cache: dict[str, float] = field(default_factory=dict, repr=False)

    def logits(self, texts: Iterable[str | None]) -> list[float]:
        """Logits of texts; the scores of words met are kept, up to a bound."""
        split = [words_of(text) for text in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = list(set().union(*split).difference(self.cache))
        if new:
            self.cache.update(zip(new, word_means(self.weight, *word_features(new, self.settings)).tolist()))
        return [self.pooled(words) + self.bias for words in split]

    def pooled(self, words: list[str]) -> float:
        if not words:
            return 0.0
        scores = np.fromiter(map(self.cache.__getitem__, words), np.float64, len(words))
        return float(scores.mean() if self.settings.pooling == "mean" else window_means(scores, self.settings.window).max())

    def probabilities(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(np.asarray(self.logits(texts), np.float64), -60, 60)))


def window_starts(length: int, window: int) -> np.ndarray:
    """Starts of windows that overlap by half and reach the end; one for a text no longer than a window."""
    if length <= window:
        return np.zeros(1, np.int64)
    step = max(1, window // 2)
    return np.append(np.arange(0, length - window, step), length - window)


def window_means(scores: np.ndarray, window: int) -> np.ndarray:
    starts = window_starts(len(scores), window)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    ends = np.minimum(starts + window, len(scores))
    return (sums[ends] - sums[starts]) / (ends - starts)


def fit(texts: list[str], labels: list[int], settings: Settings) -> Model:
    """Train on texts with 0/1 labels. Without both classes the model is the smoothed share of label 1."""
    y = np.asarray(labels, np.float64)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    if len(y) == 0 or y.min() == y.max():
        return Model(settings, np.zeros(settings.buckets, np.float32), prior)
    ids: dict[str, int] = {}
    documents = [np.fromiter((ids.setdefault(w, len(ids)) for w in words_of(t)), np.int32) for t in texts]
    if not ids:
        return Model(settings, np.zeros(settings.buckets, np.float32), prior)
    words = list(ids)
    parts = [word_features(words[at:at + FIT_WORDS], settings) for at in range(0, len(words), FIT_WORDS)]
    flat, sizes = np.concatenate([b for b, _ in parts]), np.concatenate([np.diff(e) for _, e in parts])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    del ids, words, parts
    rng = np.random.default_rng(settings.seed)
    vectors = rng.normal(0, 1 / settings.dim, (settings.buckets, settings.dim)).astype(np.float32)
    head = rng.normal(0, 0.1, (settings.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, seen_head, seen_bias = np.full(settings.buckets, 1e-8, np.float32), np.float32(1e-8), np.float32(1e-8)
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)

    for epoch in range(settings.epochs):
        passages = documents
        if settings.pooling == "max":
            passages = best_windows(documents, word_means(vectors @ (head[:, 1] - head[:, 0]), flat, begins), settings, epoch, rng)
        rate = settings.rate * (1 - epoch / settings.epochs)
        order = rng.permutation(len(passages))
        for at in range(0, len(order), settings.batch):
            rows = [i for i in order[at:at + settings.batch] if len(passages[i])]
            if not rows:
                continue
            lengths = np.array([len(passages[i]) for i in rows])
            owner = np.repeat(np.arange(len(rows)), lengths)
            used, local = np.unique(np.concatenate([passages[i] for i in rows]), return_inverse=True)
            counts = np.zeros((len(rows), len(used)), np.float32)
            np.add.at(counts, (owner, local), 1)
            counts /= lengths[:, None]
            taken = sizes[used]
            where = np.repeat(begins[used] - np.concatenate([[0], np.cumsum(taken)[:-1]]), taken) + np.arange(taken.sum())
            buckets = flat[where]
            words = np.add.reduceat(vectors[buckets], np.concatenate([[0], np.cumsum(taken)[:-1]]), axis=0) / taken[:, None]
            hidden = counts @ words.astype(np.float32)
            logits = hidden @ head + bias
            logits -= logits.max(axis=1, keepdims=True)
            odds = np.exp(logits)
            wrong = odds / odds.sum(axis=1, keepdims=True)
            wrong[np.arange(len(rows)), y[rows].astype(int)] -= 1
            wrong *= share[rows, None] / len(rows)
            step_head, step_bias = hidden.T @ wrong, wrong.sum(axis=0)
            per_word = (counts.T @ (wrong @ head.T)) / taken[:, None]
            touched, inverse = np.unique(buckets, return_inverse=True)
            per_feature = np.repeat(per_word, taken, axis=0)
            step = np.stack([np.bincount(inverse, per_feature[:, k], len(touched)) for k in range(settings.dim)], axis=1)
            seen[touched] += (step ** 2).mean(axis=1)
            vectors[touched] -= rate * step / np.sqrt(seen[touched])[:, None]
            seen_head += (step_head ** 2).mean()
            head -= rate * step_head / np.sqrt(seen_head)
            seen_bias += (step_bias ** 2).mean()
            bias -= rate * step_bias / np.sqrt(seen_bias)
    return Model(settings, (vectors @ (head[:, 1] - head[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def word_means(weight: np.ndarray, flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weight[flat], begins[:-1]) / np.diff(begins) if len(begins) > 1 else np.zeros(0)


def best_windows(documents, means, settings: Settings, epoch: int, rng) -> list[np.ndarray]:
    """Of each document the window that scores highest now; in the first epoch, when nothing is learnt, the whole document."""
    if epoch == 0:
        return documents
    chosen = []
    for words in documents:
        if len(words) <= settings.window:
            chosen.append(words)
            continue
        start = window_starts(len(words), settings.window)[int(np.argmax(window_means(means[words], settings.window)))]
        chosen.append(words[start:start + settings.window])
    return chosen


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, settings: Settings) -> DataFrame:
    """At most ``sample_per_class`` labelled documents of each class outside fold 0, the first by a hash of the id.

    An id whose labels disagree counts as 1. Other labels than 0 and 1, and null ids, are left out.
    """
    known = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold("id", folds) != 0))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    part = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(settings.sample_per_class) for y in (0, 1)
    ]
    chosen = F.broadcast(part[0].unionByName(part[1]))  # at most two times sample_per_class rows of two numbers
    rows = documents.select(F.col("doc_id").alias("id"), text_of().alias("text")).where(F.length("text") <= settings.sample_chars)
    # Of rows that repeat an id the first by a hash of the text is learnt from.
    return rows.join(chosen, "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("id", "text", "y")


def learn(documents: DataFrame, labels: DataFrame, label: str, folds: int, settings: Settings) -> Model:
    sample = labelled_sample(documents, labels, label, folds, settings).toPandas().sort_values("id")
    return fit(sample["text"].tolist(), sample["y"].astype(int).tolist(), settings)


def scorer(df: DataFrame, model: Model, text: Column) -> Column:
    """A column of the probability of label 1 for ``text``."""
    held = df.sparkSession.sparkContext.broadcast((model.settings, model.weight, model.bias))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*held.value)
        for texts in batches:
            parts = [own.probabilities(texts[at:at + BATCH_ROWS]) for at in range(0, len(texts), BATCH_ROWS)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return probability(text)
