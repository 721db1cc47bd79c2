"""Log probabilities of texts under a language model by deleted interpolation.

The probability of a word is a mixture of maximum-likelihood estimates c(context, word) / c(context) for contexts of
0 to order - 1 words and of the uniform 1 / (V + 1). The weights depend on how often the longest context was seen
(buckets by powers of two) and are learnt by expectation-maximisation on held-out counts: every eighth learnt document
is held out, its n-grams are estimated from the other documents' counts, and the counts used for scoring are those of
all learnt documents.

Counts are exact and cover the whole corpus. Documents are packed into blocks; a block asks for the counts of its
distinct n-grams by 64-bit hash, and the requests meet in shards by hash range, whose number follows the size of the
corpus. So a frequent n-gram costs one number a block, not one row an occurrence, and no table of n-grams is sent to
all tasks. Only N, V and a histogram of quantised estimate ratios for the EM, of bounded size, reach the driver.

Defined results: a null or empty text is the end token alone; a row without id is scored but not learnt from; repeated
rows count and are scored each; if nothing is learnt, every token has probability 1; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelattice.llm.common import fold, shares, text_of
from tradelattice.llm.wordhash import STEP, WordHashes, mixed, split_words
from tradelattice.session import stage

BLOCK_TOKENS = 1_000_000
SHARD_BYTES = 12_000_000
END = np.uint64(0x5851F42D4C957F2D)  # the token that ends a text
BEGIN = np.uint64(0x14057B7EF767814F)  # what stands before a text, as a context
BUCKETS, STEPS_A_DECADE = 32, 20
TESTED, LEARNT, HELD_OUT = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    order: int = 2
    rounds: int = 200
    tolerance: float = 1e-9


@dataclass(frozen=True)
class Weights:
    """``mix``: a row a bucket, a column each for the uniform and the orders from 1."""

    mix: np.ndarray
    tokens: int
    words: int


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of numbers; bytes of equal significance stand together, so that leading zeros cost little."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


BLOCK_SCHEMA = "block long, ids binary, known_id binary, roles binary, lengths binary, tokens binary, vocabulary binary"


def blocks(docs: DataFrame, learn: Column, test: Column) -> DataFrame:
    """Documents packed into blocks of about ``BLOCK_TOKENS`` tokens: ids, roles, and tokens as places in the block's vocabulary."""
    role = F.when(test, TESTED).when(learn & (F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0), HELD_OUT).when(learn, LEARNT).otherwise(-1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(role, F.lit(-1)).cast("tinyint").alias("role"), text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, part, number = WordHashes(), TaskContext.get().partitionId(), 0
        ids, roles, words, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            vocabulary, tokens = np.unique(np.concatenate(words), return_inverse=True)
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) + number, "ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
                "known_id": np.array([i is not None for i in ids], np.uint8).tobytes(), "roles": np.array(roles, np.int8).tobytes(),
                "lengths": lengths.tobytes(), "tokens": pack(tokens.astype(np.uint32)), "vocabulary": pack_sorted(vocabulary),
            }], pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "known_id", "roles", "lengths", "tokens", "vocabulary"))]))

        for batch in batches:
            for i, r, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.append(hashes.of(split_words(text)), END)
                ids.append(i)
                roles.append(r)
                words.append(found)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    yield flush()
                    number += 1
                    ids, roles, words, held = [], [], [], 0
        if words:
            yield flush()

    return rows.mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """A block's tokens and, for each order, the distinct n-grams and which of them ends at each token."""

    def __init__(self, row, order: int):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known_id"], np.uint8).astype(bool)
        self.roles, self.lengths = np.frombuffer(row["roles"], np.int8), np.frombuffer(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        tokens, vocabulary = unpack(row["tokens"], np.uint32), unpack_sorted(row["vocabulary"])
        self.role = np.repeat(self.roles, self.lengths)
        words = grams = vocabulary[tokens]
        self.distinct, self.place = [vocabulary], [tokens.astype(np.int64)]
        for n in range(2, order + 1):
            before = np.empty_like(grams)
            before[1:] = grams[:-1]
            before[self.starts] = BEGIN + np.uint64(n)
            grams = mixed(before * STEP + words)
            distinct, place = np.unique(grams, return_inverse=True)
            self.distinct.append(distinct)
            self.place.append(place)

    def counts(self, replies: pd.DataFrame, column: str) -> list[np.ndarray]:
        """For each order the corpus count of the n-gram that ends at each token."""
        found = []
        for n, place in enumerate(self.place, 1):
            rows = replies[replies["gram"] == n].sort_values("shard")
            found.append(np.concatenate([unpack(r, np.uint64) for r in rows[column]])[place].astype(np.float64))
        return found

    def estimates(self, counts: list[np.ndarray], tokens: float, texts: float) -> tuple[np.ndarray, np.ndarray]:
        """Maximum-likelihood estimates, a column an order, and the count of the longest context."""
        columns, context = [counts[0] / max(tokens, 1.0)], np.full(len(counts[0]), float(tokens))
        for n in range(1, len(counts)):
            context = np.empty_like(counts[0])
            context[1:] = counts[n - 1][:-1]
            context[self.starts] = texts
            columns.append(np.divide(counts[n], context, out=np.zeros_like(context), where=context > 0))
        return np.stack(columns, axis=1), context


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(np.maximum(context, 0) + 1)), BUCKETS - 1).astype(np.int64)


def requests(packed: DataFrame, shards: int, settings: Settings) -> DataFrame:
    """(gram, shard, block, grams, learnt, held_out): a block's distinct n-grams of a hash range, with its own counts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)
        for batch in batches:
            for _, row in batch.iterrows():
                own, out = Block(row, settings.order), []
                learnt, held = (own.role >= LEARNT).astype(float), (own.role == HELD_OUT).astype(float)
                for n, (distinct, place) in enumerate(zip(own.distinct, own.place), 1):
                    mine = np.bincount(place, learnt, len(distinct)).astype(np.uint32)
                    out_held = np.bincount(place, held, len(distinct)).astype(np.uint32)
                    cuts = [0, *np.searchsorted(distinct, edges), len(distinct)]
                    for shard, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        if b > a:
                            out.append((n, shard, row["block"], pack_sorted(distinct[a:b]), pack(mine[a:b]), pack(out_held[a:b])))
                yield pd.DataFrame(out, columns=["gram", "shard", "block", "grams", "learnt", "held_out"])

    return packed.mapInPandas(run, "gram int, shard int, block long, grams binary, learnt binary, held_out binary")


def replies(asked: DataFrame) -> DataFrame:
    """The corpus counts for every request, and for each shard of single words a row with N and V."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [unpack_sorted(g) for g in rows["grams"]]
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        distinct, place = np.unique(np.concatenate(grams), return_inverse=True)
        total, answers = {}, {}
        for column in ("learnt", "held_out"):
            own = np.concatenate([unpack(c, np.uint32) for c in rows[column]])
            total[column] = np.bincount(place, own, len(distinct))
            answers[column] = [pack(part.astype(np.uint64)) for part in np.split(total[column][place], cuts)]
        first = int(rows["gram"].iloc[0])
        ends = distinct == END
        out = pd.DataFrame({"block": rows["block"].to_numpy(), "gram": first, "shard": rows["shard"].to_numpy(), **answers})
        sums = [[float(t.sum()), float((t > 0).sum()), float(t[ends].sum())] for t in total.values()]
        out["sums"] = [None] * len(out)
        if first == 1:
            out.loc[len(out)] = [-1, 1, int(rows["shard"].iloc[0]), None, None, sums[0] + sums[1]]
        return out

    return asked.groupBy("gram", "shard").applyInPandas(
        run, "block long, gram int, shard int, learnt binary, held_out binary, sums array<double>")


def ratios(packed: DataFrame, counted: DataFrame, sums: np.ndarray, settings: Settings) -> DataFrame:
    """Histogram of held-out tokens by bucket and by quantised ratio of each estimate to the uniform one (null: zero)."""
    tokens, words, texts = sums[0] - sums[3], sums[1], sums[2] - sums[5]
    names = [f"r{n}" for n in range(1, settings.order + 1)]

    def run(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own = Block(docs.iloc[0], settings.order)
        kept = own.role == HELD_OUT
        counts = [a - b for a, b in zip(own.counts(answers, "learnt"), own.counts(answers, "held_out"))]
        estimates, context = own.estimates(counts, tokens, texts)
        with np.errstate(divide="ignore"):
            steps = np.where(estimates > 0, np.round(STEPS_A_DECADE * np.log10(estimates * (words + 1))), -9999)
        rows = np.column_stack([bucket(context), steps])[kept].astype(np.int64)
        cells, weight = np.unique(rows, axis=0, return_counts=True)
        return pd.DataFrame(np.column_stack([cells, weight]), columns=["bucket", *names, "weight"])

    parts = packed.groupBy("block").cogroup(counted.where("block >= 0").groupBy("block")).applyInPandas(
        run, "bucket long, " + ", ".join(f"{n} long" for n in names) + ", weight long")
    return parts.groupBy("bucket", *names).agg(F.sum("weight").alias("weight"))


def mixture(cells: pd.DataFrame, settings: Settings) -> np.ndarray:
    """Weights a bucket by EM; a bucket without held-out tokens takes those of all tokens together."""
    names = ["uniform", *(f"r{n}" for n in range(1, settings.order + 1))]

    def learn(part: pd.DataFrame) -> np.ndarray:
        steps = part[names[1:]].to_numpy(np.float64)
        odds = np.column_stack([np.ones(len(part)), np.where(steps == -9999, 0.0, 10.0 ** (steps / STEPS_A_DECADE))])
        weight = part["weight"].to_numpy(np.float64)
        mix, before = np.full(len(names), 1.0 / len(names)), -np.inf
        for _ in range(settings.rounds):
            joint = odds * mix
            whole = joint.sum(axis=1)
            now = float((weight * np.log(whole)).sum() / weight.sum())
            mix = (joint / whole[:, None] * weight[:, None]).sum(axis=0) / weight.sum()
            if now - before < settings.tolerance:
                break
            before = now
        return np.maximum(mix, [1e-9] + [0.0] * (len(names) - 1))  # no token ever gets probability 0

    if not len(cells):
        return np.full((BUCKETS, len(names)), 1.0 / len(names))
    mix = np.tile(learn(cells.groupby(names[1:], as_index=False)["weight"].sum()), (BUCKETS, 1))
    for number, part in cells.groupby("bucket"):
        mix[int(number)] = learn(part)
    return mix / mix.sum(axis=1, keepdims=True)


SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(packed: DataFrame, counted: DataFrame, weights: Weights, texts: float, settings: Settings) -> DataFrame:
    held = packed.sparkSession.sparkContext.broadcast(weights)  # a few numbers

    def run(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        own, w = Block(docs.iloc[0], settings.order), held.value
        counts = own.counts(answers, "learnt")
        estimates, context = own.estimates(counts, w.tokens, texts)
        mix = w.mix[bucket(context)]
        chance = mix[:, 0] / (w.words + 1) + (mix[:, 1:] * estimates).sum(axis=1)
        base = np.log10((counts[0] + 1) / (w.tokens + w.words + 1))
        total = lambda values: np.add.reduceat(values, own.starts)
        out = pd.DataFrame({
            "doc_id": pd.array(own.ids, "Int64"), "held_out": own.roles == TESTED, "n_tokens": own.lengths,
            "n_known": total((counts[0] > 0).astype(np.int64)), "train_tokens": int(w.tokens),
            "base_score": total(base), "score": total(np.log10(chance)),
        })
        out.loc[~own.known, "doc_id"] = pd.NA
        return out

    return packed.groupBy("block").cogroup(counted.where("block >= 0").groupBy("block")).applyInPandas(run, SCORES)


def score(docs: DataFrame, folds: int = 7, tested: int = 2, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learnt from documents outside fold ``tested``.

    ``base_score`` is the add-one unigram log10 probability, ``score`` the interpolated model's.
    """
    remainder = fold("doc_id", folds)
    packed = stage(blocks(docs, remainder != tested, remainder == tested), "blocks")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = stage(replies(requests(packed, shares(size, SHARD_BYTES), settings)), "replies")
    rows = counted.where("block < 0").select(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(6))).first()
    sums = np.array([rows[k] or 0.0 for k in range(6)])
    if sums[0]:
        mix = mixture(ratios(packed, counted, sums, settings).toPandas(), settings)
    else:
        mix = np.eye(1, settings.order + 1).repeat(BUCKETS, axis=0)
    return scores(packed, counted, Weights(mix, int(sums[0]), int(sums[1])), float(sums[2]), settings)
