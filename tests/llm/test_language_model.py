"""The interpolated model against a plain one: counts by dictionary, expectation-maximisation by loops."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelattice.llm import interpolated_lm


def grams(words, n):
    """The n-gram that ends at each word; near the start it is cut off and marked."""
    return [(n, i < n - 1, tuple(words[max(0, i - n + 1):i + 1])) for i in range(len(words))]


def counted(texts, order):
    return {n: Counter(g for words in texts for g in grams(words, n)) for n in range(1, order + 1)}


def estimated(words, counts, tokens, texts, order):
    """[(estimate by order, count of the longest context)] of each word."""
    rows = []
    for i in range(len(words)):
        own, context = [], tokens
        for n in range(1, order + 1):
            if n > 1:
                context = counts[n - 1][grams(words, n - 1)[i - 1]] if i else texts
            count = counts[n][grams(words, n)[i]]
            own.append(count / max(tokens, 1) if n == 1 else count / context if context > 0 else 0.0)
        rows.append((own, context))
    return rows


def bucket(context):
    return min(int(math.log2(max(context, 0) + 1)), interpolated_lm.BUCKETS - 1)


def learnt_mix(cells, order, settings):
    mix, before, total = [1 / (order + 1)] * (order + 1), -math.inf, sum(cells.values())
    for _ in range(settings.rounds):
        gain, now = [0.0] * (order + 1), 0.0
        for steps, weight in cells.items():
            joint = [mix[0]] + [m * (0.0 if s is None else 10 ** (s / interpolated_lm.STEPS_A_DECADE)) for m, s in zip(mix[1:], steps)]
            now += weight * math.log(sum(joint)) / total
            gain = [g + weight * j / sum(joint) / total for g, j in zip(gain, joint)]
        mix = gain
        if now - before < settings.tolerance:
            break
        before = now
    mix = [max(mix[0], 1e-9), *mix[1:]]
    return [m / sum(mix) for m in mix]


def by_hand(texts, held_out, settings):
    order, words = settings.order, {i: (t or "").lower().split() + ["</>"] for i, t in texts.items()}
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in learnt if i in held_out]
    whole, rest = counted([words[i] for i in learnt], order), counted([words[i] for i in learnt if i not in held_out], order)
    tokens, distinct = sum(whole[1].values()), len(whole[1])
    by_bucket, every = defaultdict(Counter), Counter()
    for i in held:
        for own, context in estimated(words[i], rest, sum(rest[1].values()), len(learnt) - len(held), order):
            steps = tuple(round(interpolated_lm.STEPS_A_DECADE * math.log10(e * (distinct + 1))) if e > 0 else None for e in own)
            by_bucket[bucket(context)][steps] += 1
            every[steps] += 1
    common = learnt_mix(every, order, settings)
    mixes = {b: learnt_mix(cells, order, settings) for b, cells in by_bucket.items()}
    found = {}
    for i in texts:
        score = 0.0
        for own, context in estimated(words[i], whole, tokens, len(learnt), order):
            mix = mixes.get(bucket(context), common)
            score += math.log10(mix[0] / (distinct + 1) + sum(m * e for m, e in zip(mix[1:], own)))
        found[i] = score
    return found


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_hand(spark, order):
    rng = random.Random(order)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(40)]
    texts = {i: " ".join(rng.choice(vocabulary[:rng.choice([4, 15, 40])]) for _ in range(rng.randint(0, 40))) for i in range(160)}
    texts[160] = None
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    held_out = {r.doc_id for r in rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0).collect()}
    settings = interpolated_lm.Settings(order=order)
    got = {r.doc_id: r.score for r in interpolated_lm.score(rows, settings=settings).collect()}
    want = by_hand(texts, held_out, settings)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_counts_beyond_32_bits_survive():
    values = np.array([0, 1, 2 ** 32 - 1, 2 ** 32, 3 * 10 ** 12], np.uint64)
    assert interpolated_lm.unpack(interpolated_lm.pack(values), np.uint64).tolist() == values.tolist()


def test_replies_sum_beyond_32_bits(spark):
    """Two blocks that hold one n-gram three thousand million times each."""
    import pandas as pd

    gram, many = interpolated_lm.pack_sorted(np.array([7], np.uint64)), interpolated_lm.pack(np.array([3_000_000_000], np.uint32))
    asked = spark.createDataFrame(pd.DataFrame([(1, 0, b, gram, many, many) for b in (0, 1)], columns=["gram", "shard", "block", "grams", "learnt", "held_out"]),
                                  "gram int, shard int, block long, grams binary, learnt binary, held_out binary")
    rows = interpolated_lm.replies(asked).where("block >= 0").collect()
    assert [interpolated_lm.unpack(bytes(r.learnt), np.uint64).tolist() for r in rows] == [[6_000_000_000]] * 2
