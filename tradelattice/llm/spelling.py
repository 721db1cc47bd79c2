"""Spelling variants: words one edit apart, and the frequent form that a rare word stands for.

Near words are found by PartEnum signatures. A word's letters are a multiset, seen as a binary vector with a place for the
first, second, ... occurrence of each letter. One inserted or deleted letter changes one place, one replaced letter two, so
near words lie at a Hamming distance of at most two. Places are dealt to ``parts`` partitions by hash; of two vectors within
distance two all but two partitions agree, so for each choice of two partitions the rest is a signature, and near words share
at least one. Words that share a signature meet in an equi join and are verified by their edit distance; signatures are
exact, so no near pair is lost.

A signature that many words share is refined, so that no group is compared all with all: of two near words either the first
or the last half is equal, whichever the edit is not in, so such words meet only if that half is equal, too.

Defined results: null and empty texts have no words; a row without id counts as one with an empty id; repeated rows count
again; extra columns are ignored; ties of forms go to the smallest word in code-point order; no rows give no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelattice.llm.wordhash import mixed
from tradelattice.session import stage

WORDS_AT_ONCE = 400_000  # distinct words that a task holds before it passes its counts on
ROUNDS = 7  # a form has at least ``factor`` times the count, so chains are short and each round doubles what is followed


@dataclass(frozen=True)
class Words:
    """Words of at least ``shortest`` letters that occur ``fewest`` times; one run in ``drop_one_in`` (0: none), chosen by the
    crc32 of document and run, loses a letter first."""

    shortest: int = 6
    fewest: int = 5
    drop_one_in: int = 0


@dataclass(frozen=True)
class Settings:
    """A form has ``factor`` times the count; signatures leave two of ``parts`` out; over ``shared`` words a signature is refined."""

    factor: int = 5
    parts: int = 7
    shared: int = 64


def word_counts(docs: DataFrame, words: Words = Words()) -> DataFrame:
    """(word, n) over all texts: runs of a-z and U+00C0 to U+00FF with A-Z lower-cased."""
    runs = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % words.shortest)  # in UTF-8; a run of fewer letters can't become a word

    def altered(run: bytes, head: int) -> bytes | None:
        chosen = zlib.crc32(run, head)
        if not words.drop_one_in or chosen % words.drop_one_in:
            return run
        text = run.decode()
        at = chosen % len(text)
        return (text[:at] + text[at + 1:]).encode() if len(text) > words.shortest else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in found], pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                head = zlib.crc32(f"{key}:".encode())
                for word, count in Counter(runs.findall(text.as_buffer().to_pybytes().lower())).items():
                    word = altered(word, head)
                    if word is not None:
                        found[word] += count
                if len(found) >= WORDS_AT_ONCE:
                    yield passed_on()
        yield passed_on()

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= words.fewest)


def signatures(word: Column, parts: int) -> Column:
    """A signature for each choice of two of ``parts`` partitions that are left out."""
    left_out = np.array(list(combinations(range(parts), 2)))
    tags = mixed(np.arange(1, len(left_out) + 1, dtype=np.uint64))

    @F.pandas_udf("array<long>")
    def signed(words: pd.Series) -> pd.Series:
        letters = [Counter(w) for w in words]
        places = np.array([(ord(c) << 32) + k for count in letters for c, n in count.items() for k in range(n)], np.uint64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        value = mixed(places + np.uint64(1))
        held = np.zeros((len(words), parts), np.uint64)
        np.add.at(held, (owner, (value % np.uint64(parts)).astype(np.int64)), mixed(value))
        whole = held.sum(axis=1, dtype=np.uint64)
        rest = whole[:, None] - held[:, left_out[:, 0]] - held[:, left_out[:, 1]]
        return pd.Series(list(mixed(rest ^ tags).view(np.int64)))

    return signed(word)


def refined(word: Column, length: Column) -> Column:
    """Keys of which near words share one: the shorter length of the two, and the half that the edit is not in."""
    def keys(shorter: Column) -> list[Column]:
        half = F.floor(shorter / 2).cast("int")
        rest = (shorter - half).cast("int")
        return [
            F.concat_ws(" ", shorter, F.lit("first"), F.substr(word, F.lit(1), half)),
            F.concat_ws(" ", shorter, F.lit("last"), F.substr(word, length - rest + 1, rest)),
        ]

    return F.array(*keys(length), *keys(length - 1))


def near_pairs(words: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b) of the words one edit apart, each pair once, a < b. ``words`` has distinct values of ``word``."""
    signed = stage(
        words.select("word", F.length("word").alias("length"), F.explode(signatures(F.col("word"), settings.parts)).alias("key")), "signatures",
    )
    # Signatures of a word alone, and those that too many words share, are found before any pair is made.
    shared = stage(signed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shared")
    met = signed.join(shared, "key")
    plain = met.where(F.col("held") <= settings.shared).select("key", F.lit("").alias("half"), "word", "length")
    split = met.where(F.col("held") > settings.shared).select(
        "key", F.explode(refined(F.col("word"), F.col("length"))).alias("half"), "word", "length")
    members = stage(plain.unionByName(split), "members")
    a = members.select("key", "half", F.col("word").alias("a"), F.col("length").alias("a_length"))
    b = members.select("key", "half", F.col("word").alias("b"), F.col("length").alias("b_length"))
    close = (F.col("a") < F.col("b")) & (F.abs(F.col("a_length") - F.col("b_length")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, ["key", "half"]).where(close).select("a", "b").distinct()


def variants(counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``counts``, a table of distinct words and their counts n.

    ``form`` is the near word of the largest count, if that is ``factor`` times the word's; ``root`` follows forms to the last.
    """
    counts = stage(counts, "words")
    pairs = stage(near_pairs(counts, settings), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    sized = both.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = sized.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = F.coalesce(-F.col("best.less") >= settings.factor * F.col("n"), F.lit(False))
    found = stage(
        counts.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    return found.join(roots(found.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms from each word ends. Each round goes twice as far as the one before."""
    steps = stage(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(ROUNDS):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if steps.join(further, "root", "left_semi").isEmpty():
            return steps
        steps = stage(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    raise RuntimeError(f"chains of forms did not end in {ROUNDS} rounds")
