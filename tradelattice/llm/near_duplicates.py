"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of ``side`` sub-keys (``rows`` minhashes each) are computed per document; table (i, j) is keyed
by sub-key i of the one and j of the other. So ``side``^2 tables need 2 * side * rows minhashes, about the square root
of what as many separate tables need. Two sets of similarity s meet in some table with probability
(1 - (1 - s^rows)^side)^2: 0.9985 at s = 0.8 and above 0.9999 from 0.86 on with the defaults.

Documents with equal shingle sets become one class first, so copies meet nowhere else. In a table's bucket, members
are compared with the bucket's smallest and largest member. Documents of buckets that still span several components
are joined exactly by their rarest shingles, between components. A pair that is never compared lies inside one
component already, so no component is lost. Each pair is decided on the full shingle sets.

Defined results: a null or empty text has an empty set and links with nothing; repeated rows are copies of each other;
a row without id links with nothing, has a null component and is kept; rows that repeat an id with another text are
compared each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelattice.llm.common import free_name
from tradelattice.llm.components import components
from tradelattice.llm.wordhash import STEP, WordHashes, mixed, shingles, split_words
from tradelattice.session import stage

ROWS_AT_ONCE = 512


@dataclass(frozen=True)
class Settings:
    """Shingles of ``words`` words; links at ``percent`` per cent similarity."""

    words: int = 5
    percent: int = 80
    side: int = 10
    rows: int = 3
    seed: int = 11


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, n_shingles, set_key, left, right) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rng = WordHashes(), np.random.default_rng(settings.seed)
        count = 2 * settings.side * settings.rows
        factor = rng.integers(1, 2 ** 63, (count, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 2 ** 63, (count, 1), np.uint64)
        tag = mixed(np.arange(1, 2 * settings.side + 1, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                sizes, keys, bands = [], [], np.zeros((part.num_rows, 2 * settings.side), np.uint64)
                for k, text in enumerate(part.column(1).to_pylist()):
                    found = shingles(hashes.of(split_words(text)), settings.words)
                    sizes.append(len(found))
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    if len(found):
                        least = lowest(found, factor, shift).reshape(2 * settings.side, settings.rows)
                        band = tag.copy()
                        for row in range(settings.rows):
                            band = mixed(band * STEP + least[:, row])
                        bands[k] = band
                longs = bands.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    lists(longs[:, :settings.side]), lists(longs[:, settings.side:]),
                ], ["doc_id", "n_shingles", "set_key", "lefts", "rights"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, lefts array<long>, rights array<long>")


def lowest(found: np.ndarray, factor: np.ndarray, shift: np.ndarray, block: int = 4096) -> np.ndarray:
    """Minhashes of a set, over blocks of it."""
    least = np.full(len(factor), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), block):
        least = np.minimum(least, (factor * found[at:at + block] + shift).min(axis=1))
    return least


def lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, width, dtype=np.int32), pa.array(np.ascontiguousarray(values).ravel()))


def shingle_sets(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, found): the sorted shingle hashes of each document as bytes."""
    @F.pandas_udf("binary")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for texts in batches:
            yield pd.Series([shingles(hashes.of(split_words(t)), settings.words).tobytes() for t in texts])

    return docs.select("doc_id", found("text").alias("found"))


def similar(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Of pairs (a, b) those whose sets reach the threshold."""
    percent = settings.percent

    @F.pandas_udf("boolean")
    def reach(a: pd.Series, b: pd.Series) -> pd.Series:
        decided = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                decided.append(False)
                continue
            common = both - len(np.unique(np.concatenate([x, y])))
            decided.append(100 * common >= percent * (both - common))
        return pd.Series(decided, dtype=bool)

    left = sets.select(F.col("doc_id").alias("a"), F.col("found").alias("found_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("found").alias("found_b"))
    return pairs.join(left, "a").join(right, "b").where(reach("found_a", "found_b")).select("a", "b")


def groups(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    sketch = stage(sketches(docs, settings), "sketches")
    classes = stage(
        sketch.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("lefts").alias("lefts"), F.first("rights").alias("rights")),
        "classes",
    )
    keys = classes.select("node", F.explode(F.flatten(F.transform(
        "lefts", lambda x: F.transform("rights", lambda y: F.xxhash64(x, y))))).alias("key"))
    shared = stage(
        keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"), "shared-keys"
    )
    members = stage(keys.join(shared, "key"), "members")
    wanted = stage(members.select(F.col("node").alias("doc_id")).distinct(), "members-ids")
    sets = stage(shingle_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                              .join(wanted, "doc_id"), settings).distinct(), "sets")
    stars = members.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b")).unionByName(
        members.where("node < high").select(F.col("node").alias("a"), F.col("high").alias("b"))).distinct()
    links = stage(similar(stars, sets, settings), "links")
    found = stage(components(links), "components")
    more = stage(similar(rest(members, found, sets, settings), sets, settings), "links")
    if not more.isEmpty():
        found = stage(components(links.unionByName(more)), "components")
    named = stage(
        classes.select("set_key", "node").join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("class_component")),
        "class-components",
    )
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    alone = sketch.where(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = sketch.where(linkable).join(named, "set_key").select("doc_id", "n_shingles", F.col("class_component").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def rest(members: DataFrame, found: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Candidate pairs (a, b) of different components among the documents whose buckets still span several.

    Sets of n and m elements that reach the threshold share an element among the rarest n - ceil(n * percent / 100) + 1
    of each, so the pairs come from an equi join on those elements: exact, and documents that share only a frequent
    passage never meet. Elements are ranked by how many of these documents hold them.
    """
    percent = settings.percent
    named = members.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    spread = named.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last")).where("first < last")
    open_ = stage(named.join(stage(spread.select("key"), "spread"), "key").select("node", "component").distinct(), "open")

    @F.pandas_udf("array<long>")
    def elements(found: pd.Series) -> pd.Series:
        return found.map(lambda x: np.frombuffer(x, np.int64))

    rows = stage(
        sets.withColumnRenamed("doc_id", "node").join(open_, "node")
        .select("node", "component", (F.octet_length("found") / 8).cast("long").alias("n"), F.explode(elements("found")).alias("element")),
        "elements",
    )
    held = stage(rows.groupBy("element").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    # An element that one document alone holds ranks first and joins with nothing; only its number counts.
    shared = rows.join(held, "element")
    place = Window.partitionBy("node", "n").orderBy("held", "element")
    counted = Window.partitionBy("node", "n")
    ranked = shared.withColumn("place", F.col("n") - F.count(F.lit(1)).over(counted) + F.row_number().over(place) - 1)
    prefix = stage(
        ranked.where(F.col("place") < F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).select("element", "node", "component", "n", "place"),
        "prefix",
    )
    other = prefix.select("element", *(F.col(c).alias(f"other_{c}") for c in ("node", "component", "n", "place")))
    # Seen from the first element that two sets share, what follows bounds what they can share.
    overlap = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    met = prefix.join(other, "element").where(
        (F.col("node") < F.col("other_node")) & (F.col("component") != F.col("other_component"))
        & (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n"))
        & (overlap * (100 + percent) >= percent * (F.col("n") + F.col("other_n")))
    )
    return met.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each group, that with the smallest id, with its columns unchanged.

    Rows that repeat a kept id are one document: the first by a hash of the text stays, of equal texts the
    first by a hash of all columns; rows without id all stay.
    """
    name, place = free_name("_kept_id", docs), free_name("_place", docs)
    kept = stage(groups(docs, settings).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct(), "kept")
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.col("text"), F.xxhash64(*plain))
    with_id = docs.join(kept, F.col("doc_id").cast("long") == F.col(name)).withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return with_id.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
