"""Documents that contain benchmark items, exactly or with up to a fifth of an item's words edited.

1. A screen finds the stretches of a text that need windows at all. An item of n words with at most k edits keeps at
   least (n - q + 1) - k * q of its q-word grams, so a window of n words with fewer grams of items of that length
   cannot match. The screen is a table of fixed size: for a hashed gram, the lengths of items that hold it.
2. Item-sized windows and items are embedded by random walks: a walk writes the word it stands on at every step and goes
   on to the next word or not by a coin tossed for that word and step, so words that differ by few edits mostly write the
   same at the same step, and edit distance becomes Hamming distance. A key is what a walk wrote at a few sampled steps;
   windows and items that share a key are candidates. The number of walks is the smallest that reaches the target recall
   for an item's length and allowed edits, by a simulation with made-up words.
3. What keys missed is completed exactly: edits destroy at most k * q of an item's grams, so of any k * q + 1 one is left in
   the region of neighbouring windows; an item is looked up by its k * q + 1 grams that the fewest items hold, in an equi
   join. No pair within the allowed edits is missed.
4. Every pair that met and shares enough grams is verified by the edit distance between the item and the best stretch of
   the region.

Words are runs of letters and digits, in lower case; in scripts written without spaces each character is a word. Items
of fewer than five words have no allowed edits, so they are found as exact copies.
Defined results: null and empty texts and items match nothing; repeated items are found each; repeated rows give one
result; an empty benchmark gives no rows; of several places the one with the fewest edits, then the first, is returned;
extra columns are ignored (or, in the filter, kept). A document without id keeps a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelattice.llm.common import free_name, text_of
from tradelattice.llm.wordhash import STEP, WordHashes, mixed
from tradelattice.session import stage

WORD = re.compile(r"[^\W_]+")
#: Letters and marks of scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, Bopomofo and Han.
UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u1049\u1050-\u109f\u1780-\u17d3\u3005-\u3007\u3041-\u3096\u309d-\u309f"
    "\u30a1-\u30fa\u30fc-\u30ff\u3105-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
MARK = re.compile(f"[{UNSPACED}]")
EVERY = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+")
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Settings:
    """``percent`` of an item's words may be edited. ``bits``: the screen has 2^bits entries of 8 bytes.

    Keys sample ``samples`` steps of a walk; there are as many walks as ``recall`` needs, ``walks`` at most.
    """

    percent: int = 20
    bits: int = 19
    recall: float = 0.9
    samples: int = 3
    walks: int = 128
    trials: int = 256
    seed: int = 17


def hashed_words(text: str | None, hashes: WordHashes) -> np.ndarray:
    text = (text or "").lower()
    pattern = EVERY if not text.isascii() and MARK.search(text) else WORD
    return hashes.of(pattern.findall(text))


def edits(length: int, settings: Settings) -> int:
    return length * settings.percent // 100


def gram_size(length: int, settings: Settings) -> int:
    """Most words, up to three, of which some gram outlives the allowed edits."""
    k = edits(length, settings)
    return next(q for q in (3, 2, 1) if length - q + 1 - k * q >= 1 or q == 1)


def least_grams(length: int, settings: Settings) -> int:
    q = gram_size(length, settings)
    return max(1, length - q + 1 - edits(length, settings) * q)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    if len(words) < size:
        return np.zeros(0, np.uint64)
    rolled = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        rolled = rolled * STEP + words[k:len(words) - size + 1 + k]
    return mixed(rolled)


def dense(places: np.ndarray, width: int, least: int) -> bool:
    """Whether some ``width`` neighbouring places hold ``least`` of the sorted ``places``."""
    return len(places) >= least and bool((places[least - 1:] - places[:len(places) - least + 1] < width).any())


def starts(hits: np.ndarray, length: int, settings: Settings) -> np.ndarray:
    """Starts of all windows with enough grams. A stretch within the allowed edits of an item begins at one of them."""
    held = length - gram_size(length, settings) + 1
    total = np.cumsum(np.concatenate([[0], hits, np.zeros(held, np.int64)]))
    return np.flatnonzero(total[held:len(hits) + held] - total[:len(hits)] >= least_grams(length, settings))


def regions(begins: np.ndarray, length: int, settings: Settings) -> Iterator[tuple[int, int]]:
    """First and last word of the regions of windows that begin at ``begins``, each of at most 2 * ``length`` beginnings."""
    at = 0
    while at < len(begins):
        upto = int(np.searchsorted(begins, begins[at] + 2 * length))
        gaps = np.flatnonzero(np.diff(begins[at:upto]) > length)
        upto = at + int(gaps[0]) + 1 if len(gaps) else upto
        yield int(begins[at]), int(begins[upto - 1]) + length + edits(length, settings)
        at = upto


# --- random walks ---


def walk_keys(windows: np.ndarray, walks: int, settings: Settings) -> np.ndarray:
    """(windows, walks): the keys of windows of one length, a row of word hashes each."""
    count, length = windows.shape
    steps = 2 * length  # a walk needs two a word; steps after its end would be alike for all
    sampled = np.sort(np.random.default_rng([settings.seed, length]).integers(0, steps, (settings.walks, settings.samples))[:walks], axis=1)
    coins = mixed(np.arange(1, settings.walks * steps + 1, dtype=np.uint64) * STEP).reshape(settings.walks, steps)[:walks]
    padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], axis=1)
    at, keys = np.zeros((count, walks), np.int64), np.full((count, walks), length, np.uint64)
    rows = np.arange(count)[:, None]
    for step in range(int(sampled.max()) + 1):
        word = padded[rows, at]
        for k in range(settings.samples):
            here = sampled[:, k] == step
            if here.any():
                keys[:, here] = mixed(keys[:, here] * STEP + word[:, here])
        at = np.minimum(at + (mixed(word ^ coins[:, step]) & np.uint64(1)).astype(np.int64), length)
    return mixed(keys + np.arange(1, walks + 1, dtype=np.uint64) * STEP)


def edited(words: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """``count`` random replacements, insertions and deletions of words, and other words after them."""
    found = words.tolist()
    for kind in rng.integers(0, 3, count):
        at = int(rng.integers(len(found) + (kind == 1))) if found else 0
        found[at:at + (kind != 1)] = [] if kind == 2 else [int(rng.integers(1, 2 ** 62))]
    return np.array(found + rng.integers(1, 2 ** 62, count).tolist(), np.uint64)


@cache
def needed_walks(length: int, settings: Settings) -> int:
    """The fewest walks whose keys meet in the share ``recall`` of pairs of an item and its edited copy."""
    rng = np.random.default_rng([settings.seed, length, 1])
    items = rng.integers(1, 2 ** 62, (settings.trials, length)).astype(np.uint64)
    others = np.stack([edited(w, edits(length, settings), rng)[:length] for w in items])
    met = walk_keys(items, settings.walks, settings) == walk_keys(others, settings.walks, settings)
    reached = np.maximum.accumulate(met, axis=1).mean(axis=0) >= settings.recall
    return int(reached.argmax()) + 1 if reached.any() else settings.walks


def keyed(windows: dict[int, list[tuple[int, np.ndarray]]], settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, key) of windows by length, each window with its owner."""
    for length, own in windows.items():
        keys = walk_keys(np.stack([w for _, w in own]), needed_walks(length, settings), settings)
        yield np.repeat(np.array([o for o, _ in own], np.int64), keys.shape[1]), keys.ravel().view(np.int64)


def item_keys(known: DataFrame, settings: Settings) -> DataFrame:
    """(item_id, length, item, walk_key) of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows: dict[int, list[tuple[int, np.ndarray]]] = {}
            for row, (n, words) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                windows.setdefault(n, []).append((row, np.frombuffer(words, np.uint64)))
            for owner, keys in keyed(windows, settings):
                own = batch.take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(keys)], ["item_id", "length", "item", "walk_key"])

    return known.mapInArrow(run, "item_id long, length long, item binary, walk_key long").distinct()


def region_keys(found: DataFrame, settings: Settings) -> DataFrame:
    """(region, length, walk_key): the keys of the windows of a region with the most grams of items, the first and the last of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows: dict[int, list[tuple[int, np.ndarray]]] = {}
            for row in range(batch.num_rows):
                n, words = batch.column(1)[row].as_py(), np.frombuffer(batch.column(2)[row].as_py(), np.uint64)
                q = gram_size(n, settings)
                hits = np.isin(grams(words, q).view(np.int64), batch.column(3)[row].values.to_numpy(zero_copy_only=False))
                total = np.cumsum(np.concatenate([[0], hits]))
                counts = total[n - q + 1:] - total[:max(len(total) - (n - q + 1), 0)]
                if len(counts):  # a region at the end of a text can be shorter than the item
                    best = np.flatnonzero(counts == counts.max())
                    for at in {int(best[0]), int(best[-1])}:
                        windows.setdefault(n, []).append((row, words[at:at + n]))
            for owner, keys in keyed(windows, settings):
                own = batch.take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(keys)], ["region", "length", "walk_key"])

    return found.select("region", "length", "words", "grams").mapInArrow(run, "region long, length long, walk_key long")


# --- items and regions ---


def item_rows(items: DataFrame, settings: Settings) -> DataFrame:
    """(item_id, length, words) of the items that are looked for, each once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, lengths, words = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = hashed_words(text, hashes)
                if len(found):
                    ids.append(item)
                    lengths.append(len(found))
                    words.append(found.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(words, pa.binary())], ["item_id", "length", "words"])

    rows = items.select(F.col("item_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(run, "item_id long, length long, words binary").distinct()


def item_grams(known: DataFrame, settings: Settings) -> DataFrame:
    """(item_id, length, item, gram): of each item the k * q + 1 grams that the fewest items of its length hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column(1)[row].as_py()
                found = grams(np.frombuffer(batch.column(2)[row].as_py(), np.uint64), gram_size(n, settings)).view(np.int64)
                same = pa.array(np.full(len(found), row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(same), batch.column(1).take(same), batch.column(2).take(same), pa.array(found),
                     pa.array(np.arange(len(found))), pa.array(np.full(len(found), edits(n, settings) * gram_size(n, settings) + 1))],
                    ["item_id", "length", "item", "gram", "place", "needed"])

    rows = stage(known.mapInArrow(run, "item_id long, length long, item binary, gram long, place long, needed long"), "grams")
    often = rows.groupBy("length", "gram").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("item_id", "item").orderBy("times", "gram", "place")
    chosen = rows.join(often, ["length", "gram"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("needed"))
    return chosen.select("item_id", "length", "item", "gram").distinct()


def screen(items: DataFrame, settings: Settings) -> tuple[np.ndarray, list[int]]:
    """The screen and the lengths of items. Entries collected are bounded by its size, lengths by the longest item."""
    lengths = sorted(r.length for r in items.select("length").distinct().collect())
    place = {length: k % 64 for k, length in enumerate(lengths)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for length, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = grams(np.frombuffer(words, np.uint64), gram_size(length, settings))
                slots.append((found >> np.uint64(64 - settings.bits)).astype(np.int64))
                bits.append(np.full(len(found), np.uint64(1) << np.uint64(place[length]), np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(slots)), pa.array(np.concatenate(bits))], ["slot", "bits"])

    rows = items.select("length", "words").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    entries = rows.toPandas()
    table = np.zeros(1 << settings.bits, np.uint64)
    table[entries["slot"].to_numpy(np.int64)] = entries["bits"].to_numpy(np.int64).view(np.uint64)
    return table, lengths


def region_rows(docs: DataFrame, key: str, table: np.ndarray, lengths: list[int], settings: Settings) -> DataFrame:
    """(key, start, length, words, grams): regions that pass the screen, and the grams of theirs that it holds."""
    held = docs.sparkSession.sparkContext.broadcast((table, lengths))  # 2^bits entries, and a number for each length
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (masks, sizes) = WordHashes(), held.value
        by_size: dict[int, list[tuple[int, int, int]]] = {}  # gram size -> (place in the screen, length, fewest grams)
        for k, n in enumerate(sizes):
            by_size.setdefault(gram_size(n, settings), []).append((k, n, least_grams(n, settings)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows, begins, sizes_met, around, held_grams = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    words = hashed_words(text, hashes)
                    for q in sorted(by_size):
                        found = grams(words, q)
                        mask = masks[found >> np.uint64(64 - settings.bits)]
                        places = np.flatnonzero(mask)
                        if not len(places):
                            continue
                        marks = mask[places]
                        for k, n, least in by_size[q]:
                            at_gram = places[(marks & np.uint64(1 << k % 64)) != 0]
                            if not dense(at_gram, n - q + 1, least):
                                continue
                            hits = np.zeros(len(mask), np.int64)
                            hits[at_gram] = 1
                            seen = set()  # of equal regions of a text the first stands for all
                            for first, last in regions(starts(hits, n, settings), n, settings):
                                inside = words[first:last].tobytes()
                                if inside in seen:
                                    continue
                                seen.add(inside)
                                rows.append(row)
                                begins.append(first)
                                sizes_met.append(n)
                                around.append(inside)
                                low, high = np.searchsorted(at_gram, [first, last - q + 1])
                                held_grams.append(np.unique(found[at_gram[low:high]]).view(np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(rows)), pa.array(begins, pa.int64()), pa.array(sizes_met, pa.int64()),
                        pa.array(around, pa.binary()), pa.array(held_grams, pa.list_(pa.int64())),
                    ], ["key", "start", "length", "words", "grams"])

    rows = docs.select(F.col(key).alias("key"), text_of().alias("text"))
    return rows.mapInArrow(run, f"key {kind}, start long, length long, words binary, grams array<long>")


def best_stretch(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Fewest word edits that turn the item into a stretch of ``words``; the stretch's start and end."""
    for start in np.flatnonzero(words[:len(words) - len(item) + 1] == item[0]).tolist():
        if np.array_equal(words[start:start + len(item)], item):
            return 0, start, start + len(item)
    places = np.arange(len(words) + 1)
    cost, begin = np.zeros(len(words) + 1, np.int64), places.copy()
    for k, word in enumerate(item):
        down, diagonal = cost + 1, cost[:-1] + (words != word)
        best, from_ = down.copy(), begin.copy()
        better = diagonal < best[1:]
        best[1:][better], from_[1:][better] = diagonal[better], begin[:-1][better]
        run = best - places  # a step to the right costs one
        lowest = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == lowest, places, 0))
        cost, begin = lowest + places, from_[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def candidates(found: DataFrame, known: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(region, item_id, item) of the regions and items that share a walk's key, and of those that only share grams."""
    names = ["region", "item_id", "item"]
    walked = stage(region_keys(found, settings).join(item_keys(known, settings), ["length", "walk_key"]).select(names).distinct(), "walked")
    rows = found.select("region", "length", F.explode("grams").alias("gram"))
    shared = rows.join(item_grams(known, settings), ["length", "gram"]).select(names).distinct()
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in names]
    return walked, shared.alias("a").join(walked.alias("b"), reduce(Column.__and__, same), "left_anti")


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """(key, item_id, start_word, end_word, distance, item_words, by_walk): documents with the items that they contain.

    ``by_walk`` says whether a walk's key found the pair, or the completion by grams.
    """
    known = stage(item_rows(items, settings), "items")
    table, lengths = screen(known, settings)
    found = stage(region_rows(docs, key, table, lengths, settings).withColumn("region", F.monotonically_increasing_id()), "regions")
    walked, completed = candidates(found, known, settings)
    met = walked.withColumn("by_walk", F.lit(True)).unionByName(completed.withColumn("by_walk", F.lit(False)))
    pairs = met.join(found.select("region", "key", "start", "words"), "region").select("key", "start", "item_id", "words", "item", "by_walk")
    percent = settings.percent

    @F.pandas_udf("struct<distance:long,start:long,end:long,length:long>")
    def place(item: pd.Series, words: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(item, words):
            a = np.frombuffer(a, np.uint64)
            b, q = np.frombuffer(b, np.uint64), gram_size(len(a), settings)
            shared = int(np.isin(grams(a, q), grams(b, q)).sum())
            rows.append((*(best_stretch(a, b) if shared >= least_grams(len(a), settings) else (len(a), 0, 0)), len(a)))
        return pd.DataFrame(rows, columns=["distance", "start", "end", "length"], dtype="int64")

    place = place.asNondeterministic()  # else it is worked out for the filter and again for the result
    found = pairs.select("key", "item_id", "by_walk", F.col("start").alias("offset"), place("item", "words").alias("at")).where(
        F.col("at.distance") * 100 <= percent * F.col("at.length"))
    best = found.select("key", "item_id", F.struct(
        F.col("at.distance").alias("distance"), (F.col("offset") + F.col("at.start")).alias("start_word"),
        (F.col("offset") + F.col("at.end")).alias("end_word"), F.col("at.length").alias("item_words")).alias("best"), "by_walk",
    ).groupBy("key", "item_id").agg(F.min("best").alias("best"), F.max("by_walk").alias("by_walk"))
    return best.select(F.col("key").alias(key), "item_id", "best.start_word", "best.end_word", "best.distance", "best.item_words", "by_walk")


def row_name() -> Column:
    """The id as text; of a row without id its text's digest."""
    return F.coalesce(F.concat(F.lit("id:"), F.col("doc_id").cast("string")), F.concat(F.lit("text:"), F.md5(text_of())))


def drop_contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that contain no item, with their columns unchanged. Rows that share an id go together."""
    name = free_name("_row_name", docs)
    named = docs.withColumn(name, row_name())
    found = stage(matches(named, items, name, settings).select(name).distinct(), "contaminated")
    return named.join(found, name, "left_anti").select(*docs.columns)
