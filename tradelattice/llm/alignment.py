"""Alignment of two tokenizers: groups of tokens with common ends, and how often tokens of the one overlap those of the other.

Tokenizer A is byte-level BPE of the tokenizers library and reads the text after a space; B is a SentencePiece model, which
adds that space itself. The ends of A's character offsets and of B's proto spans are coarse cuts: they are exact where a token
covers whole characters. Tokens inside a multibyte character and byte-fallback tokens share a span with their neighbours;
their ends follow from the lengths of their decoded bytes, counted from the last exact cut.

Between a visible character and a space neither tokenizer makes a token (checked on B's vocabulary; A splits there), so a text
is cut into segments there and a block of texts aligns each distinct segment once. Blocks end after a bounded number of words.
A block sends its distinct (A id, B id) pairs with their counts, a row each, to be summed over the corpus, and gets the sums
back; so what is shuffled is linear in the blocks, and a frequent pair is one row of each.

Defined results: texts that are null, empty, or that either tokenizer doesn't give back byte for byte have no tokens and zeros;
control strings in texts are plain text; repeated rows count again; rows without id are kept; extra columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress
from operator import attrgetter
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelattice.session import stage

SPACE = "▁"
WORDS_IN_BLOCK, SEGMENTS_IN_BLOCK, LETTERS_IN_BLOCK = 3_000_000, 380_000, 36_000_000
CARRIED = 190_000  # frequent segments that the next block of a task starts with
TEXTS_AT_ONCE, LETTERS_AT_ONCE, NUMBERS_IN_ROW = 128, 200_000, 8192
TEXTS, SEGMENTS, PAIRS, TOTALS = range(4)  # kinds of rows of a block
SEGMENT = re.compile(r"(?<=\S)(?<!᠎)(?= [\s\S])")
UNSAFE = re.compile("[\\s᠎] ")
B_IDS = 1 << 24  # a pair is A id * B_IDS + B id
PIECE = attrgetter("id", "begin", "end")
ZSTD = zstandard.ZstdCompressor(level=1)


def byte_of_symbol() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, others follow 255."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(SPACE, " ").encode()


def numbers(rows: Iterable[tuple], count: int, width: int) -> np.ndarray:
    return np.fromiter(chain.from_iterable(rows), np.int64, count * width).reshape(count, width)


class Found(NamedTuple):
    """Of some segments the numbers of A tokens (0: its bytes don't come back), of B tokens and of links, the groups as lines
    of text, and all links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    groups: bytes
    links: np.ndarray

    @classmethod
    def joined(cls, parts: list[Found]) -> Found:
        return cls(*(np.concatenate([p[k] for p in parts]) for k in range(3)), b"\n".join(p.groups for p in parts), np.concatenate([p.links for p in parts]))

    def chosen(self, places: np.ndarray) -> Found:
        """The segments at ``places``, in order."""
        begins, n, lines = np.cumsum(self.n_links) - self.n_links, self.n_links[places], self.groups.split(b"\n")
        at = np.repeat(begins[places] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Found(self.n_a[places], self.n_b[places], n, b"\n".join([lines[k] for k in places.tolist()]), self.links[at])


class Aligner:
    """Aligns texts; holds both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_json: str, piece_proto: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_proto)
        symbols = byte_of_symbol()
        size = self.a.get_vocab_size()
        self.a_bytes = [b""] * size
        for token, number in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[number] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [piece_bytes(p) for p in pieces]
        self.segmented = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.a_length, self.b_length = (np.array([len(x) for x in known]) for known in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(known))] for known in (self.a_bytes, self.b_bytes))

    def segments(self, text: str) -> list[str]:
        """Stretches of space + text that can be aligned one by one, each without the space that it begins with."""
        if not self.segmented:
            return [text]
        if text[0] != " " and text[-1] != " " and not UNSAFE.search(text):
            return text.split(" ")
        return [s[1:] for s in SEGMENT.split(" " + text)]

    def tokens(self, spaced: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A ids, their ends, B ids, their ends), ends in bytes of ``spaced``; None if the tokens' bytes are not its bytes."""
        content = spaced.encode("utf-8", "surrogatepass")
        coded = self.a.encode(spaced, add_special_tokens=False)
        a_ids = np.array(coded.ids, np.int64)
        proto = self.b.encode(spaced[1:], return_type="proto").pieces
        b_spans = numbers(map(PIECE, proto), len(proto), 3)
        b_ids = b_spans[:, 0]
        if b"".join(map(self.a_bytes.__getitem__, a_ids.tolist())) != content or b"".join(map(self.b_bytes.__getitem__, b_ids.tolist())) != content:
            return None
        place = np.arange(len(spaced) + 1)
        if len(content) > len(spaced):
            points = np.frombuffer(spaced.encode("utf-32-le", "surrogatepass"), np.uint32)
            place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        offsets = numbers(coded.offsets, len(a_ids), 2)
        a_ends = refined(place[offsets[:, 0]], place[offsets[:, 1]], self.a_length[a_ids])
        spans = b_spans[:, 1:] + 1  # after the added space
        spans[:1, 0] = 0
        return a_ids, a_ends, b_ids, refined(spans[:, 0], spans[:, 1], self.b_length[b_ids])

    def aligned(self, segments: list[str]) -> Found:
        """Segments are aligned together, one after the other; only the last may end in white space. If the bytes of one of
        them don't come back, each is aligned alone."""
        found = self.tokens(" " + " ".join(segments))
        if found is None:
            if len(segments) == 1:
                return Found(*(np.zeros(1, np.int32) for _ in range(3)), b"", np.zeros(0, np.int64))
            return Found.joined([self.aligned([s]) for s in segments])
        a_ids, a_ends, b_ids, b_ends = found
        stops = np.cumsum(np.fromiter((1 + len(s.encode("utf-8", "surrogatepass")) for s in segments), np.int64, len(segments)))
        both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")  # two sorted runs
        twice = both[1:] == both[:-1]
        cuts, every = both[1:][twice], both[np.concatenate([[True], ~twice])]
        last = np.searchsorted(cuts, stops)
        if last[-1] == len(cuts) or (cuts[last] != stops).any():
            raise ValueError("a token crosses a segment")
        # Each stretch between neighbouring ends lies in one token of A and one of B: a link.
        links = a_ids[np.searchsorted(a_ends, every)] * B_IDS + b_ids[np.searchsorted(b_ends, every)]
        texts = self.group_texts(a_ids, np.searchsorted(cuts, a_ends), b_ids, np.searchsorted(cuts, b_ends))
        stop = (last + 1).tolist()
        groups = [";".join(texts[i:j]) for i, j in zip([0, *stop], stop)]
        n_a, n_b, n_links = (np.diff(np.searchsorted(ends, stops, "right"), prepend=0).astype(np.int32) for ends in (a_ends, b_ends, every))
        return Found(n_a, n_b, n_links, "\n".join(groups).encode(), links)

    def group_texts(self, a_ids: np.ndarray, a_group: np.ndarray, b_ids: np.ndarray, b_group: np.ndarray) -> list[str]:
        """``a1,a2|b1`` of every group."""
        sides = []
        for ids, group, text in ((a_ids, a_group, self.a_text), (b_ids, b_group, self.b_text)):
            words = list(map(text.__getitem__, ids.tolist()))
            begins = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
            ends = [*begins[1:], len(words)]
            sides.append([words[i] if j == i + 1 else ",".join(words[i:j]) for i, j in zip(begins, ends)])
        return list(map("|".join, zip(*sides)))


def refined(begins: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens in bytes: that of the span where it is as long as the token, else the last such end and the lengths since."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    exact, so_far = ends - begins == lengths, np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(exact, np.arange(len(lengths)), -1))
    known = last >= 0
    return so_far + np.where(known, ends[last] - so_far[last], 0)


class Numbers(dict):
    """The number of a segment; one that is asked for the first time gets the next, and waits to be aligned."""

    def __init__(self, known: Iterable[str]):
        super().__init__((s, k) for k, s in enumerate(known))
        self.waiting: list[str] = []

    def __missing__(self, segment: str) -> int:
        self.waiting.append(segment)
        number = self[segment] = len(self)
        return number


class Block:
    """Distinct segments of some texts, and which of them each text holds, in order."""

    def __init__(self, aligner: Aligner, known: Iterable[str] = (), found: Iterable[Found] = ()):
        self.aligner, self.known, self.found = aligner, Numbers(known), list(found)
        self.ids: list[int | None] = []
        self.n_segments: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.segments: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.words = self.letters = 0

    def full(self) -> bool:
        return self.words >= WORDS_IN_BLOCK or len(self.known) >= SEGMENTS_IN_BLOCK or self.letters >= LETTERS_IN_BLOCK

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        cut = [self.aligner.segments(t) if t else [] for t in texts]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        self.ids += ids
        self.n_segments.append(count)
        self.segments.append(np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int32, int(count.sum())))
        self.words += int(count.sum())
        begin = size = 0
        waiting, self.known.waiting = self.known.waiting, []
        for end, segment in enumerate(waiting, 1):
            size += len(segment)
            if not segment or segment[-1].isspace() or size >= LETTERS_AT_ONCE or not self.aligner.segmented or end == len(waiting):
                self.found.append(self.aligner.aligned(waiting[begin:end]))
                self.letters += size
                begin, size = end, 0

    def following(self) -> Block:
        """A new block that knows the frequent segments of this one."""
        times = np.bincount(np.concatenate(self.segments), minlength=len(self.known))
        often = times > 1
        if np.count_nonzero(often) > CARRIED:
            often[np.argsort(-times, kind="stable")[CARRIED:]] = False
        ends = np.cumsum([0, *(len(f.n_a) for f in self.found)])
        parts = [f.chosen(np.flatnonzero(often[a:b])) for f, a, b in zip(self.found, ends, ends[1:]) if often[a:b].any()]
        return Block(self.aligner, compress(self.known, often), parts)

    def rows(self) -> Iterator[dict]:
        """The block as rows of bounded size: its texts, its segments, and its pairs of ids with their counts."""
        held, count = np.concatenate(self.segments), np.concatenate(self.n_segments)
        n_a = np.concatenate([np.zeros(0, np.int32), *(f.n_a for f in self.found)])
        if not n_a.all():  # a text of which one segment doesn't come back has no tokens
            lost = np.zeros(len(count), bool)
            lost[np.repeat(np.arange(len(count)), count)[n_a[held] == 0]] = True
            held, count = held[~np.repeat(lost, count)], np.where(lost, 0, count)
        stops = np.concatenate([[0], np.cumsum(count)])
        for k in range(0, len(self.ids), TEXTS_AT_ONCE):
            part = slice(k, k + TEXTS_AT_ONCE)
            own = held[stops[k]:stops[min(k + TEXTS_AT_ONCE, len(self.ids))]]
            yield {"kind": TEXTS, "part": k, "ids": self.ids[part], "n": packed(count[part]), "places": packed(own)}
        pairs, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(f.links for f in self.found)]), return_inverse=True)
        times, n_links = np.bincount(held, minlength=len(n_a)), np.concatenate([np.zeros(0, np.int32), *(f.n_links for f in self.found)])
        counts = np.bincount(at, np.repeat(times, n_links), len(pairs)).astype(np.int64)
        end = 0
        for k, f in enumerate(self.found):
            begin, end = end, end + len(f.links)
            yield {"kind": SEGMENTS, "part": k, "n": packed(np.concatenate([f.n_a, f.n_b, f.n_links])), "places": packed(at[begin:end]),
                   "groups": ZSTD.compress(f.groups)}
        for k in range(0, len(pairs), NUMBERS_IN_ROW):
            part = slice(k, k + NUMBERS_IN_ROW)
            yield {"kind": PAIRS, "part": k, "ids": pairs[part], "counts": counts[part]}


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte by byte: the high ones are alike."""
    return ZSTD.compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(value: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(value), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


BLOCK = pa.schema([
    ("block", pa.string()), ("kind", pa.int32()), ("part", pa.int64()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("n", pa.binary()), ("places", pa.binary()), ("groups", pa.binary()),
])
BLOCK_SQL = "block string, kind int, part long, ids array<long>, counts array<long>, n binary, places binary, groups binary"
ALIGNED = pa.schema([
    ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups", pa.string()),
])
ALIGNED_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"

_aligners: dict[int, Aligner] = {}  # one a worker
_following: dict[int, Block] = {}


def blocks(docs: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """Blocks of aligned texts (part -1) and their pairs of ids (other parts). The two files are read on the driver."""
    with open(byte_json, encoding="utf-8") as a, open(piece_model, "rb") as b:
        held = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))  # as large as the vocabularies

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(held.value)
        if key not in _aligners:
            _aligners.clear()
            _following.clear()
            _aligners[key] = Aligner(*held.value)
        # A worker goes on with the frequent segments of its task before; what it knows changes no result.
        block, done, number = _following.pop(key, None) or Block(_aligners[key]), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                block.add(part.column(0).to_pylist(), part.column(1).to_pylist())
                if block.full():
                    for row in block.rows():
                        yield pa.RecordBatch.from_pylist([{"block": f"{number}-{done}"} | row], BLOCK)
                    block, done = block.following(), done + 1
        for row in block.rows() if block.ids else []:
            yield pa.RecordBatch.from_pylist([{"block": f"{number}-{done}"} | row], BLOCK)
        _following[key] = block.following() if block.ids else block

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCK_SQL)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a block out of its rows and the corpus-wide ``totals`` of its pairs (``ids``: the count, ``counts``: whether the highest)."""
    rows: tuple[list, list, list, list] = ([], [], [], [])
    for batch in batches:
        for row in batch.drop_columns("block").to_pylist():
            rows[row["kind"]].append(row)
    for kind in rows:
        kind.sort(key=lambda r: r["part"])
    joined = lambda kind, name: np.concatenate([np.zeros(0, np.int64), *(np.array(r[name], np.int64) for r in rows[kind])])
    texts = [g for r in rows[SEGMENTS] for g in zstandard.decompress(r["groups"]).decode().split("\n")]
    n_a, n_b, n_links = map(np.concatenate, zip(*(np.split(unpacked(r["n"]), 3) for r in rows[SEGMENTS]))) if texts else [np.zeros(0, np.int64)] * 3
    links = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["places"]) for r in rows[SEGMENTS])])
    ends = np.concatenate([[0], np.cumsum(n_links)])
    summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends])
    of = [n_a, n_b, np.array([t.count("|") for t in texts], np.int64), n_links, summed(joined(TOTALS, "counts")), summed(joined(TOTALS, "ids"))]
    for row in rows[TEXTS]:
        held, stops = unpacked(row["places"]), np.concatenate([[0], np.cumsum(unpacked(row["n"]))])
        whole = [np.diff(np.concatenate([[0], np.cumsum(x[held])])[stops]) for x in of]
        parts, stop = list(map(texts.__getitem__, held.tolist())), stops.tolist()
        groups = [";".join(parts[i:j]) for i, j in zip(stop, stop[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *map(pa.array, whole), pa.array(groups, pa.string())], schema=ALIGNED)


def align(docs: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), a row per row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of the tokens between two common ends. A link is an A and a B token that
    overlap; its count is that of its pair of ids over the corpus; ``n_best`` links have the highest count of their B id.
    """
    made = stage(blocks(docs, byte_json, piece_model), "aligned-blocks")
    met = made.where(F.col("kind") == PAIRS).select("block", "part", F.posexplode(F.arrays_zip("ids", "counts")).alias("place", "pair"))
    met = met.select("block", "part", "place", F.col("pair.ids").alias("pair"), F.col("pair.counts").alias("n"))
    totals = stage(met.groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    b_id = F.col("pair") % B_IDS
    highest = totals.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("highest"))
    known = totals.withColumn("b_id", b_id).join(highest, "b_id").select(
        "pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    told = met.select("block", "part", "place", "pair").join(known, "pair").groupBy("block", "part").agg(
        F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("told"))
    answers = told.select(
        "block", F.lit(TOTALS).alias("kind"), "part", F.transform("told", lambda x: x["total"]).alias("ids"),
        F.transform("told", lambda x: x["best"]).alias("counts"),
    )
    rows = made.where(F.col("kind") != PAIRS).unionByName(answers, allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(answered, ALIGNED_SQL)  # one block at a time is in memory
