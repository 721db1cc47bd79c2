"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

BPE gives every prefix of a byte string one encoding, and that encoding ends in one token. :class:`Prefixes` keeps this
last token for each prefix. The last token of a prefix is the only token ending there that (a) is its own encoding and
(b) follows the last token of the prefix before it without BPE having merged across the two. An automaton over the tokens
takes one step a byte and gives the longest token that ends there; shorter ones are tried only when it does not fit. So a
string is encoded in one pass, more bytes can be appended without starting over, and after an edit only the stretch until
the last tokens agree again is worked out anew.

Defined results of the columns: a null or empty text has no tokens and decodes to no bytes; repeated rows are encoded
each; extra columns pass through, names of new columns must be free; texts of any length are encoded whole. Null ids decode
to null.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHED_MATCHES, CACHED_PAIRS, CACHED_STEPS, CACHED_LENGTH = 100_000, 150_000, 300_000, 64  # per worker


class Recent(dict):
    """What was asked for lately: a full generation becomes the one before, whose entries come back when they are asked for."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.before = most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.worked_out(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        if isinstance(key, int) or len(key) <= CACHED_LENGTH:
            self[key] = value
        return value


def parse_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in content.splitlines() if line)}


class Steps(Recent):
    """The automaton: node * 256 + byte -> the node of the longest beginning of a token that then ends there."""

    def __init__(self, edges: dict[int, int], fail: array):
        super().__init__(CACHED_STEPS)
        self.edges, self.fail = edges, fail

    def worked_out(self, key: int) -> int:
        node, byte = key >> 8, key & 255
        while True:
            to = self.edges.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.fail[node]


class Apart(Recent):
    """Whether BPE leaves two tokens apart, by left * 2^32 + right."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(CACHED_PAIRS)
        self.vocabulary = vocabulary

    def worked_out(self, key: int) -> bool:
        return self.vocabulary.stays_apart(key >> 32, key & 0xFFFFFFFF)


class Vocabulary:
    """Ranks of byte strings, as in the lines "base64 rank" of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._whole: dict[int, tuple[int, ...]] = {}
        self._spines: dict[tuple[int, int], tuple[tuple[bytes, int], ...]] = {}
        edges: dict[int, int] = {}  # trie of the tokens that BPE makes: node * 256 + byte -> node; 0 is the root
        own: dict[int, int] = {}
        for piece, rank in ranks.items():
            if not self.parts(rank):
                continue
            node = 0
            for byte in piece:
                node = edges.setdefault(node << 8 | byte, len(edges) + 1)
            own[node] = rank
        # Nodes are numbered after the nodes above them only along a token, so they are visited by depth.
        size = len(edges) + 1
        fail, level = array("i", [0]) * size, [0]
        below: dict[int, list[int]] = {}
        for key, node in edges.items():
            below.setdefault(key >> 8, []).append(key)
        #: Of a node the longest token that ends there, and of a token the longest one that is its proper ending; -1 if none.
        self.at_node, self.shorter = [-1] * size, {}
        while level:
            deeper = []
            for node in level:
                for key in below.get(node, ()):
                    child, byte, back = edges[key], key & 255, fail[node]
                    while node:
                        to = edges.get(back << 8 | byte)
                        if to is not None:
                            fail[child] = to
                            break
                        if not back:
                            break
                        back = fail[back]
                    ending = self.at_node[fail[child]]
                    rank = own.get(child)
                    if rank is not None:
                        self.shorter[rank] = ending
                    self.at_node[child] = ending if rank is None else rank
                    deeper.append(child)
            level = deeper
        self.length = {rank: len(piece) for rank, piece in self.pieces.items()}
        if len([p for p in ranks if len(p) == 1]) < 256:
            raise ValueError("every byte needs a token")
        self.steps, self.apart = Steps(edges, fail), Apart(self)

    @classmethod
    def parse(cls, content: bytes) -> Vocabulary:
        return cls(parse_ranks(content))

    def parts(self, token: int) -> tuple[int, ...]:
        """The two tokens that BPE joins last in making ``token``; the token alone if it is a byte; () if BPE never makes it."""
        known = self._whole.get(token)
        if known is None:
            piece = self.pieces[token]
            parts = [bytes([b]) for b in piece]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
                if parts[best] + parts[best + 1] not in self.ranks:
                    break
                parts[best:best + 2] = [parts[best] + parts[best + 1]]
            known = tuple(self.ranks[p] for p in parts) if len(parts) <= 2 else ()
            self._whole[token] = known
        return known

    def spine(self, token: int, side: int) -> tuple[tuple[bytes, int], ...]:
        """The tokens that once stood at an end (0 left, 1 right) of ``token``, the largest first, each with the rank that took it away."""
        known = self._spines.get((token, side))
        if known is None:
            found, gone = [], 1 << 40
            while True:
                found.append((self.pieces[token], gone))
                halves = self.parts(token)
                if len(halves) < 2:
                    break
                token, gone = halves[side], token
            known = self._spines[self.ranks[found[0][0]], side] = tuple(found)
        return known

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart.

        Of the tokens that once stood at the seam, some x on the left and y on the right merge if x + y is a token of
        a rank before the one that took x away, and not after the one that took y away (equal ranks go left to right).
        """
        joined, others = self.ranks.get, self.spine(right, 0)
        for x, x_gone in self.spine(left, 1):
            for y, y_gone in others:
                rank = joined(x + y)
                if rank is not None and rank < x_gone and rank <= y_gone:
                    return False
        return True

    def tokens(self, piece: bytes) -> list[int]:
        """The encoding of ``piece``, by the last token of each of its prefixes."""
        steps, apart, at_node, shorter, length, last, node, end = self.steps, self.apart, self.at_node, self.shorter, self.length, [-1], 0, 0
        for byte in piece:
            node = steps[node << 8 | byte]
            end += 1
            token = at_node[node]
            start = end - length[token]
            while start and not apart[last[start] << 32 | token]:
                token = shorter[token]
                start = end - length[token]
            last.append(token)
        found = []
        while end:
            token = last[end]
            found.append(token)
            end -= length[token]
        found.reverse()
        return found


class Prefixes:
    """The last token of every prefix of a byte string. Later bytes never change it, so appending only adds prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.nodes = vocabulary, bytearray(), [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        v, last, nodes = self.vocabulary, self.last, self.nodes
        steps, apart, at_node, shorter, length, node, end = v.steps, v.apart, v.at_node, v.shorter, v.length, nodes[-1], len(last) - 1
        self.data += more
        for byte in more:
            node = steps[node << 8 | byte]
            end += 1
            token = at_node[node]
            start = end - length[token]
            while start and not apart[last[start] << 32 | token]:
                token = shorter[token]
                start = end - length[token]
            last.append(token)
            nodes.append(node)

    def last_at(self, end: int) -> int:
        return self.last[end]

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; returns how many prefixes had to be worked out anew.

        What follows the edit keeps its last tokens from where they agree again over the length of the longest token.
        """
        last, nodes, tail, longest = self.last, self.nodes, bytes(self.data[stop:]), self.vocabulary.longest
        self.data, self.last, self.nodes = self.data[:start], last[:start + 1], nodes[:start + 1]
        self.append(new)
        moved, agree = start + len(new) - stop, 0
        for k, byte in enumerate(tail):
            self.append(tail[k:k + 1])
            at = stop + k + 1
            agree = agree + 1 if self.last[-1] == last[at] else 0
            if agree >= longest:
                self.data += tail[k + 1:]
                self.last += last[at + 1:]
                self.nodes += nodes[at + 1:]
                return at + moved - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        found, end, length = [], len(self.data), self.vocabulary.length
        while end:
            found.append(self.last[end])
            end -= length[found[-1]]
        return found[::-1]


class Encoder(Recent):
    """Encodes texts match by match of a pattern; a match that is a token as it stands is that token."""

    def __init__(self, content: bytes, pattern: str):
        super().__init__(CACHED_MATCHES)
        self.vocabulary, self.find = Vocabulary.parse(content), regex.compile(pattern).findall

    def worked_out(self, match: str) -> bytes:
        piece = match.encode("utf-8", "surrogatepass")
        token = self.vocabulary.ranks.get(piece)
        return ids_bytes([token] if token is not None else self.vocabulary.tokens(piece))

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text or "")))

    def forget(self) -> None:
        """Empty the caches: a worker that goes on to other work shall not hold them."""
        for cache in (self, self.vocabulary.steps, self.vocabulary.apart):
            cache.clear()
            cache.before = {}


def ids_bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


_encoders: dict[tuple[int, str], Encoder] = {}
_pieces: dict[int, dict[int, bytes]] = {}


def encoder(held: Broadcast, pattern: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    content = held.value
    key = (hash(content), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content, pattern)
    return _encoders[key]


def pieces(held: Broadcast) -> dict[int, bytes]:
    """The bytes of every token; a worker that only decodes holds nothing else."""
    content = held.value
    key = hash(content)
    if key not in _pieces:
        _pieces.clear()
        _pieces[key] = {rank: piece for piece, rank in parse_ranks(content).items()}
    return _pieces[key]


def joined(ids: bytes, piece: Callable[[int], bytes]) -> bytes:
    return b"".join(map(piece, np.frombuffer(ids, "<u4").tolist()))


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The rank file at ``path`` (on the driver), sent to the executors: its size is the vocabulary's, never the data's."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(text: Column, held: Broadcast, pattern: str) -> Column:
    """Token ids of ``text`` as little-endian unsigned 32-bit integers."""
    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(held, pattern)
        for texts in batches:
            yield pd.Series([own.ids(t) for t in texts], dtype=object)
        own.forget()

    return ids(text)


def decode(ids: Column, held: Broadcast) -> Column:
    """The bytes that ids stand for."""
    @F.pandas_udf("binary")
    def content(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        piece = pieces(held).__getitem__
        for rows in batches:
            yield pd.Series([None if r is None else joined(r, piece) for r in rows], dtype=object)

    return content(ids)


def round_trip(text: Column, held: Broadcast, pattern: str) -> Column:
    """(ids, decoded): the ids of ``text`` and the bytes that they decode to, by one Python worker a task."""
    @F.pandas_udf("ids binary, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, piece = encoder(held, pattern), pieces(held).__getitem__
        for texts in batches:
            ids = [own.ids(t) for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [joined(i, piece) for i in ids]}, dtype=object)
        own.forget()

    return both(text)


def with_ids(docs: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of its ``text`` and, if named, the bytes they decode to. Raises if ``docs`` has such columns already."""
    taken = {c.lower() for c in docs.columns} & {n.lower() for n in (ids, decoded) if n}
    if taken:
        raise ValueError(f"columns are there already: {sorted(taken)}")
    held, text = vocabulary(docs.sparkSession, path), F.coalesce(F.col("text"), F.lit(""))
    if decoded is None:
        return docs.withColumn(ids, encode(text, held, pattern))
    coded = round_trip(text, held, pattern)
    return docs.withColumns({ids: coded["ids"], decoded: coded["decoded"]})


def n_tokens(ids: str | Column) -> Column:
    return (F.octet_length(F.col(ids) if isinstance(ids, str) else ids) / 4).cast("long")
