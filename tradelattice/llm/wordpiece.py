"""Numbers of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie. Each node that no further character extends has a failure link, to the node that is reached
after the longest pieces of what was read so far have been taken off, and the number of pieces taken off. So a word of
n characters costs about 2n steps, whatever the pieces, and no piece is built.

A word is matched with a mark before it, so pieces with the mark start words and the others continue them. A word that
no pieces cover counts as one unknown token.

Defined results: null and empty texts have no words and no tokens; repeated rows are counted each; extra columns pass.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHED_WORDS, CACHED_LENGTH = 400_000, 64
FAILED = -1


class Automaton:
    def __init__(self, pieces: Iterable[str]):
        self.step: list[dict[str, int]] = [{}]
        ends = set()
        for piece in pieces:
            node = 0
            for char in piece:
                node = self.step[node].setdefault(char, len(self.step))
                if node == len(self.step):
                    self.step.append({})
            if piece:
                ends.add(node)
        self.link, self.popped = [FAILED] * len(self.step), [0] * len(self.step)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for char, node in self.step[above].items():
                queue.append(node)
                if node in ends:
                    self.link[node], self.popped[node] = 0, 1
                    continue
                at, taken = self.link[above], self.popped[above]
                while at != FAILED and char not in self.step[at]:
                    taken += self.popped[at]
                    at = self.link[at]
                if at != FAILED:
                    self.link[node], self.popped[node] = self.step[at][char], taken
        self.known: dict[str, int] = {}

    def count(self, marked: str) -> int:
        """Pieces of a marked word; ``FAILED`` if none cover it."""
        step, link, popped, at, count = self.step, self.link, self.popped, 0, 0
        for char in marked:
            while char not in step[at]:
                if link[at] == FAILED:
                    return FAILED
                count += popped[at]
                at = link[at]
            at = step[at][char]
        while at:
            if link[at] == FAILED:
                return FAILED
            count += popped[at]
            at = link[at]
        return count

    def word(self, word: str) -> int:
        known = self.known.get(word)
        if known is None:
            known = self.count(MARK + word)
            if len(word) <= CACHED_LENGTH:
                if len(self.known) >= CACHED_WORDS:
                    self.known.clear()
                self.known[word] = known
        return known

    def text(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown words of a text."""
        counts = list(map(self.word, (text or "").split()))
        unknown = counts.count(FAILED)
        return len(counts), sum(counts) + 2 * unknown, unknown


_automata: dict[int, Automaton] = {}  # one a worker, by the vocabulary it holds


def pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model (on the driver): no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def with_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``docs`` with a struct ``pieces`` of n_words, n_tokens and n_unknown. The vocabulary's size is the tokenizer's.

    Raises if ``docs`` has a column ``pieces`` already.
    """
    if "pieces" in {c.lower() for c in docs.columns}:
        raise ValueError("column pieces is there already")
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("struct<n_words:long,n_tokens:long,n_unknown:long>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        key = id(held.value)
        if key not in _automata:
            _automata.clear()
            _automata[key] = Automaton(held.value)
        own = _automata[key]
        for texts in batches:
            yield pd.DataFrame([own.text(t) for t in texts], columns=["n_words", "n_tokens", "n_unknown"], dtype="int64")

    return docs.withColumn("pieces", counted("text"))
