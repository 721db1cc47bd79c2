"""Words of a text as 64-bit hashes, for tasks that work on arrays."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED_WORDS = 400_000  # per worker
STEP, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8. (On bytes both act on ASCII alone.)"""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * MIX_A
    values = (values ^ (values >> np.uint64(27))) * MIX_B
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    """Hash of a word, kept for words met before."""

    def __missing__(self, word: bytes | str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes] | list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    rolled = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        rolled = mixed(rolled * STEP + words[k:len(words) - size + 1 + k])
    return np.unique(rolled)
