"""Helpers that several operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.session import stash

__all__ = ["FOLDS", "HELD_OUT", "Memo", "SPACE", "WORD", "WordRows", "fold", "letters", "mix", "stash", "subwords"]

#: Rows whose crc32(doc_id) leaves this remainder by FOLDS are never learned from.
FOLDS, HELD_OUT = 4, 2
#: A character that separates words, as a regular expression class and as its complement.
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column) -> Column:
    """Remainder that decides whether a row may be learned from; 0 for rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


class Memo(dict):
    """A bounded word table of one task: ``fill`` maps words never seen before to their values, a block at a time. When
    ``limit`` words are held they become the old generation, from which words still in use come back; so memory is bounded
    and results are not touched."""

    def __init__(self, fill: Callable[[list[str]], Iterable], limit: int = 400_000):
        super().__init__()
        self.fill, self.limit, self.old = fill, limit, {}

    def of(self, words: list) -> list:
        """Values of ``words``, in order; no value is None."""
        values = list(map(self.get, words))
        if None in values:
            fresh = list({w for w, v in zip(words, values) if v is None})
            if self.old:
                self.update((w, v) for w in fresh if (v := self.old.get(w)) is not None)
                fresh = [w for w in fresh if w not in self]
            self.update(zip(fresh, self.fill(fresh) if fresh else ()))
            values = list(map(self.__getitem__, words))
            if len(self) > self.limit:
                self.old = dict(self)
                self.clear()
        return values


class WordRows:
    """Numbers of words, ``width`` of them each, computed a block of new words at a time and kept in one bounded table."""

    def __init__(self, fill: Callable[[list[str]], np.ndarray], width: int, limit: int = 200_000, block: int = 20_000, kind=np.float32):
        self.fill, self.limit, self.block, self.known = fill, limit, block, {}
        self.table = np.zeros((limit + block, width), kind)

    def of(self, words: list[str]) -> np.ndarray:
        """A row per word, in order."""
        blocks = [words[k : k + self.block] for k in range(0, len(words), self.block)]
        return np.concatenate([self._block(b) for b in blocks] or [self.table[:0]])

    def _block(self, words: list[str]) -> np.ndarray:
        rows = list(map(self.known.get, words))
        if None in rows:
            if len(self.known) > self.limit:
                self.known.clear()
                rows = [None] * len(words)
            fresh = list({w for w, r in zip(words, rows) if r is None})
            start = len(self.known)
            self.table[start : start + len(fresh)] = self.fill(fresh)
            self.known.update(zip(fresh, range(start, start + len(fresh))))
            rows = list(map(self.known.__getitem__, words))
        return self.table[rows]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (xor-shift and multiply, twice)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def subwords(words: list[str], sizes: Iterable[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of ``<word>`` in 2**bits buckets: (bucket, number of the word) for each n-gram."""
    points = np.frombuffer("".join(f"<{w}>\n" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = points == 10
    owner = np.cumsum(ends) - ends
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h + points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            inside = (owner[: len(h)] == owner[n - 1 :]) & ~ends[n - 1 :]
            buckets.append((mix(h[inside]) >> np.uint64(64 - bits)).astype(np.int64))
            owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets or [np.zeros(0, np.int64)]), np.concatenate(owners or [np.zeros(0, np.int64)])


def letters(word: str) -> str:
    """The word without what is no letter."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))
