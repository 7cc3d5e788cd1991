"""Words and pairs of words of many texts at once, as 64-bit hashes.

A word is a run of letters, digits and underscores; pairs are formed after stop words went, as
``vectors.explode_terms`` does row by row. Equal hashes count as equal terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Characters that are hashed at a time; a longer text is taken whole.
PIECE = 1 << 20
_CODES = 0x110000
_ODD = 0x9E3779B97F4A7C15
_word: list[bytes] = []


def word_class(spark: SparkSession) -> bytes:
    """One bit per code point: whether the JVM's regular expressions take it for part of a word."""
    if not _word:
        every = spark.range(_CODES).filter("id < 55296 or id > 57343")  # no surrogates
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        found = every.filter(char.rlike(r"^[\p{L}\p{N}_]$")).toArrow()["id"].to_numpy()
        flags = np.zeros(_CODES, bool)
        flags[found] = True
        _word.append(np.packbits(flags).tobytes())
    return _word[0]


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of ``x``; no two values become one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _flags(word: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(word, np.uint8)).astype(bool)


@lru_cache(1)
def _numbers() -> np.ndarray:
    """A 64-bit number for each code point."""
    return spread_bits(np.arange(1, _CODES + 1, dtype=np.uint64) * np.uint64(_ODD))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _ODD, np.uint64)
    back = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.cumprod(base), np.cumprod(back)


def _hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each stretch of ``codes``."""
    up, down = _powers(max(PIECE, 1 << max(len(codes) - 1, 1).bit_length()))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_numbers()[codes] * up[: len(codes)], out=sums[1:])
    return spread_bits((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _decoded(texts: pa.Array) -> tuple[str, np.ndarray, np.ndarray]:
    """(the texts in one, their code points, the end of each)."""
    parts = [t or "" for t in texts.to_pylist()]
    whole = "".join(parts)
    return whole, np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.cumsum([len(p) for p in parts])


def hash_words(words: Sequence[str]) -> np.ndarray:
    """The hash of each string as one word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    _, codes, ends = _decoded(pa.array(words, pa.string()))
    return _hashes(codes, np.append(0, ends[:-1]), ends)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return spread_bits(first * np.uint64(_ODD) + spread_bits(second))


def hash_terms(terms: Sequence[str]) -> np.ndarray:
    """The hash of each term: a word, or two with a space between."""
    split = [t.split(" ") for t in terms]
    first, second = hash_words([s[0] for s in split]), hash_words([s[-1] for s in split])
    return np.where([len(s) > 1 for s in split], pair_hashes(first, second), first) if split else first


@dataclass(frozen=True)
class Grams:
    """Words and then pairs of words of a piece of texts; rows ascend in each of the two."""

    row: np.ndarray
    hash: np.ndarray
    whole: str
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of the pairs: the place of the first word

    def name(self, at: int) -> str:
        """The term of gram number ``at``."""
        if at < len(self.start):
            return self.whole[self.start[at] : self.end[at]]
        i = int(self.first[at - len(self.start)])
        return f"{self.name(i)} {self.name(i + 1)}"


@dataclass(frozen=True)
class Splitter:
    """Splits lower-cased texts into the hashes of their terms."""

    word: bytes
    stops: np.ndarray  # sorted hashes
    least: int = 1  # characters of a word

    def pieces(self, texts: pa.Array | pa.ChunkedArray) -> Iterator[Grams]:
        """Rows are numbered through all ``texts``."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + PIECE, "right")))
            yield self._piece(texts.slice(at, to - at), at)
            at = to

    def _piece(self, texts: pa.Array, offset: int) -> Grams:
        whole, codes, ends = _decoded(texts)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = _flags(self.word)[codes]
        edge = np.zeros(len(codes) + 1, bool)  # between two texts
        edge[ends] = edge[0] = True
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        long = end - start >= self.least
        start, end = start[long], end[long]
        hashed = _hashes(codes, start, end)
        if len(self.stops):
            place = np.minimum(np.searchsorted(self.stops, hashed), len(self.stops) - 1)
            kept = self.stops[place] != hashed
            start, end, hashed = start[kept], end[kept], hashed[kept]
        row = np.searchsorted(ends, start, "right").astype(np.int32) + np.int32(offset)
        first = np.flatnonzero(row[1:] == row[:-1])
        pairs = pair_hashes(hashed[first], hashed[first + 1])
        return Grams(np.concatenate([row, row[first]]), np.concatenate([hashed, pairs]), whole, start, end, first)


def splitter(spark: SparkSession, stops: Sequence[str], least: int = 1) -> Splitter:
    return Splitter(word_class(spark), np.sort(hash_words(stops)), least)
