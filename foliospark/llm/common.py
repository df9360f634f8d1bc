"""What the training-data operators share: stored tables, word hashing, chunked reading of long texts."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, join_counted, materialise, shared_dir  # noqa: F401  for the operators

#: Texts are cut into pieces of about this many characters wherever lists of words are made, so memory doesn't grow with a text.
CHUNK_CHARS = 1 << 20

WORD = re.compile(r"\w+")
_SPACE = re.compile(r"\s")
_NOT_WORD = re.compile(r"\W")


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def pieces(text: str, size: int = CHUNK_CHARS, cut: re.Pattern = _SPACE):
    """The text in order, in pieces of at least `size` characters that end before a match of `cut` (a text without one is one piece)."""
    start = 0
    while len(text) - start > size:
        m = cut.search(text, start + size)
        if m is None:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


_FACTOR = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2**64 and their inverses, from 0 to n at least; kept for the worker's life."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, CHUNK_CHARS + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, f, np.uint64)])) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


class WordHashes:
    """64-bit hashes of the lower-case words (runs of letters, digits and underscores) of texts, by prefix sums of a polynomial over code points."""

    def __init__(self) -> None:
        self._word = np.fromiter((chr(c).isalnum() or c == 95 for c in range(1 << 16)), bool, 1 << 16)

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words of the whole text, in order."""
        out = [self._piece(piece) for piece in pieces(text, cut=_NOT_WORD)]
        return out[0] if len(out) == 1 else np.concatenate(out)

    def _piece(self, piece: str) -> np.ndarray:
        points = np.frombuffer(piece.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(points) + 2, np.int8)
        far = points >= 1 << 16
        if far.any():
            inside[1:-1] = self._word[np.where(far, 0, points)]
            inside[1:-1][far] = [chr(c).isalnum() for c in points[far]]
        else:
            inside[1:-1] = self._word[points]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        power, inverse = _powers(len(points))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * power[: len(points)], dtype=np.uint64, out=sums[1:])
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of hashes; one of the whole sequence if it is shorter, none if it is empty."""
    n = min(n, len(h))
    if n == 0:
        return h[:0]
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)
