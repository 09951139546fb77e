"""Words of a batch of texts as 64-bit hashes, computed with numpy over all texts at once.

A word is a run of letters and digits (Unicode categories L and N) of the text in lower case.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import bpe

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit integers over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


@lru_cache(1)
def _of_code() -> np.ndarray:
    return mixed(np.arange(1, 0x110002, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, 0x110000 after each, and where each text begins (with the end)."""
    joined = bpe.SEPARATOR.join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    bounds = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    codes[bounds[1:] - 1] = 0x110000
    return codes, bounds


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans: a polynomial modulo 2**64 over random values of the code points, then mixed."""
    if not len(codes):
        return np.empty(0, np.uint64)
    up, down = powers(len(codes) + 1)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_of_code()[codes] * up[: len(codes)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = bpe.classes()[codes]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = (kind == bpe.LETTER) | (kind == bpe.NUMBER)
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's words."""
    codes, bounds = codes_of([t.lower() for t in texts])
    starts, ends = word_spans(codes)
    return span_hashes(codes, starts, ends), np.searchsorted(starts, bounds)


def shingles_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by its first; the last n - 1 have none."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = (out + hashes[i : len(out) + i]) * np.uint64(_BASE)
    return mixed(out)
