"""Vectorised hashing of words and word runs, with results that depend on the text only."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LETTER = np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64)
IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and its inverse modulo 2^64, computed as far as needed."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, 2 * len(self._up))
            ones = np.ones(1, dtype=np.uint64)
            self._up = np.cumprod(np.concatenate((ones, np.full(size - 1, BASE))))
            self._down = np.cumprod(np.concatenate((ones, np.full(size - 1, BASE_INVERSE))))
        return self._up[:n], self._down[:n]


powers = Powers()


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes as an array, with the first byte and the end of every word."""
    letters = np.frombuffer(raw, dtype=np.uint8)
    blank = np.ones(len(letters) + 2, dtype=bool)
    blank[1:-1] = IS_BLANK[letters]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return letters, edges[0::2], edges[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, in order."""
    if not raw:
        return np.empty(0, dtype=np.uint64)
    letters, starts, ends = word_bounds(raw)
    up, down = powers(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, dtype=np.uint64)
    np.cumsum(LETTER[letters] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words, by its first word."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words, A-Z lower-cased.

    A text of fewer words has its whole sequence as one; without words the set is
    empty.
    """
    words = word_hashes(text.encode().translate(LOWER)) if text else np.empty(0, dtype=np.uint64)
    if not len(words):
        return words
    return np.unique(run_hashes(words, min(width, len(words))) + np.uint64(min(width, len(words))))
