"""Hashes of words and of runs of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words (bytes); at most `size` are held, then it starts afresh."""

    def __init__(self, size: int = 500_000, seed: int = 0):
        self.size, self.seed = size, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.size:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each run of `k` numbers; doubling makes it a few passes. Empty if there are fewer."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    done, width, total = None, 1, 0
    run = h
    powers = {1: int(MULTIPLIER)}
    while True:
        if k & width:
            if done is None:
                done, total = run, width
            else:  # `run` covers what follows the `total` numbers of `done`
                n = len(h) - total - width + 1
                done = done[:n] * np.uint64(powers[width]) + run[total : total + n]
                total += width
        if total == k:
            return mix(done)
        run = run[: len(run) - width] * np.uint64(powers[width]) + run[width:]
        powers[2 * width] = powers[width] ** 2 % 2**64
        width *= 2


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; empty for null."""
    for t in column:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def fingerprint(words: list[bytes]) -> int:
    """Signed 64-bit key of a whole sequence of words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63
