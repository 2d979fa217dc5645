"""Hashes of words and of word windows, for whole texts at once in numpy; the same in every process."""

from __future__ import annotations

import numpy as np

#: Words are runs of bytes but these (the pattern [^\x20\x09-\x0D]+; all are ASCII).
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = 0

_BYTE_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_WORD_BASE = 0xD1342543DE82EF95


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.back))
        return self.up[:n], self.down[:n]


_bytes, _words = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes each output bit with about even chance."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges (starts, ends) of the words of a UTF-8 text."""
    edge = np.zeros(len(raw) + 2, np.int8)
    edge[1:-1] = _IS_WORD[np.frombuffer(raw, np.uint8)]
    edge = np.diff(edge)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text."""
    starts, ends = spans(raw)
    up, down = _bytes.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of ``n`` words, from the words' hashes."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    up, down = _words.get(len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[n:] - sums[:k]) * down[:k])
