"""Words of many texts at once, as spans of one buffer of bytes, and 64-bit hashes of spans."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * P)


class Powers:
    """P to the power 0, 1, ... and its inverse, modulo 2^64, as far as they were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(P), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)])) for x in (P, inverse))
        return self.up[:n], self.down[:n]


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in buf."""
    inside = np.concatenate([[False], ~SPACE[buf], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Of each span's bytes; equal bytes, equal hash, wherever they stand."""
    up, down = powers(len(buf))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[buf] * up)])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _MIX)
