"""Context-tree weighting over bytes, each decomposed into the binary decisions of a Huffman code.

A node is a context (the `depth` bytes before) and an inner node of the code's tree; frequent bytes have few decisions, and so few
estimates to learn. It estimates its next bit by Krichevsky-Trofimov,
and the tree weights, at every node, that estimate against the product of the nodes one byte of context deeper:

    log Pw = log 1/2 + logaddexp(log Pe, sum of the children's log Pw),   Pw = Pe at the full depth.

From the final counts of a corpus this is one pass over the depths, deepest first. What the weights mix for the next bit is
p = w * kt + (1 - w) * (p of the child), with w = Pe / (Pe + product of the children's Pw); a child that the corpus never had
leaves p = kt. Contexts are packed with the nearest byte on top, so that a node's parent is a shift away.
"""

from __future__ import annotations

import heapq

import numpy as np

LOG_PI = float(np.log(np.pi))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x > 0: Stirling's series, after 8 steps of the recurrence."""
    shift = np.zeros_like(x)
    y = x.astype(np.float64)
    for _ in range(8):
        shift += np.log(y)
        y = y + 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Krichevsky-Trofimov block probability of a zeros and b ones, as a natural logarithm."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - LOG_PI - log_gamma(a + b + 1.0)


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted different keys, and the sums of values over each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


class Decisions:
    """A Huffman code of all 256 bytes: the inner nodes (1 to 255, 1 the root) and bits on the path to each byte."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, 256 + i) for i, c in enumerate(counts)]  # under 256: inner nodes
        heapq.heapify(heap)
        children = {}
        for node in range(255, 0, -1):
            (m, a), (n, b) = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = a, b
            heapq.heappush(heap, (m + n, node))
        paths: list[list[tuple[int, bool]]] = [[] for _ in range(512)]
        for node in range(1, 256):  # a parent's number is less than its children's
            for bit, child in enumerate(children[node]):
                paths[child] = [*paths[node], (node, bool(bit))]
        self.steps = max(map(len, paths))
        self.node, self.bit = np.zeros((self.steps, 256), np.uint64), np.zeros((self.steps, 256), bool)
        for byte, path in enumerate(paths[256:]):
            for k, (node, bit) in enumerate(path):
                self.node[k, byte], self.bit[k, byte] = node, bit


def nodes(codes: np.ndarray, n: np.ndarray, by: Decisions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (context << 8 | inner node), zeros and ones of the binary nodes below coded (context << 8 | byte) counts."""
    byte = (codes & np.uint64(255)).astype(np.int64)
    context = codes - (codes & np.uint64(255))
    keys, zeros, ones = [], [], []
    for k in range(by.steps):
        on = np.flatnonzero(by.node[k, byte])
        bit = by.bit[k, byte[on]]
        got = summed(context[on] | by.node[k, byte[on]], np.where(bit, 0, n[on]), np.where(bit, n[on], 0))
        for x, y in zip((keys, zeros, ones), got, strict=True):
            x.append(y)
    return summed(np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones))


def up(keys: np.ndarray) -> np.ndarray:
    """Keys or codes with the farthest byte of their context taken off."""
    return ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))


def levels(codes: np.ndarray, n: np.ndarray, by: Decisions, depth: int, last: int, below: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list, list, list, tuple, tuple]:
    """Of the depths `last` to `depth`: keys, kt and own of the nodes; then the keys one depth up and log Pw of those of `last`; and codes
    and counts one depth up. below: the same keys and log Pw of the nodes deeper than `depth`; none at the full depth."""
    keys, kt, own = [], [], []
    for _ in range(depth, last - 1, -1):
        at, zeros, ones = nodes(codes, n, by)
        pw = pe = log_kt(zeros.astype(np.float64), ones.astype(np.float64))
        weight = np.ones(len(at))
        if below is not None:
            product = np.bincount(np.searchsorted(at, below[0]), below[1], minlength=len(at))
            weight = 1 / (1 + np.exp(np.clip(product - pe, -700, 700)))
            pw = np.log(0.5) + np.logaddexp(pe, product)
        keys.insert(0, at)
        kt.insert(0, ((ones + 0.5) / (zeros + ones + 1)).astype(np.float32))
        own.insert(0, weight.astype(np.float32))
        below = up(at), pw
        codes, n = summed(up(codes), n)
    return keys, kt, own, below, (codes, n)


class Tree:
    """keys[d], kt[d] (probability of a one) and own[d] (weight of it) of the nodes of depth d."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, depth: int):
        order = np.argsort(codes)
        codes, n = codes[order].astype(np.uint64), n[order].astype(np.int64)
        by = Decisions(np.bincount((codes & np.uint64(255)).astype(np.int64), n, minlength=256))
        self._set(by, *levels(codes, n, by, depth, 0)[:3])

    def _set(self, by: Decisions, keys: list, kt: list, own: list) -> None:
        self.depth, self.by, self.keys, self.kt, self.own = len(keys) - 1, by, keys, kt, own

    @classmethod
    def of(cls, by: Decisions, *parts: tuple[list, list, list]) -> Tree:
        """From the levels of its parts, those of the least depth first; without a table of coded bytes."""
        tree = cls.__new__(cls)
        tree._set(by, *(sum((list(p[k]) for p in parts), []) for k in range(3)))
        return tree

    def slow(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each coded byte in its context, by its path through the tree."""
        out = np.zeros(len(codes))
        byte = (codes & np.uint64(255)).astype(np.int64)
        for k in range(self.by.steps):
            on = np.flatnonzero(self.by.node[k, byte])
            key, bit = (codes[on] - (codes[on] & np.uint64(255))) | self.by.node[k, byte[on]], self.by.bit[k, byte[on]]
            p, known = np.full(len(on), 0.5), np.zeros(len(on), bool)
            for d in range(self.depth, -1, -1):
                if len(self.keys[d]):
                    at = np.minimum(np.searchsorted(self.keys[d], key), len(self.keys[d]) - 1)
                    there = self.keys[d][at] == key
                    kt, own = self.kt[d][at], self.own[d][at]
                    p = np.where(there, np.where(known, own * kt + (1 - own) * p, kt), p)
                    known |= there
                if d:
                    key = up(key)
            out[on] += np.log10(np.where(bit, p, 1 - p))
        return out.astype(np.float32)


def coded(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """The coded bytes of pieces of buf, each led by `depth` bytes that are context only."""
    wide = buf.astype(np.uint64)
    codes = wide[depth:].copy()
    for d in range(1, depth + 1):
        codes |= wide[depth - d : len(buf) - d] << np.uint64(8 * (depth - d + 1))
    keep = np.ones(len(codes), bool)  # by the place of the byte, less depth
    if depth:
        lead = (starts[1:, None] + np.arange(depth) - depth).reshape(-1)
        keep[lead] = False
    return codes[keep]
