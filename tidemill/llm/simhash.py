"""SimHash of word shingles, and links between fingerprints that differ in few bits by meeting in the middle.

Two fingerprints within radius r differ from some value in at most r / 2 bits each. So every fingerprint stands for all its
variants within r / 2 bits, and fingerprints that share a variant are linked. Variants are shuffled in a factored form: their
first bits (of positions chosen for balance) are the bucket, and what travels is the fingerprint itself, once for every bucket
that holds some variant of it; the rest of the variants are made where the bucket is worked on, in pieces of bounded size.
All fingerprints on one variant are within r of each other, so they are tied in a star, checked and reduced to a forest: the
links that leave a bucket are fewer than its fingerprints, however large a group is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.runtime import columns, cut, grouped, lean, texts

GROUP_BYTES = 1_500_000
SHINGLE, SEED, RADIUS = 4, 42, 4
BUCKET, MOST_BITS = 512, 24
PIECE = 2_000_000


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of the text's shingles: `size` words each, lower-cased and joined by spaces; of fewer words, all of them."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of counts[i] hashes: the bits that more than half of them have set; 0 for an empty run."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        starts = np.cumsum(counts[full]) - counts[full]
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > counts[full, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long. Null and empty texts have 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, GROUP_BYTES):
            ids, bodies = columns(group, "doc_id", "text")
            own = [shingle_hashes(b or b"", size) for b in bodies]
            counts = np.array([len(x) for x in own], np.int64)
            hashes = np.fromiter((h for x in own for h in x), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(majority(hashes, counts).view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(lean(work), "doc_id long, fp long")


def _flips(positions: list[int], most: int) -> list[tuple[np.uint64, int]]:
    return [(np.uint64(sum(1 << p for p in c)), k) for k in range(most + 1) for c in combinations(positions, k)]


def _variants(fp: np.ndarray, used: np.ndarray, free: list[int], half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Variants with the places of their fingerprints in fp, in pieces that share no variant. used: bits of half that are spent."""
    total = sum(int((used == k).sum()) * sum(math.comb(len(free), j) for j in range(half - k + 1)) for k in range(half + 1))
    if total > PIECE and free:
        bit, rest = np.uint64(1 << free[0]), free[1:]
        for value in (np.uint64(0), bit):
            spent = used + ((fp & bit) != value)
            keep = np.flatnonzero(spent <= half)
            for v, i in _variants((fp[keep] & ~bit) | value, spent[keep], rest, half):
                yield v, keep[i]
        return
    made, whose = [], []
    for k in range(half + 1):
        at = np.flatnonzero(used <= half - k)
        masks = np.array([m for m, j in _flips(free, k) if j == k], np.uint64)
        made.append((fp[at, None] ^ masks).reshape(-1))
        whose.append(np.repeat(at, len(masks)))
    yield np.concatenate(made), np.concatenate(whose)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least node that the links a-b reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def bucket_links(fp: np.ndarray, used: np.ndarray, anchored: np.ndarray, free: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie fingerprints of one bucket. anchored: fp with the bucket's bits; used: how many of them were changed."""
    a, b = [], []
    for variant, i in _variants(anchored, used, free, radius // 2):
        order = np.argsort(variant)
        variant, i = variant[order], i[order]
        same = variant[1:] == variant[:-1]
        a.append(i[:-1][same])
        b.append(i[1:][same])
    a, b = np.concatenate(a), np.concatenate(b)
    near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
    label = _forest(len(fp), a[near], b[near])
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (long): links whose components are those of all pairs of the distinct values `fp` within `radius` bits."""
    half = radius // 2
    stats = fps.agg(F.count("*"), *(F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))) for i in range(64))).first()
    n = stats[0]
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    chosen = sorted(range(64), key=lambda i: (abs((stats[i + 1] or 0) - n / 2), i))[:bits]
    free = [i for i in range(64) if i not in chosen]
    flips = _flips(list(range(bits)), half)

    def prefix(fp: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fp), np.uint64)
        for k, i in enumerate(chosen):
            out |= ((fp >> np.uint64(i)) & np.uint64(1)) << np.uint64(k)
        return out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(fp):
                continue
            own = prefix(fp)
            to = np.concatenate([own ^ m for m, _ in flips])
            order = np.argsort(to, kind="stable")
            to, sent = to[order], np.tile(fp, len(flips))[order]
            at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            blobs = [x.tobytes() for x in np.split(sent, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "fps"])

    def meet(key: tuple, held: pa.Table) -> pa.Table:
        bucket = np.uint64(key[0].as_py())
        fp = np.frombuffer(b"".join(held.column("fps").to_pylist()), np.uint64)
        used = np.bitwise_count(prefix(fp) ^ bucket).astype(np.int64)
        mask, value = np.uint64(sum(1 << i for i in chosen)), np.uint64(sum(((int(bucket) >> k) & 1) << i for k, i in enumerate(chosen)))
        a, b = bucket_links(fp, used, (fp & ~mask) | value, free, radius) if len(fp) > 1 else (fp[:0], fp[:0])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInArrow(lean(spread), "bucket long, fps binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (long), component_id: the least doc_id that links reach; fingerprints link at `radius` or fewer differing bits.

    Texts without words share the fingerprint 0 and link like any other; equal texts and repeated rows share one fingerprint,
    which is compared once; very long texts are read whole; an empty table gives no rows; other columns are ignored. A row
    without doc_id takes part, but names no component; one of such rows only has a null component_id."""
    held = cut(fingerprints(docs, size))
    fps = cut(held.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tied = cut(components(near_links(fps, radius)))
    named = fps.join(tied, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("own"), F.coalesce("component", "fp").alias("root"), "least")
    first = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("top"), "component_id")
    # keys of their own, so that adaptive execution can split a component, or a fingerprint, with very many rows
    labels = named.join(first, F.shiftleft("root", 0) == F.col("top")).select(F.shiftleft("own", 0).alias("own"), "component_id")
    return held.join(labels, F.col("fp") == F.col("own")).select("doc_id", "fp", "component_id")
