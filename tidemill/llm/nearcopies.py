"""Near copies by similarity of word shingles, found by SimHash ball hashing and checked exactly.

Texts are linked that have LEAST of their five-word shingles (as sets) in common, of all that either has. Candidates come from FAMILIES
fingerprints of WIDTH bits each, independent of one another, over two-word shingles, since an edit touches fewer of those: at a
similarity of 0.8 about a tenth of the bits differ, and of four fingerprints one is within 4 bits in about 19 of 20 cases, more often
above. Each fingerprint stands for all its variants within half the radius (simhash.py). Of the texts that share a variant with it,
each meets the one of least id, and the last one before it in order of id, by each family: up to 8 candidates a text, however large a
group is. A text of a group so meets what stays of it, and one of a row of versions the version before.

Candidates are checked on whole texts: each text with its least partner first, and then the rest. For the rest nothing is capped: of
all texts that have a candidate, those that links leave apart are joined by the rarest of their shingles, so many of them that two
texts with LEAST in common must share one, and only pairs that can still have that much in common are checked. What a large group's
texts share is not rare, and what an edit makes is in one text only, so few pairs are left to check. Equal texts are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components
from tidemill.llm.runtime import columns, cut, grouped, lean, release, texts
from tidemill.llm.simhash import _flips, _variants
from tidemill.llm.spans import P, Powers, hashes, mixed, word_spans

SHINGLE, LEAST = 5, 0.8
PAIR, FAMILIES, WIDTH, RADIUS = 2, 4, 48, 4
BUCKET, MOST_BITS = 8192, 24
GROUP_BYTES = 1_500_000


def shingles(word: np.ndarray, doc: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text by text, and how many each of n texts has; a text of fewer words has one, of all of them."""
    m = max(0, len(word) - size + 1)
    window = np.zeros(m, np.uint64)
    for k in range(size):
        window = window * P + word[k : m + k]
    whole = doc[:m] == doc[size - 1 : m + size - 1]
    h, whose = mixed(window[whole]), doc[:m][whole]
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    few = np.flatnonzero((words > 0) & (words < size))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        for k in range(size - 1):
            more = k < words[few]
            own = np.where(more, own * P + word[np.minimum(first[few] + k, len(word) - 1)], own)
        h, whose = np.concatenate([h, mixed(own)]), np.concatenate([whose, few])
        order = np.argsort(whose, kind="stable")
        h, whose = h[order], whose[order]
    return h, np.bincount(whose, minlength=n)


def fingerprints(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of FAMILIES fingerprints for each run of counts[i] hashes: the bits that more than half have set."""
    full = np.flatnonzero(counts)
    bits = np.zeros((len(counts), -(-FAMILIES * WIDTH // 64) * 64), bool)
    starts = np.cumsum(counts[full]) - counts[full]
    for j, more in enumerate(np.arange(1, bits.shape[1] // 64 + 1, dtype=np.uint64) * P) if len(full) else ():
        made = np.unpackbits(mixed(h + more).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        bits[full, 64 * j : 64 * j + 64] = 2 * np.add.reduceat(made, starts, axis=0, dtype=np.int32) > counts[full, None]
    out = np.zeros((len(counts), FAMILIES, 64), bool)
    out[:, :, :WIDTH] = bits[:, : FAMILIES * WIDTH].reshape(-1, FAMILIES, WIDTH)
    return np.packbits(out, axis=2, bitorder="little").view("<u8").reshape(-1, FAMILIES)


def _words(bodies: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of texts, and the text of each."""
    buf = np.frombuffer(b"\n".join(b.lower() for b in bodies) + b"\n", np.uint8)
    start, end = word_spans(buf)
    return hashes(buf, start, end, powers), np.searchsorted(np.cumsum([len(b) + 1 for b in bodies]), start, side="right")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, same (binary, of texts with equal words), fps (array<long>)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        powers = Powers()
        for group in grouped(batches, GROUP_BYTES):
            ids, bodies = columns(group, "doc_id", "text")
            bodies = [b or b"" for b in bodies]
            fps = fingerprints(*shingles(*_words(bodies, powers), len(bodies), PAIR)).view(np.int64)
            same = [xxh3_128_digest(b" ".join(b.lower().split())) for b in bodies]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * FAMILIES), pa.array(fps.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(same, pa.binary()), flat], names=["doc_id", "same", "fps"])

    return texts(docs).mapInArrow(lean(work), "doc_id long, same binary, fps array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """a, b (a < b): pairs of ids that meet on a variant. classes: id, fps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((FAMILIES, 64), np.int64), 0
        for batch in batches:
            fps = np.asarray(batch.column("fps").flatten()).view("<u8").reshape(-1, FAMILIES)
            total += np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), FAMILIES, 8), axis=2, bitorder="little").sum(0, dtype=np.int64)
            n += len(fps)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FAMILIES * 64 + 1)), pa.array(np.concatenate([total.reshape(-1), [n]]))], names=["i", "n"])

    sums = {r["i"]: r["n"] for r in classes.select("fps").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    n = sums.get(FAMILIES * 64, 0)
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(n, 1) / BUCKET + 1))))
    chosen = [sorted(range(WIDTH), key=lambda i: (abs(sums.get(64 * k + i, 0) - n / 2), i))[:bits] for k in range(FAMILIES)]
    half = RADIUS // 2
    flips = _flips(list(range(bits)), half)

    def prefix(fp: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(fp), np.uint64)
        for j, i in enumerate(chosen[k]):
            out |= ((fp >> np.uint64(i)) & np.uint64(1)) << np.uint64(j)
        return out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            fps = np.asarray(batch.column("fps").flatten()).view("<u8").reshape(-1, FAMILIES)
            for k in range(FAMILIES):
                own = prefix(fps[:, k], k)
                to = np.concatenate([own ^ m for m, _ in flips])
                order = np.argsort(to, kind="stable")
                to, row = to[order], order % len(ids)
                at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                blobs = [[x.tobytes() for x in np.split(v[row], at[1:])] for v in (fps[:, k], ids)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(to[at].astype(np.int64)), *(pa.array(b, pa.binary()) for b in blobs)], names=["family", "bucket", "fps", "ids"])

    def meet(key: tuple, held: pa.Table) -> pa.Table:
        k, bucket = key[0].as_py(), np.uint64(key[1].as_py())
        fp, ids = (np.frombuffer(b"".join(held.column(c).to_pylist()), t) for c, t in (("fps", np.uint64), ("ids", np.int64)))
        order = np.argsort(ids)
        fp, ids = fp[order], ids[order]
        mask, value = np.uint64(sum(1 << i for i in chosen[k])), np.uint64(sum(((int(bucket) >> j) & 1) << i for j, i in enumerate(chosen[k])))
        used = np.bitwise_count(prefix(fp, k) ^ bucket).astype(np.int64)
        free = [i for i in range(WIDTH) if i not in chosen[k]]
        low, high = np.arange(len(fp)), np.full(len(fp), -1)  # by place, in order of id
        for variant, i in _variants((fp & ~mask) | value, used, free, half) if len(fp) > 1 else ():
            order = np.lexsort([i, variant])
            variant, i = variant[order], i[order]
            edge = np.concatenate([[True], variant[1:] != variant[:-1]])
            least = i[np.flatnonzero(edge)][np.cumsum(edge) - 1]
            on = np.flatnonzero(~edge)
            np.minimum.at(low, i[on], least[on])
            np.maximum.at(high, i[on], i[on - 1])
        b = np.flatnonzero(high >= 0)
        a, b = np.concatenate([low[b], high[b]]), np.concatenate([b, b])
        # a pair is told in one bucket: the first text's, with as many of the differing bits turned as the second can't turn itself
        own = prefix(fp, k)
        apart, told = own[a] ^ own[b], own[a].copy()
        differ = np.bitwise_count(apart)
        for turned in range(half):
            bit = np.where(differ > half + turned, apart & (~apart + np.uint64(1)), np.uint64(0))
            told, apart = told ^ bit, apart ^ bit
        here = told == bucket
        a, b = ids[a[here]], ids[b[here]]
        release()
        return pa.table({"a": a, "b": b})

    sent = classes.select("id", "fps").mapInArrow(lean(spread), "family long, bucket long, fps binary, ids binary")
    return sent.groupBy("family", "bucket").applyInArrow(meet, "a long, b long").distinct()


def sets(docs: DataFrame, size: int) -> DataFrame:
    """id, shingles: the text's different shingles by their hashes (of 64 bits)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for group in grouped(batches, GROUP_BYTES):
            ids, bodies = columns(group, "doc_id", "text")
            h, counts = shingles(*_words([b or b"" for b in bodies], powers), len(ids), size)
            own = [np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts(docs).mapInArrow(lean(work), "id long, shingles array<long>")


def checked(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have at least that much in common. held: id, shingles."""
    # keys of their own, so that adaptive execution can split the pairs of a text with very many partners
    left = held.select(F.col("id").alias("i"), F.col("shingles").alias("x"))
    right = held.select(F.col("id").alias("j"), F.col("shingles").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("i")).drop("i").join(right, F.col("b") == F.col("j")).drop("j")
    common = F.size(F.array_intersect("x", "y"))
    return both.where((common >= least * (F.size("x") + F.size("y") - common))).select("a", "b")


def rest(held: DataFrame, label: DataFrame, least: float) -> DataFrame:
    """a, b (a < b): of the texts in held (id, shingles), all pairs of different components that can have `least` in common. label: node, component; a text that is not there is one of its own.

    Shingles are taken in one order for all texts, rarest first. Two texts with that much in common share one of the first
    n - ceil(least * n) + 1 shingles of either, and have no more in common than what follows the first that they share."""
    one = held.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = one.groupBy("s").agg(F.count("*").alias("times")).where("times > 1").select(F.col("s").alias("shared"), "times")
    own = lambda c: F.shiftleft(F.col(c), 0)  # noqa: E731  keys of their own, so that adaptive execution can split what many texts share
    order = F.array_sort(F.collect_list(F.struct("times", "s"))).alias("order")
    texts_ = one.join(often, own("s") == F.col("shared")).groupBy("id", "n").agg(order).withColumn("alone", F.col("n") - F.size("order"))
    need = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1 - F.col("alone")
    lead = texts_.where(need > 0).select("id", "n", "alone", F.posexplode(F.slice("order", 1, need.cast("int"))))
    lead = lead.join(label, F.col("id") == F.col("node"), "left").select("id", (F.col("n") - F.col("alone") - F.col("pos")).alias("left"), "n", F.col("col.s").alias("s"), F.coalesce("component", "id").alias("of"))
    lead = cut(lead)
    mixed_ = lead.groupBy("s", "of").agg(F.count("*").alias("c")).groupBy("s").agg(F.max_by("of", F.struct("c", "of")).alias("main"), F.count("*").alias("many")).where("many > 1").select(F.col("s").alias("key"), "main")
    lead = lead.join(mixed_, own("s") == F.col("key")).drop("key")
    x = lead.where("of <> main").select(*(F.col(c).alias(f"x_{c}") for c in ("id", "left", "n", "s", "of")))
    can = F.least("left", "x_left") * (1 + least) >= least * (F.col("n") + F.col("x_n")) - 1e-9
    once = (F.col("of") == F.col("main")) | (F.col("x_id") < F.col("id"))
    met = x.join(lead, (own("x_s") == own("s")) & (F.col("x_of") != F.col("of")) & once & can)
    return met.select(F.least("id", "x_id").alias("a"), F.greatest("id", "x_id").alias("b")).distinct()


def near_copies(docs: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id, component_id: a row per document, whose doc_id must be its own; component_id is the least doc_id that links reach.

    Texts without words are equal, and so linked; texts of fewer words than a shingle have one, of all of them; equal texts are compared
    once; very long texts are read whole; an empty table gives no rows; other columns are ignored."""
    held = cut(sketches(docs))
    classes = cut(held.groupBy("same").agg(F.min("doc_id").alias("id"), F.first("fps").alias("fps")))
    pairs = cut(candidates(classes))
    meant = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    shingled = cut(sets(docs.select("doc_id", "text").join(meant, "doc_id", "left_semi"), size))
    links = cut(checked(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), shingled, least))
    label = cut(components(links))
    label = cut(components(links.unionByName(checked(rest(shingled, label, least), shingled, least))))
    named = classes.join(label, F.col("id") == F.col("node"), "left").select(F.col("same").alias("like"), F.coalesce("component", "id").alias("component_id"))
    return held.join(named, F.col("same") == F.col("like")).select("doc_id", "component_id")
