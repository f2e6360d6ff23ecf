"""Quality rules: counts over words and lines, and an n-gram perplexity within a band of its language.

The model is a byte trigram with modified Kneser-Ney smoothing. Spark counts the trigrams of all texts (two line feeds before
each); there are at most 2^24, so what reaches the driver and goes out by broadcast has a proven bound. It is stored as arrays
sorted by the trigram's 24-bit code, a hash without collisions, beside dense tables for the lower orders; a text's trigrams are sorted
too, and each different one is looked up once. A document whose log
perplexity lies outside its language's band is rejected. The band is the median -+ (the greater of LEAST and WIDTH times the
quartile distance, plus SHORT / n_words ** 0.75, since a short text's mean strays further); median and quartiles come from all
documents that the other rules keep.

Junk made of likely letters passes that, so words are judged too: a text's rarity is the mean, over its words with a letter, of the
negative logarithm of the number of other documents that have the word (documents that the base rules keep). Spark deals the words
of chunks of documents by their hash into parts; each part counts documents on a sorted array of hashes and gives sums per
document, which are put together by chunk. A document is rejected whose rarity is more than RARE, times the root of
USUAL / n_words for a shorter one, above its language's median; both were set by the labels of the given tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.runtime import columns, cut, grouped, lean, release, tasks, texts
from tidemill.llm.spans import SPACE, P, Powers, hashes, mixed, word_spans

GROUP_BYTES, SLICE = 3_000_000, 1_000_000
REPEAT_WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
WIDTH, LEAST, SHORT = 2.0, 0.06, 5.0
RARE, USUAL = 0.9, 150.0
ALONE = 0.3  # stands for the number of other documents where there is none
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
PREFIX = b"\n\n"
SCORES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_ppl double, rarity double"
SENT = "part long, chunk long, words binary, uses binary"


def rules(bodies: list[bytes], powers: Powers) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(bodies)
    buf = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
    ends = np.cumsum([len(b) + 1 for b in bodies])
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)[ends - 1]]))
    chars, symbols = per_doc(~SPACE[buf] & ((buf & 0xC0) != 0x80)), per_doc(SYMBOL[buf])
    start, end = word_spans(buf)
    doc = np.searchsorted(ends, start, side="right")
    words = np.bincount(doc, minlength=n)
    word = hashes(buf, start, end, powers)
    m = len(word) - REPEAT_WINDOW + 1
    repeat = np.zeros(n, np.int64)
    if m > 0:
        window = mixed(doc[:m].astype(np.uint64) * P)
        for k in range(REPEAT_WINDOW):
            window = window * P + word[k : m + k]
        valid = np.flatnonzero(doc[:m] == doc[REPEAT_WINDOW - 1 :])
        window = window[valid]
        order = np.argsort(window)
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(word) + 1, np.int64)
        at = valid[twice]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + REPEAT_WINDOW, -1)
        repeat = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    dup = np.zeros(n, np.int64)
    for i, b in enumerate(bodies):
        lines = b.split(b"\n")
        if len(set(lines)) < len(lines):
            own = [x for x in lines if x.strip()]
            dup[i] = len(own) - len(set(own))
    return words, chars, symbols, dup, repeat


def trigrams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 24-bit codes of the texts' trigrams, and how many there are of each text."""
    buf = np.frombuffer(b"".join(x for b in bodies for x in (PREFIX, b)), np.uint8).astype(np.uint32)
    sizes = np.array([len(b) for b in bodies])
    starts = np.cumsum(sizes + 2) - sizes
    code = (buf[:-2] << np.uint32(16)) | (buf[1:-1] << np.uint32(8)) | buf[2:]
    keep = np.ones(len(buf), bool)
    keep[starts - 1] = keep[starts - 2] = False
    return code[keep[2:]], sizes


def count_trigrams(docs: DataFrame) -> DataFrame:
    """code, n: a row per trigram of all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for group in grouped(batches, GROUP_BYTES):
            (bodies,) = columns(group, "text")
            for some in slices([b or b"" for b in bodies]):
                c, k = np.unique(trigrams(some)[0], return_counts=True)
                code, where = np.unique(np.concatenate([code, c]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n, k]), minlength=len(code)).astype(np.int64)
        if len(code):
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

    return texts(docs).mapInArrow(lean(work), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Of counts 0, 1, 2 and 3 or more, from the counts of counts; 0.5 a step where those are missing."""
    k = [int((n == i).sum()) for i in range(1, 5)]
    y = k[0] / max(1, k[0] + 2 * k[1])
    return np.array([0.0, *(min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.05 * i), 0.95 * i) if k[i - 1] and k[i] else 0.5 * i for i in (1, 2, 3))])


class KneserNey:
    """Modified Kneser-Ney over byte trigrams. codes: sorted; log_p: of each code; gamma: of each pair of bytes; bigram: probabilities."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        order = np.argsort(codes)
        self.codes, n = codes[order].astype(np.uint32), n[order]
        context, v, w = self.codes >> 8, (self.codes >> 8) & 255, self.codes & 255
        types = np.bincount(w, minlength=256)  # kinds of pairs before it, once each
        pair = np.zeros((256, 256), np.int64)
        np.add.at(pair, (v, w), 1)
        unigram = np.bincount(np.nonzero(pair)[1], minlength=256)
        d = _discounts(unigram[unigram > 0])
        left = np.minimum(unigram, 3)
        total = max(1, unigram.sum())
        p1 = (unigram - d[left]) / total + (d[left].sum() / total if types.any() else 1.0) / 256
        d = _discounts(pair[pair > 0])
        taken, row = d[np.minimum(pair, 3)], pair.sum(1)
        safe = np.maximum(row, 1)[:, None]
        self.bigram = np.where(row[:, None] > 0, (pair - taken) / safe + taken.sum(1, keepdims=True) / safe * p1, p1).astype(np.float64)
        d = _discounts(n)
        taken = d[np.minimum(n, 3)]
        mass, lost = np.bincount(context, n, minlength=65536), np.bincount(context, taken, minlength=65536)
        self.gamma = np.where(mass > 0, lost / np.maximum(mass, 1), 1.0)
        self.log_p = np.log((n - taken) / mass[context] + self.gamma[context] * self.bigram[v, w]).astype(np.float32)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """The natural log probability of trigrams by their codes: that of the array, or what backing off leaves."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        out = np.log(np.maximum(self.gamma[codes >> 8], 1e-12)) + np.log(self.bigram[(codes >> 8) & 255, codes & 255])
        out[known] = self.log_p[at[known]]
        return out

    def surprise(self, bodies: list[bytes]) -> np.ndarray:
        """The mean negative log probability of each text's bytes; 0 for an empty text."""
        code, sizes = trigrams(bodies)
        if not len(code):
            return np.zeros(len(bodies))
        pair = np.sort((code.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(bodies), dtype=np.uint64), sizes))
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        times = np.diff(np.concatenate([first, [len(pair)]]))
        code, text = pair[first] >> np.uint64(32), (pair[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        turn = np.concatenate([[True], code[1:] != code[:-1]])
        log_p = self.log_prob(code[turn].astype(np.int64))[np.cumsum(turn) - 1]
        return -np.bincount(text, times * log_p, minlength=len(bodies)) / np.maximum(sizes, 1)


def slices(bodies: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in runs of about SLICE bytes, since work on one takes many times its bytes."""
    held, size = [], 0
    for b in bodies:
        if held and size + len(b) > SLICE:
            yield held
            held, size = [], 0
        held.append(b)
        size += len(b)
    if held:
        yield held


def fit(docs: DataFrame) -> KneserNey:
    counts = count_trigrams(docs).toPandas()
    return KneserNey(counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))


def _failed(n_words, n_repeat_words):
    """What the base rules reject; of columns or of arrays."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def word_tables(bodies: list[bytes], parts: int, powers: Powers) -> Iterator[tuple[int, np.ndarray, tuple]]:
    """Per part: its number, the hashes of the texts' words with a letter, and (texts of each word, text, times)."""
    found, docs, before = [], [], 0
    for some in slices(bodies):
        buf = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
        start, end = word_spans(buf)
        letters = np.concatenate([[0], np.cumsum(LETTER[buf])])
        on = letters[end] > letters[start]
        found.append(hashes(buf, start[on], end[on], powers))
        docs.append(before + np.searchsorted(np.cumsum([len(b) + 1 for b in some]), start[on], side="right"))
        before += len(some)
    h, which = np.unique(np.concatenate(found), return_inverse=True)
    doc = np.concatenate(docs)
    del found, docs
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(h), np.int64)
    rank[order] = np.arange(len(h))
    pair, times = np.unique(rank[which] * len(bodies) + doc, return_counts=True)
    word, text = pair // max(1, len(bodies)), pair % max(1, len(bodies))
    uses = np.bincount(word, minlength=len(h))
    first = np.concatenate([[0], np.cumsum(uses)])
    h, cuts = h[order], np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        lo, hi = int(cuts[k]), int(cuts[k + 1])
        yield k, h[lo:hi], (uses[lo:hi], text[first[lo] : first[hi]], times[first[lo] : first[hi]])


def _pack(*arrays: np.ndarray) -> bytes:
    raw = np.array([len(x) for x in arrays], "<u4").tobytes() + b"".join(x.astype("<u4").tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), "<u4").astype(np.int64)
    return np.split(raw[n:], np.cumsum(raw[:n])[:-1])


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """SCORES: the rules' counts, the mean negative log probability of a byte (null for an empty text), and the rarity (null for a
    text that the base rules reject, or without a letter)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    parts = max(8, tasks(docs))
    names = [x.split()[0] for x in SCORES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        powers, model, chunk = Powers(), held.value, TaskContext.get().partitionId() << 32
        for group in grouped(batches, GROUP_BYTES):
            ids, bodies, langs = columns(group, "doc_id", "text", "lang")
            bodies = [b or b"" for b in bodies]
            log_ppl = np.concatenate([model.surprise(x) for x in slices(bodies)])
            own = [np.concatenate(x) for x in zip(*(rules(x, powers) for x in slices(bodies)), strict=True)]
            failed = _failed(own[0], own[-1])
            found = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *(pa.array(x.astype(np.int64)) for x in own), pa.array(log_ppl, mask=np.array([not b for b in bodies]))], names=names[:-1])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, found.schema) as stream:
                stream.write_batch(found)
            rows = [(-1 - chunk, sink.getvalue().to_pybytes(), None)]
            rows += [(k, h.tobytes(), _pack(*u)) for k, h, u in word_tables([b"" if f else b for b, f in zip(bodies, failed, strict=True)], parts, powers)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([chunk] * len(rows)), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["part", "chunk", "words", "uses"])
            chunk += 1
            release()

    def add(key: tuple, sent: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # the rules' counts of a chunk, which go by here so that the texts are read once
            return sent
        words = [np.frombuffer(x, np.uint64) for x in sent.column("words").to_pylist()]
        known = np.unique(np.concatenate(words))
        n = np.zeros(len(known), np.int64)
        places = [np.searchsorted(known, w) for w in words]
        for at, blob in zip(places, sent.column("uses").to_pylist(), strict=True):
            n[at] += _unpack(blob, 3)[0]
        rare = -np.log(np.maximum(n - 1, ALONE))
        sums = []
        for at, blob in zip(places, sent.column("uses").to_pylist(), strict=True):
            uses, text, times = _unpack(blob, 3)
            sums.append(np.concatenate([np.bincount(text, times * np.repeat(rare[at], uses)), np.bincount(text, times)]).tobytes())
        out = pa.table({"part": sent.column("part"), "chunk": sent.column("chunk"), "words": pa.array(sums, pa.binary()), "uses": pa.nulls(len(sums), pa.binary())})
        del words, known, places
        release()
        return out

    def finish(key: tuple, told: pa.Table) -> pa.Table:
        rows = sorted(zip(told.column("part").to_pylist(), told.column("words").to_pylist(), strict=True))
        found = pa.ipc.open_stream(rows[0][1]).read_all()
        total = np.zeros((2, found.num_rows))
        for _, blob in rows[1:]:
            k = len(blob) // 16
            total[:, :k] += np.frombuffer(blob, np.float64).reshape(2, k)
        return found.append_column("rarity", pa.array(total[0] / np.maximum(total[1], 1), mask=total[1] == 0))

    docs = texts(docs, F.col("lang").cast("string").alias("lang"))
    sent = docs.mapInArrow(lean(work), SENT).groupBy("part").applyInArrow(add, SENT)
    return sent.groupBy("chunk").applyInArrow(finish, SCORES)


def judge(scores: DataFrame) -> DataFrame:
    """Add base_failed, the language's bands and kept. scores: kept somewhere, as it is read twice."""
    scores = scores.withColumn("base_failed", _failed(F.col("n_words"), F.col("n_repeat_words")))
    quartiles = scores.where("not base_failed").groupBy("lang").agg(F.percentile_approx("log_ppl", F.array(*map(F.lit, (0.25, 0.5, 0.75))), 10000).alias("q"), F.percentile_approx("rarity", 0.5, 10000).alias("usual"))
    room = F.greatest(F.lit(LEAST), WIDTH * (F.col("q")[2] - F.col("q")[0])) + SHORT / F.greatest(F.col("n_words"), F.lit(1)) ** 0.75
    bands = quartiles.withColumnRenamed("lang", "band_lang")
    joined = scores.join(bands, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    fits = F.coalesce(F.col("log_ppl").between(F.col("q")[1] - room, F.col("q")[1] + room), F.lit(False))
    most = F.col("usual") + RARE * F.greatest(F.lit(1.0), F.sqrt(F.lit(USUAL) / F.greatest(F.col("n_words"), F.lit(1))))
    usual = F.coalesce(F.col("rarity") <= most, F.lit(False))
    return joined.withColumn("ppl_low", F.exp(F.col("q")[1] - room)).withColumn("ppl_high", F.exp(F.col("q")[1] + room)).withColumn("rarity_high", most).withColumn("kept", ~F.col("base_failed") & fits & usual).drop("q", "usual")


def quality(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, lang, the five counts, log_ppl, rarity, base_failed, ppl_low, ppl_high, rarity_high, kept.

    Null and empty texts have no words and fail the base rules; a null lang is a language of its own; repeated rows are judged
    alike, each with a row; very long texts are scored whole; an empty table gives no rows; other columns are ignored."""
    return judge(cut(score(docs, fit(docs))))
