"""Language-model scores of whole documents: context-tree weighting over running bytes, beside a word-count base.

A text is a sequence of tokens: its words, lower-cased in ASCII, then one end. Its bytes are the words with one space between two and
a line feed at the end, and each byte is predicted from the DEPTH bytes before it, whatever words they are of (line feeds before
the first). The tree of contexts (ctw.py) mixes the Krichevsky-Trofimov estimates of all depths, 0 to DEPTH, by their evidence.

Tasks put texts into units of about UNIT bytes. A unit sends its different coded bytes (context and byte) and its different words once
each, with their counts in training texts: coded bytes to the part of the tree that the TOP nearest bytes name, words to a bucket
by their hash. What a part gets is dealt out further by unit where it is more than MOST bytes, so a frequent context makes no group
large. A part's counts make its nodes of TOP bytes and more; the driver has the nodes above, of less than TOP bytes, at most
256 * 255 + 255 at any size of input, and sends them out. Then each unit gets back what its coded bytes and words are worth, and
adds that up by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.ctw import Decisions, Tree, coded, levels, summed
from tidemill.llm.runtime import columns, cut, grouped, lean, release, tasks, texts
from tidemill.llm.spans import Powers, hashes, word_spans

DEPTH, TOP = 5, 2
UNIT, BLOCK, MOST = 32_000_000, 2_000_000, 16_000_000
CODES, WORDS, TEXTS = 0, 1, 2
END = b"\n"
SENT = "kind int, bucket long, unit long, keys binary, counts binary, ids binary, sizes binary"
COUNTED = "kind int, bucket long, keys binary, counts binary, n long, v long"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, train_tokens long, base_score double, score double"


def _press(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _pressed(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], n, asbytes=True) if n else b""


def _pack(x: np.ndarray) -> bytes:
    """Of whole numbers of 64 bits, as steps from one to the next, byte by byte, so that the high bytes vanish in compression."""
    steps = np.diff(x.astype(np.uint64), prepend=np.uint64(0))
    return _press(np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(_pressed(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u8").reshape(-1), dtype=np.uint64)


def stream(body: bytes) -> bytes:
    """The text's bytes as the model has them."""
    return b" ".join(body.lower().split()) + END


def blocks(streams: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of about BLOCK bytes; the sizes of the pieces there, each led by the `depth` bytes before it; the text each is of.
    A text longer than a block is cut after a space."""
    held, sizes, whose, size = [], [], [], 0
    for i, s in enumerate(streams):
        at = 0
        while at < len(s):
            stop = len(s) if len(s) - at <= BLOCK else (s.find(b" ", at + BLOCK - 1) + 1 or len(s))
            if size and (size + stop - at > BLOCK or len(sizes) == 65535):
                yield np.frombuffer(b"".join(held), np.uint8), np.array(sizes), np.array(whose)
                held, sizes, whose, size = [], [], [], 0
            held += [(END * depth + s[max(0, at - depth) : at])[-depth:] if depth else b"", s[at:stop]]
            sizes.append(depth + stop - at)
            whose.append(i)
            size += stop - at
            at = stop
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(sizes), np.array(whose)


def code_pairs(buf: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different coded bytes of a block, in order; and the pairs of one and a piece: where each coded byte's pairs begin, piece, times."""
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes - depth)
    key = coded(buf, ends - sizes, sizes, depth)
    if depth <= 5:  # code and piece fit 64 bits
        key = np.sort((key << np.uint64(16)) | piece)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pair = key[first]
        code, piece = pair >> np.uint64(16), (pair & np.uint64(65535)).astype(np.int64)
    else:
        order = np.lexsort([piece, key])
        key, piece = key[order], piece[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]))
        code, piece = key[first], piece[first].astype(np.int64)
    times = np.diff(np.concatenate([first, [len(key)]]))
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[begin], begin, piece, times


def word_hashes(buf: np.ndarray, sizes: np.ndarray, depth: int, whole: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash and piece of every token in a block; whole: whether a piece has its text's end."""
    ends = np.cumsum(sizes)
    start, end = word_spans(buf)
    piece = np.searchsorted(ends, start, side="right")
    own = start >= (ends - sizes)[piece] + depth  # not of the bytes before a piece
    last = np.flatnonzero(whole)
    start, end, piece = np.concatenate([start[own], ends[last] - 1]), np.concatenate([end[own], ends[last]]), np.concatenate([piece[own], last])
    return hashes(buf, start, end, powers), piece


def _ending(buf: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return buf[np.cumsum(sizes) - 1] == END[0]


def _split(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Keys and counts of each bucket, in order of keys."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[a]), keys[a:b], counts[a:b]


def deal(docs: DataFrame, held_out: Column, depth: int, buckets: int) -> DataFrame:
    """SENT: of each unit its coded bytes by part, its words by bucket, and its texts (bucket -1)."""
    parts, shift = _parts(buckets, depth)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        powers, unit = Powers(), TaskContext.get().partitionId() << 32
        row = lambda kind, bucket, keys, counts, ids=None, sizes=None: pa.RecordBatch.from_arrays(
            [pa.array([kind], pa.int32()), pa.array([bucket], pa.int64()), pa.array([unit], pa.int64()), *(pa.array([x], pa.binary()) for x in (keys, counts, ids, sizes))], names=[x.split()[0] for x in SENT.split(", ")])
        for group in grouped(batches, UNIT):
            ids, bodies, held = columns(group, "doc_id", "text", "held")
            trained = (~np.array(held, bool)).astype(np.int64)
            length = np.array([len(b or b"") for b in bodies], np.int64)
            streams = [stream(b or b"") for b in bodies]
            del bodies, group
            code, n, word, m = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for buf, sizes, whose in blocks(streams, depth):
                c, begin, piece, times = code_pairs(buf, sizes, depth)
                k = np.add.reduceat(times * trained[whose[piece]], begin)
                code, n = summed(np.concatenate([code, c]), np.concatenate([n, k]))
                h, piece = word_hashes(buf, sizes, depth, _ending(buf, sizes), powers)
                h, which = np.unique(h, return_inverse=True)
                k = np.bincount(which, trained[whose[piece]], minlength=len(h)).astype(np.int64)
                word, m = summed(np.concatenate([word, h]), np.concatenate([m, k]))
            for b, keys, counts in _split(code, n, ((code >> np.uint64(shift)) % np.uint64(parts)).astype(np.int64)):
                yield row(CODES, b, _pack(keys), _press(counts.astype("<u4").tobytes()))
            for b, keys, counts in _split(word, m, (word % np.uint64(buckets)).astype(np.int64)):
                yield row(WORDS, b, _pack(keys), _press(counts.astype("<u4").tobytes()))
            flags = 2 * np.array([i is None for i in ids]) + 1 - trained
            sizes = np.array([len(s) for s in streams], np.int64)
            yield row(TEXTS, -1, _press(b"".join(streams)), flags.astype(np.uint8).tobytes(), np.array([i or 0 for i in ids], np.int64).tobytes(), sizes.tobytes() + length.tobytes())
            del streams, code, n, word, m, c, begin, piece, times, h, which, k, buf
            release()
            unit += 1

    return texts(docs, held_out.alias("held")).mapInArrow(lean(work), SENT)


def _parts(buckets: int, depth: int) -> tuple[int, int]:
    """How many parts of the tree, and the bits of a code right of the bytes that name its part."""
    return buckets | 1, 8 * (depth + 1 - min(TOP, depth))


def _counts(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(_pressed(x), "<u4").astype(np.int64) for x in blobs]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    while len(keys) > 1:  # pairwise: sorted runs merge in linear time
        two = [summed(np.concatenate(keys[i : i + 2]), np.concatenate(counts[i : i + 2])) for i in range(0, len(keys), 2)]
        keys, counts = [a for a, _ in two], [b for _, b in two]
    return keys[0], counts[0]


def gather(sent: DataFrame, salts: DataFrame) -> DataFrame:
    """COUNTED: a row per part and bucket, of all its keys, their counts in training texts (of 64 bits), their sum, and how many are not 0."""

    def merge(key: tuple, held: pa.Table) -> pa.Table:
        kind, bucket = key[0].as_py(), key[1].as_py()
        first = "n" not in held.column_names
        counts = held.column("counts").to_pylist()
        keys, n = _merged([_unpack(x) for x in held.column("keys").to_pylist()], _counts(counts) if first else [np.frombuffer(x, np.int64) for x in counts])
        out = {"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int64()), "keys": pa.array([_pack(keys)], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "n": pa.array([int(n.sum())], pa.int64()), "v": pa.array([int((n > 0).sum())], pa.int64())}
        del keys, n, counts
        release()
        return pa.table(out)

    some = salted(sent, salts).select("kind", "bucket", "salt", "keys", "counts").groupBy("kind", "bucket", "salt").applyInArrow(merge, COUNTED)
    return some.groupBy("kind", "bucket").applyInArrow(merge, COUNTED)


def salted(sent: DataFrame, salts: DataFrame) -> DataFrame:
    """Rows of parts and buckets with their salt; salts: k, b, salts, a row for each, which are bounded in number."""
    rows = sent.where(F.col("kind") != TEXTS).join(F.broadcast(salts), (F.col("kind") == F.col("k")) & (F.col("bucket") == F.col("b")))
    return rows.withColumn("salt", F.pmod(F.xxhash64("unit"), F.col("salts")))


def _part(keys: bytes, counts: bytes, by: Decisions, depth: int) -> tuple[list, list, list, tuple, tuple]:
    codes, n = _unpack(keys), np.frombuffer(counts, np.int64)
    return levels(codes[n > 0], n[n > 0], by, depth, min(TOP, depth))


def fit(counted: DataFrame, depth: int) -> tuple[Decisions, tuple[list, list, list]]:
    """The code of the bytes, and the tree's nodes above its parts."""

    def by_byte(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*columns([batch], "keys", "counts"), strict=True):
                n = np.bincount((_unpack(keys) & np.uint64(255)).astype(np.int64), np.frombuffer(counts, np.int64), minlength=256)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n.astype(np.int64))], names=["byte", "n"])

    codes = counted.where(F.col("kind") == CODES).select("keys", "counts")
    total = np.zeros(256, np.int64)
    for byte, n in codes.mapInArrow(lean(by_byte), "byte long, n long").groupBy("byte").agg(F.sum("n")).collect():
        total[byte] = n
    by = Decisions(total)

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*columns([batch], "keys", "counts"), strict=True):
                *_, (above, pw), (code, n) = _part(keys, counts, by, depth)
                above, pw = summed(above, pw)
                yield pa.RecordBatch.from_arrays([
                    pa.array([False] * len(above) + [True] * len(code)), pa.array(np.concatenate([above, code]).astype(np.int64)),
                    pa.array(np.concatenate([np.zeros(len(above), np.int64), n])), pa.array(np.concatenate([pw, np.zeros(len(code))]))], names=["coded", "key", "n", "pw"])

    # in decimals, whose sum is the same in any order
    sums = F.sum("n").alias("n"), F.sum(F.col("pw").cast("decimal(38,12)")).cast("double").alias("pw")
    rows = codes.mapInArrow(lean(climb), "coded boolean, key long, n long, pw double").groupBy("coded", "key").agg(*sums).toPandas().sort_values("key")
    deep = rows["coded"].to_numpy(bool)
    key, n, pw = rows["key"].to_numpy(np.int64).astype(np.uint64), rows["n"].to_numpy(np.int64), rows["pw"].to_numpy(np.float64)
    return by, levels(key[deep], n[deep], by, min(TOP, depth) - 1, 0, (key[~deep], pw[~deep]))[:3]


def answers(sent: DataFrame, counted: DataFrame, salts: DataFrame, depth: int) -> DataFrame:
    """unit, kind, keys, found: a row for each of sent's, with the log10 probabilities of coded bytes (of 32 bits), or the counts of words (of 64)."""
    top = sent.sparkSession.sparkContext.broadcast(fit(counted, depth))

    def answer(key: tuple, held: pa.Table, known: pa.Table) -> pa.Table:
        kind, keys = key[0].as_py(), held.column("keys").to_pylist()
        asked = [_unpack(x) for x in keys]
        row = known.to_pylist()[0]
        if kind == WORDS:
            every, value = _unpack(row["keys"]), np.frombuffer(row["counts"], np.int64)
        else:
            by, above = top.value
            every = asked[0] if len(asked) == 1 else np.unique(np.concatenate(asked))
            value = Tree.of(by, above, _part(row["keys"], row["counts"], by, depth)[:3]).slow(every)
        found = [_press(value[np.searchsorted(every, x)].tobytes()) for x in asked]
        del every, value, asked, row
        release()
        return pa.table({"unit": held.column("unit"), "kind": held.column("kind"), "keys": held.column("keys"), "found": pa.array(found, pa.binary())})

    wanted = salted(sent, salts).select("kind", "bucket", "salt", "unit", "keys")
    each = counted.join(F.broadcast(salts), (F.col("kind") == F.col("k")) & (F.col("bucket") == F.col("b")))
    each = each.select("kind", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "keys", "counts")
    by = ("kind", "bucket", "salt")
    return wanted.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(answer, "unit long, kind int, keys binary, found binary")


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """SCHEMA: a row per document; documents for which held_out is true (not null) teach nothing.

    Null and empty texts have the end alone; repeated rows teach and are scored each; very long texts are taken whole; with nothing to
    learn from, every estimate is that of no counts; an empty table gives no rows; other columns are ignored. depth: 7 at most; it is
    the same at every size of input."""
    buckets = max(8, tasks(docs))
    sent = cut(deal(docs, F.coalesce(held_out, F.lit(False)), depth, buckets))
    size = F.sum(F.length("keys") + F.length("counts"))
    salts = cut(sent.where(F.col("kind") != TEXTS).groupBy(F.col("kind").alias("k"), F.col("bucket").alias("b")).agg(F.greatest(F.ceil(size / MOST), F.lit(1)).cast("long").alias("salts")))
    counted = cut(gather(sent, salts))
    n, v = (x or 0 for x in counted.where(F.col("kind") == WORDS).agg(F.sum("n"), F.sum("v")).first())
    whole = n + 0.5 * (v + 1)
    told = answers(sent, counted, salts, depth)

    def finish(key: tuple, unit: pa.Table, told: pa.Table) -> pa.Table:
        row, powers = unit.to_pylist()[0], Powers()
        sizes, length = np.frombuffer(row["sizes"], np.int64).reshape(2, -1)
        flags, raw = np.frombuffer(row["counts"], np.uint8), _pressed(row["keys"])
        ends = np.cumsum(sizes)
        streams = [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        del raw

        def table(kind: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
            on = [(k, x) for w, k, x in zip(*(told.column(c).to_pylist() for c in ("kind", "keys", "found")), strict=True) if w == kind]
            keys, found = np.concatenate([_unpack(k) for k, _ in on]), np.concatenate([np.frombuffer(_pressed(x), dtype) for _, x in on])
            order = np.argsort(keys, kind="stable")
            return keys[order], found[order]

        (code, log_p), (word, count) = table(CODES, np.float32), table(WORDS, np.int64)
        log_c, known = np.log10(count + 0.5), count > 0
        sums = np.zeros((4, len(streams)))
        for buf, size, whose in blocks(streams, depth):
            c, begin, piece, times = code_pairs(buf, size, depth)
            value = np.repeat(log_p[np.searchsorted(code, c)].astype(np.float64), np.diff(np.concatenate([begin, [len(piece)]])))
            np.add.at(sums[0], whose, np.bincount(piece, times * value, minlength=len(whose)))
            h, piece = word_hashes(buf, size, depth, _ending(buf, size), powers)
            at = np.searchsorted(word, h)
            for k, x in enumerate((log_c[at], known[at], None)):
                np.add.at(sums[k + 1], whose, np.bincount(piece, x, minlength=len(whose)))
        tokens = sums[3].astype(np.int64)
        out = pa.table({
            "doc_id": pa.array(np.frombuffer(row["ids"], np.int64), mask=(flags & 2) > 0), "held_out": pa.array((flags & 1) > 0), "n_tokens": tokens, "n_known": sums[2].astype(np.int64), "n_bytes": length,
            "train_tokens": np.full(len(tokens), n, np.int64), "base_score": sums[1] - tokens * np.log10(whole), "score": sums[0]})
        del streams, code, log_p, word, count, log_c, known
        release()
        return out

    return sent.where(F.col("kind") == TEXTS).groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(finish, SCHEMA)
