"""Order-preserving packing of documents into token sequences by dynamic programming.

The documents of a task form one stream of tokens, in order. A sequence is a window of that stream; where it may be cut is
the end of a document (free), the end of a sentence (SENTENCE tokens of penalty) or, inside sentences longer than HARD
tokens, every HARD tokens (BROKEN of penalty). A window of n <= window tokens costs window - n of padding, or nothing if n is
a power of two. The best cuts are

    best[j] = penalty[j] + min( window - c[j] + min over c[j] - c[i] <= window of best[i] + c[i],
                                min over c[j] - c[i] a power of two of best[i] )

where c are the candidate positions: the first minimum slides, so a monotone queue gives it in constant time; the second
has at most 12 predecessors. A task works through its stream in blocks of about BLOCK tokens, so memory is bounded; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.runtime import columns, grouped, lean, texts
from tidemill.llm.spans import Powers, hashes, word_spans

WINDOW, END_ID = 2048, 1
SENTENCE, BROKEN, HARD = 2, 48, 512
BLOCK_BYTES = 1_000_000
REMEMBERED = 1_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TAIL, STOP, LETTER = (np.isin(np.arange(256), list(x)) for x in (b".,!?", b".!?", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


class UnitIds:
    """Token ids of units: words, where a last run of TAIL after an ASCII letter is a unit of its own.

    The tokenizer splits at white space and between a letter and such marks, and lowers case itself, so a text's ids are
    those of its lower-cased units in order. Units of letters only are single pieces whose last token, and no other, is a
    word end: these are encoded many at a time and told apart by that."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known = np.zeros(0, np.uint64)  # hashes of known units, sorted; their ids are flat[at : at + n]
        self.at, self.n, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.powers = Powers()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashed: np.ndarray, units: list[bytes]) -> None:
        """Take up new units; hashed: theirs, sorted."""
        texts = [u.decode("utf-8", "replace") for u in units]
        letters = np.array([u.isalpha() for u in texts], bool)
        words, rest = np.flatnonzero(letters), np.flatnonzero(~letters)
        n, flat = np.zeros(len(units), np.int64), []
        if len(words):
            ids = self.encode([" ".join([texts[i] for i in words.tolist()])])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words):
                n[words] = np.diff(ends, prepend=0)
                flat.append(ids)
            else:  # letters that the tokenizer sees otherwise
                words, rest = words[:0], np.arange(len(units))
        alone = self.encode([texts[i] for i in rest.tolist()])
        n[rest] = [len(x) for x in alone]
        order = np.concatenate([words, rest])
        at = np.empty(len(units), np.int64)
        at[order] = np.cumsum(n[order]) - n[order] + len(self.flat)
        self.flat = np.concatenate([self.flat, *flat, *alone])
        where = np.searchsorted(self.known, hashed)
        self.known, self.at, self.n = np.insert(self.known, where, hashed), np.insert(self.at, where, at), np.insert(self.n, where, n)

    def ids(self, bodies: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts in order, end_id after each; where texts end and where sentences end, as counts of ids."""
        raw = b"\n".join(bodies) + b"\n"
        buf = np.frombuffer(raw if b"<|" in raw else raw.lower(), np.uint8)
        doc_ends = np.cumsum([len(b) + 1 for b in bodies])
        start, end = word_spans(buf)
        solid = np.maximum.accumulate(np.where(TAIL[buf], -1, np.arange(len(buf)))) + 1
        stem = np.maximum(solid[end - 1], start) if len(end) else end
        split = (stem > start) & (stem < end) & LETTER[buf[stem - 1]]
        first = np.arange(len(start)) + np.concatenate([[0], np.cumsum(split)])[:-1]  # a word's first unit
        begin, stop = np.empty(len(start) + int(split.sum()), np.int64), np.empty(len(start) + int(split.sum()), np.int64)
        last = first + split
        begin[first], stop[last] = start, end
        begin[last[split]], stop[first[split]] = stem[split], stem[split]
        h, one, which = np.unique(hashes(buf, begin, stop, self.powers), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.at, self.n, self.flat = self.known[:0], self.at[:0], self.n[:0], self.flat[:0]
        at = np.searchsorted(self.known, h)
        new = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] != h) if len(self.known) else np.arange(len(h))
        view, spans = buf.tobytes(), one[new]
        self.learn(h[new], [view[a:b] for a, b in zip(begin[spans].tolist(), stop[spans].tolist(), strict=True)])
        found = np.searchsorted(self.known, h)
        sizes, at = np.append(self.n[found], 1), np.append(self.at[found], len(self.flat))
        flat = np.append(self.flat, np.uint32(end_id))
        in_doc = np.searchsorted(begin, doc_ends)  # units before each text's end
        which = np.insert(which, in_doc, len(h))
        ends = np.cumsum(sizes[which])
        lengths = sizes[which]
        ids = flat[np.repeat(at[which] - (ends - lengths), lengths) + np.arange(ends[-1])]
        lines = np.concatenate([[0], np.cumsum(buf == 10)])
        closing = STOP[buf[end - 1]]
        closing[:-1] |= lines[start[1:]] > lines[end[:-1]]
        doc_of_word = np.searchsorted(doc_ends, start, side="right")
        return ids, ends[in_doc + np.arange(len(bodies))], ends[(last + doc_of_word)[closing]]


_KNOWN: dict[str, UnitIds] = {}


def unit_ids(path: str) -> UnitIds:
    """Kept for the tasks that this Python worker runs after this one."""
    if path not in _KNOWN:
        _KNOWN[path] = UnitIds(path)
    return _KNOWN[path]


def best_cuts(c: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indices into c of the chosen cuts, first 0 and last len(c) - 1. c: increasing positions from 0, no gap over window."""
    n = len(c)
    where = np.full(int(c[-1]) + 1, -1, np.int32)
    where[c] = np.arange(n, dtype=np.int32)
    later, earlier = [], []
    k = 1
    while k <= window:
        j = np.flatnonzero(c >= k)
        i = where[c[j] - k]
        later.append(j[i >= 0])
        earlier.append(i[i >= 0])
        k *= 2
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    first = np.searchsorted(later[order], np.arange(n + 1)).tolist()
    exact = earlier[order].tolist()
    pos, pen = c.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    queue = deque([(0, 0, 0)])  # best + position, position, index; values rise from the front
    for j in range(1, n):
        at = pos[j]
        while queue[0][1] < at - window:
            queue.popleft()
        front = queue[0]
        cost, source = front[0] + window - at, front[2]
        for i in exact[first[j] : first[j + 1]]:
            if best[i] < cost:
                cost, source = best[i], i
        cost += pen[j]
        best[j], back[j] = cost, source
        value = cost + at
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, at, j))
    path = [n - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def pack_block(ids: bytes, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Per piece: document, start in it, length, crc32, its document's tokens, sequence, offset in it. Ends count tokens of the block."""
    total = int(doc_ends[-1])
    ends = np.union1d(sentence_ends, doc_ends)
    starts = np.concatenate([[0], ends[:-1]])
    broken = [np.arange(s + HARD, e, HARD) for s, e in zip(starts[ends - starts > HARD].tolist(), ends[ends - starts > HARD].tolist(), strict=True)]
    c = np.unique(np.concatenate([[0], ends, *broken])).astype(np.int64)
    penalty = np.full(len(c), BROKEN, np.int64)
    penalty[np.isin(c, sentence_ends)] = SENTENCE
    penalty[np.isin(c, doc_ends)] = 0
    cuts = c[best_cuts(c, penalty, window)]
    bounds = np.union1d(cuts, doc_ends)
    begin, end = np.concatenate([[0], bounds[:-1]]) if bounds[0] else bounds[:-1], bounds if bounds[0] else bounds[1:]
    doc = np.searchsorted(doc_ends, begin, side="right")
    seq = np.searchsorted(cuts, begin, side="right") - 1
    doc_starts = np.concatenate([[0], doc_ends[:-1]])
    view = memoryview(ids)
    crc = np.fromiter((zlib.crc32(view[4 * b : 4 * e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))
    assert int((end - begin).sum()) == total
    return doc, begin - doc_starts[doc], end - begin, crc, (doc_ends - doc_starts)[doc], seq, begin - cuts[seq]


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document in a sequence; SCHEMA names the columns.

    tokenizer: path of a tokenizers file, on every node. A null or empty text has the end id alone; a very long text is cut
    over several sequences; repeated rows are packed once each; an empty table gives no rows; other columns are ignored.
    sequence_id is the task's number above 40 bits of running number: unique, and the same whenever the same files are read."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units, done = unit_ids(tokenizer), TaskContext.get().partitionId() << 40
        for group in grouped(batches, BLOCK_BYTES):
            doc_ids, bodies = columns(group, "doc_id", "text")
            ids, doc_ends, sentence_ends = units.ids([b or b"" for b in bodies], end_id)
            doc, *rest, seq, offset = pack_block(ids.tobytes(), doc_ends, np.unique(sentence_ends), window)
            out = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([out, *(pa.array(x.astype(np.int64)) for x in (*rest, seq + done, offset))], names=[x.split()[0] for x in SCHEMA.split(", ")])
            done += int(seq[-1]) + 1

    return texts(docs).mapInArrow(lean(work), SCHEMA)
