"""Ranked lexical search: the best documents for each item of a query set, by a threshold-seeded join.

An index keeps, for each document, its number of terms and those of its terms that some item asks for, with their counts; for
each term, its document frequency, its greatest impact on a score and its k-th greatest. Impacts are never negative, so the greatest
of an item's stored k-th impacts is a lower bound of its k-th score. Of an item's terms in order of greatest impact, the longest tail
whose bounds add up to less than that can't lift a document into the result by itself: only documents that hold one of the
other terms are candidates, and of these only those whose sum over such terms and the tail's bound reaches the threshold are
scored again, exactly, with all terms. A task raises an item's threshold as it finds documents, and sends on its best k; the best of
all tasks are the result. A document's terms lie in one row, so candidates are made and scored where the row is read: postings
are never shuffled, only terms' k greatest impacts and items' k best documents for each task.

Items come in blocks of bounded size, the only data that is broadcast: each block is one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.runtime import columns, cut, grouped, lean, texts
from tidemill.session import dropped, shared_folder

K = 50
BLOCK_BYTES = 2_000_000
GROUP_BYTES, PAIRS, CELLS = 1_000_000, 2_000_000, 2_000_000
SCALE = 1_000_000_000

#: letters and digits, and all that is not ASCII, belong to terms; A-Z are lower-cased
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def counted(text: bytes | None) -> tuple[int, Counter]:
    """How many terms a text has, and each with its count."""
    found = terms(text)
    return len(found), Counter(found)


def blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items as (item_id, distinct terms), in blocks of BLOCK_BYTES of terms or a single item; one block is held at a time."""
    held, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).distinct().sort("item_id", "text").toLocalIterator():
        own = sorted(counted(r["text"] and bytes(r["text"]))[1])
        more = sum(len(t) + 24 for t in own)
        if held and size + more > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append((r["item_id"], own))
        size += more
    if held:
        yield held


def index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms, tfs: a row for each document with a term; of its terms those of the vocabulary, by number."""
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = words.value
        for group in grouped(batches, GROUP_BYTES):
            out: dict[str, list] = {"doc_id": [], "n": [], "terms": [], "tfs": []}
            for doc_id, text in zip(*columns(group, "doc_id", "text")):
                n, found = counted(text)
                if n:
                    own = sorted((ids[t], k) for t, k in found.items() if t in ids)
                    out["doc_id"].append(doc_id), out["n"].append(n)
                    out["terms"].append([t for t, _ in own]), out["tfs"].append([k for _, k in own])
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["terms"], pa.list_(pa.int32())), pa.array(out["tfs"], pa.list_(pa.int64()))], names=list(out))

    return texts(docs).mapInArrow(lean(read), "doc_id long, n long, terms array<int>, tfs array<long>")


def postings(batch: pa.RecordBatch, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each posting of the batch its row, its term and its impact per unit of the term's weight."""
    col, tf = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
    row = np.repeat(np.arange(len(batch)), np.asarray(col.value_lengths()))
    m = 50 + np.array([50 * n * n_docs // n_terms for n in batch.column("n").to_pylist()], np.int64)
    return row, col.flatten().to_numpy().astype(np.int64), SCALE * tf // (1000 * tf + 20 * m[row])


def first(order: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Of an order that sorts by key first, the first k of each key."""
    s = key[order]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order[np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s)))) < k]


def term_impacts(indexed: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """term, df, most, kth: document frequency, greatest and k-th greatest impact per unit of weight (0 if fewer) of each term."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, df = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            if not batch.num_rows:
                continue
            _, term, q = postings(batch, n_docs, n_terms)
            more = np.bincount(term, minlength=len(df))
            more[: len(df)] += df
            df = more
            held, best = np.concatenate([held, term]), np.concatenate([best, q])
            keep = first(np.lexsort((-best, held)), held, k)
            held, best = held[keep], best[keep]
        at = np.flatnonzero(df)
        ends = np.searchsorted(held, at, "right")
        begins = np.searchsorted(held, at, "left")
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64()), pa.array([best[a:b] for a, b in zip(begins, ends)], pa.list_(pa.int64()))], names=["term", "df", "best"])

    found = cut(indexed.select("n", "terms", "tfs").mapInArrow(lean(top), "term int, df long, best array<long>"))
    ranked = found.select("term", F.explode("best").alias("q")).withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("q")))).where(F.col("r") <= k)
    stored = ranked.groupBy("term").agg(F.max("q").alias("most"), F.coalesce(F.max(F.when(F.col("r") == k, F.col("q"))), F.lit(0)).alias("kth"))
    return found.groupBy("term").agg(F.sum("df").alias("df")).join(stored, "term")


class Plan:
    """For the items of a block: weights of terms, thresholds, and the terms that make candidates apart from those of the tails.

    pairs: (item, term) with both numbered."""

    def __init__(self, items: list[list[int]], weight: np.ndarray, most: np.ndarray, kth: np.ndarray):
        self.weight, n = weight, len(items)
        self.floor, self.rest = np.zeros(n, np.int64), np.zeros(n, np.int64)
        lead, tail = [], []
        for i, own in enumerate(items):
            t = np.array([x for x in own if weight[x] * most[x] > 0], np.int64)
            if not len(t):
                continue
            t = t[np.lexsort((t, weight[t] * most[t]))]
            bound = np.cumsum(weight[t] * most[t])
            self.floor[i] = max(1, (weight[t] * kth[t]).max())
            cut_at = int(np.searchsorted(bound, self.floor[i], "left"))  # bounds below the threshold: a tie is none
            self.rest[i] = bound[cut_at - 1] if cut_at else 0
            tail += [(x, i) for x in t[:cut_at].tolist()]
            lead += [(x, i) for x in t[cut_at:].tolist()]
        self.lead, self.tail = (self._by_term(x, len(weight)) for x in (lead, tail))

    @staticmethod
    def _by_term(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        return np.searchsorted(at[:, 0], np.arange(n + 1)), at[:, 1]

    def sums(self, side: tuple[np.ndarray, np.ndarray], row: np.ndarray, term: np.ndarray, q: np.ndarray, rows: int) -> np.ndarray:
        """Scores of rows x items over the terms of a side; sums stay below 2^53, so doubles hold them exactly."""
        starts, items = side
        out = np.zeros(rows * len(self.floor))
        each = starts[term + 1] - starts[term]
        ends = np.cumsum(each)
        a = 0
        while a < len(term):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = each[a:b]
            whole = np.repeat(np.arange(a, b), n)
            item = items[starts[term[whole]] + np.arange(len(whole)) - np.repeat(np.cumsum(n) - n, n)]
            out += np.bincount(row[whole] * len(self.floor) + item, (self.weight[term] * q)[whole].astype(float), len(out))
            a = b
        return out.reshape(rows, -1)


def candidates(indexed: DataFrame, plan: Plan, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id, score: of each task the k best documents of each item, if they may be among the k best of all."""
    held = indexed.sparkSession.sparkContext.broadcast(plan)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = held.value
        floor, step = p.floor.copy(), max(1, CELLS // len(p.floor))
        item, score, ids, none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, term, q = postings(batch, n_docs, n_terms)
                partial = p.sums(p.lead, row, term, q, len(batch))
                doc, found = np.nonzero((partial > 0) & (partial + p.rest >= floor))
                some = np.zeros(len(batch), bool)
                some[doc] = True
                again = some[row]
                exact = partial[doc, found] + p.sums(p.tail, row[again], term[again], q[again], len(batch))[doc, found]
                col = batch.column("doc_id")
                item, score = np.concatenate([item, found]), np.concatenate([score, exact.astype(np.int64)])
                ids, none = np.concatenate([ids, col.fill_null(0).to_numpy()[doc]]), np.concatenate([none, col.is_null().to_numpy(zero_copy_only=False)[doc]])
                keep = first(np.lexsort((ids, none, -score, item)), item, k)
                item, score, ids, none = item[keep], score[keep], ids[keep], none[keep]
                count = np.bincount(item, minlength=len(floor))
                full = np.flatnonzero(count >= k)
                floor[full] = np.maximum(floor[full], score[(np.cumsum(count) - 1)[full]])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=none), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return indexed.mapInArrow(lean(search), "item int, doc_id long, score long")


def best(indexed: DataFrame, items: list[tuple], vocabulary: dict[bytes, int], k: int) -> DataFrame:
    spark = indexed.sparkSession
    n_docs, n_terms = indexed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight, most, kth = (np.zeros(len(vocabulary), np.int64) for _ in range(3))
    for r in term_impacts(indexed, n_docs, n_terms, k).toLocalIterator() if n_docs else ():  # a row for each term of the block
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
        most[r["term"]], kth[r["term"]] = r["most"], r["kth"]
    plan = Plan([[vocabulary[t] for t in own] for _, own in items], weight, most, kth)
    found = candidates(indexed, plan, n_docs, n_terms, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item int, item_id long")
    return cut(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents with the highest score above 0 for each item, equal scores by doc_id.

    docs: doc_id, text; items: item_id, text. Null texts and texts without terms are never found and don't count as documents; items
    without terms, and items whose terms no document holds, have no rows; texts of any length are read whole; each row of docs is a
    document, so a repeated row is found twice; rows without doc_id rank last among equal scores; repeated rows of items are one item,
    different texts under one item_id are items of their own; empty tables give no rows; other columns are ignored."""
    spark: SparkSession = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in block for t in own}))}
        folder = f"{shared_folder(spark)}/search-{uuid4().hex}"
        index(docs, vocabulary).write.parquet(folder)
        out = out.unionByName(best(spark.read.parquet(folder), block, vocabulary, k))
        dropped(spark, folder)
    return out


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS MATERIALIZED (SELECT doc_id, CAST(n AS BIGINT) AS n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s GROUP BY term),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM benchmark),
r AS (SELECT item_id, doc_id, CAST(sum(weight * (({SCALE} * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {K}
"""
