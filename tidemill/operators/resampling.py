"""Metrics of prompts under resampling, as joins and array expressions.

Draws come from a counter: number j of draw b is the first 32 bits of md5("seed:b:j"), scaled to a place below n, so they are the same for
every prompt with n values, in any task and in SQL. Of a sorted sample the best of k drawn values is the one with the greatest
drawn place. So how often each place is the greatest, and the least, of k drawn ones is counted once for each n and k, and a
prompt's best and worst are sums of its sorted values with these counts as weights; no draw is made again for a prompt. Prompts find the
counts of their n by a join whose hot keys adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES, SEED = 1000, 42


def place(b: Column, j: Column, n: Column, seed: int) -> Column:
    """The place below n of number j of draw b."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.shiftright(word * n, 32)


@lru_cache(maxsize=8)
def _words(size: int, times: int, seed: int) -> np.ndarray:
    out = [int(hashlib.md5(f"{seed}:{b}:{j}".encode()).hexdigest()[:8], 16) for b in range(times) for j in range(size)]
    return np.array(out, np.int64).reshape(times, size)


def places(n: int, k: int, times: int = TIMES, seed: int = SEED) -> np.ndarray:
    """times x k places below n: those of `place`."""
    size = 1 << max(0, k - 1).bit_length()
    return (_words(size, times, seed)[:, :k] * n) >> 32


def subset_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n; none for a single value."""
    powers = F.array(*(F.lit(2**p).cast("long") for p in range(1, 40)))
    return F.when(n > 1, F.concat(F.filter(powers, lambda p: p < n), F.array(n))).otherwise(F.array().cast("array<long>"))


def extreme_counts(ns: DataFrame, times: int = TIMES, seed: int = SEED) -> DataFrame:
    """n, k, best, worst: for each n above 1 of ns (column n, long) and each subset size, how often each place is the greatest, and the least, of k drawn ones."""
    sizes = ns.select("n").distinct().select("n", F.explode(subset_sizes(F.col("n"))).alias("k"))
    drawn = sizes.select("n", "k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("b"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: place(F.col("b"), j, F.col("n"), seed))
    ends = drawn.repartition("n", "k", "b").select("n", "k", at.alias("at")).select("n", "k", F.array_max("at").alias("best"), F.array_min("at").alias("worst"))
    tall = ends.select("n", "k", F.explode(F.array(F.struct(F.lit("best").alias("which"), F.col("best").alias("i")), F.struct(F.lit("worst").alias("which"), F.col("worst").alias("i")))).alias("x"))
    counts = tall.groupBy("n", "k", "x.which", "x.i").agg(F.count("*").alias("c"))
    of = lambda which: F.map_from_entries(F.collect_list(F.when(F.col("which") == which, F.struct("i", "c"))))
    maps = counts.groupBy("n", "k").agg(of("best").alias("best"), of("worst").alias("worst"))
    row = lambda m: F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0).cast("long")))
    return maps.select("n", "k", row(F.col("best")).alias("best"), row(F.col("worst")).alias("worst"))


def _weighted(xs: Column, w: Column, times: int) -> tuple[Column, Column]:
    """Mean and population deviation of values that come w times each."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(F.zip_with(xs, w, lambda x, c: x * c)) / times
    return mean, F.sqrt(total(F.zip_with(xs, w, lambda x, c: (x - mean) * (x - mean) * c)) / times)


def extremes(prompts: DataFrame, times: int = TIMES, seed: int = SEED) -> DataFrame:
    """prompts (n, xs and more; xs: its n values in ascending order) by subset size k: best_mean, best_std, worst_mean, worst_std."""
    counts = extreme_counts(prompts, times, seed).withColumnRenamed("n", "__n")
    both = prompts.join(counts, F.col("n") == F.shiftleft("__n", 0)).drop("__n")
    (bm, bs), (wm, ws) = _weighted(F.col("xs"), F.col("best"), times), _weighted(F.col("xs"), F.col("worst"), times)
    return both.withColumns({"best_mean": bm, "best_std": bs, "worst_mean": wm, "worst_std": ws}).drop("best", "worst")


def exact_extremes(prompts: DataFrame) -> DataFrame:
    """The same by order statistics, without draws: the greatest of k of n values is the i-th smallest with probability (i/n)^k - ((i-1)/n)^k."""
    sized = prompts.withColumn("k", F.explode(subset_sizes(F.col("n"))))
    to = lambda i: F.pow(i / F.col("n"), F.col("k"))
    ranks = F.sequence(F.lit(1).cast("long"), F.col("n"))
    best = F.transform(ranks, lambda i: to(i) - to(i - 1))
    worst = F.transform(ranks, lambda i: to(F.col("n") - i + 1) - to(F.col("n") - i))
    (bm, bs), (wm, ws) = _weighted(F.col("xs"), best, 1), _weighted(F.col("xs"), worst, 1)
    return sized.withColumns({"best_mean": bm, "best_std": bs, "worst_mean": wm, "worst_std": ws})


def majority_values(values: np.ndarray, votes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row of places, the value of the first one whose vote is the most frequent; of equally frequent votes the one drawn first. votes: numbers from 0."""
    drawn, rows = votes[at], np.arange(len(at))[:, None]
    width = int(votes.max()) + 1
    counts = np.bincount((rows * width + drawn).ravel(), minlength=len(at) * width).reshape(len(at), width)
    return values[at[rows[:, 0], counts[rows, drawn].argmax(axis=1)]]


@lru_cache(maxsize=4096)
def _pattern_counts(votes: bytes, times: int, seed: int) -> np.ndarray:
    """For each subset size, how often each place is the one that stands for the majority of the places drawn. votes: numbers from 0, of 64 bits, by place."""
    own = np.frombuffer(votes, np.int64)
    at = np.arange(len(own))
    return np.stack([np.bincount(majority_values(at, own, places(len(own), k, times, seed)), minlength=len(own)) for k in sizes(len(own))])


def _patterns(votes: list) -> dict[bytes, list[int]]:
    """Rows by which of their votes are equal: numbers from 0, in order of their first place."""
    out: dict[bytes, list[int]] = {}
    for row, own in enumerate(votes):
        codes: dict = {}
        out.setdefault(np.array([codes.setdefault(v, len(codes)) for v in own], np.int64).tobytes(), []).append(row)
    return out


def majorities(prompts: DataFrame, times: int = TIMES, seed: int = SEED) -> DataFrame:
    """keys, k, maj_mean, maj_std of prompts (n, xs, votes and keys; xs and votes: of its samples, in order).

    Which place stands for a majority depends on the draws and on which votes are equal, so places are counted once for prompts with
    equal votes at the same places, and a prompt's values are weighted by these counts."""
    keys = [c for c in prompts.columns if c not in ("n", "xs", "votes")]
    kinds = dict(prompts.dtypes)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, ks, means, stds = [], [], [], []
            values = pdf["xs"].tolist()
            for pattern, alike in _patterns(pdf["votes"].tolist()).items():
                weights = _pattern_counts(pattern, times, seed) / times
                x = np.array([values[row] for row in alike], float)
                mean = x @ weights.T
                stds.append(np.sqrt(np.einsum("pkn,kn->pk", (x[:, None, :] - mean[:, :, None]) ** 2, weights)).ravel())
                means.append(mean.ravel())
                rows.append(np.repeat(alike, len(weights)))
                ks.append(np.tile(sizes(x.shape[1]), len(alike)))
            if rows:
                out = pdf[keys].iloc[np.concatenate(rows)].reset_index(drop=True)
                yield out.assign(k=np.concatenate(ks), maj_mean=np.concatenate(means), maj_std=np.concatenate(stds))

    return prompts.where("n > 1").mapInPandas(work, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", k long, maj_mean double, maj_std double")


def sizes(n: int) -> list[int]:
    """2, 4, 8, ... below n, and n."""
    return [*(2**p for p in range(1, 40) if 2**p < n), n] if n > 1 else []
