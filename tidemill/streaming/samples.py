"""Queues and batches over streams of samples, as state kept by key (a shard of producers), and what happens outside a stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class BoundedQueue:
    """First in, first out; when full, the oldest goes. None once it is closed and empty."""

    most: int
    items: deque = field(default_factory=deque)
    produced: int = 0
    consumed: int = 0
    dropped: int = 0
    closed: bool = False

    def put(self, item: Any) -> bool:
        """False if an item had to go for it."""
        full = len(self.items) >= self.most
        if full:
            self.items.popleft()
            self.dropped += 1
        self.items.append(item)
        self.produced += 1
        return not full

    def get(self) -> Any:
        if not self.items:
            if self.closed:
                return None
            raise LookupError("the queue is empty")
        self.consumed += 1
        return self.items.popleft()

    def stats(self) -> dict[str, int]:
        return {"size": len(self.items), "produced": self.produced, "consumed": self.consumed, "dropped": self.dropped, "most": self.most}


SHARDS = 2048  # of a stream's keys: a state each
HELD = "ids array<string>, sizes array<long>, items array<long>, counts array<long>"


def _merged(ids: list[str], sizes: list[int], items: list[int], counts: list[int], pdf: pd.DataFrame, item: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, counts, totals, and of all items (those held, then those that come in ascending order, key by key) the key's number, the place among the key's and the item; last, for each row of pdf its key's number."""
    at = {k: i for i, k in enumerate(ids)}
    codes, names = pd.factorize(pdf["__id"])
    own = np.array([at.setdefault(k, len(at)) for k in names], np.int64)[codes]
    come = pdf[item].to_numpy(np.int64)
    up = np.argsort(come, kind="stable")
    key = np.concatenate([np.repeat(np.arange(len(ids)), np.asarray(sizes, np.int64)), own[up]])
    order = np.argsort(key, kind="stable")
    key = key[order]
    totals = np.bincount(key, minlength=len(at))
    place = np.arange(len(key)) - (np.cumsum(totals) - totals)[key]
    counted = np.concatenate([np.asarray(counts, np.int64), np.zeros(len(at) - len(ids), np.int64)])
    return list(at), counted, totals, key, place, np.concatenate([np.asarray(items, np.int64), come[up]])[order], own


def _sharded(stream: DataFrame, key: str, item: str, step: Callable, out: str, mode: str, shards: int) -> DataFrame:
    """A call of step for a shard of keys, not for each, which would cost more than what is done there. A null key is a shard of its own."""
    kind = stream.schema[key].dataType.simpleString()
    name = F.col(key).cast("string") if kind in ("tinyint", "smallint", "int", "bigint", "string") else F.to_json(F.struct(key))
    rows = stream.select(key, F.col(item).cast("long").alias(item), F.coalesce(name, F.lit("")).alias("__id")).na.drop(subset=[item])
    rows = rows.withColumn("__shard", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64("__id"), F.lit(shards)).cast("int")))
    return rows.groupBy("__shard").applyInPandasWithState(step, f"{key} {kind}, {out}", HELD, mode, GroupStateTimeout.NoTimeout)


def _values(shard: tuple, keys: pd.Series, at: np.ndarray) -> Any:
    return [None] * len(at) if shard[0] < 0 else keys.iloc[at].array


def queue_counts(stream: DataFrame, key: str, item: str, most: int, shards: int = SHARDS) -> DataFrame:
    """In update mode: key, size, produced, dropped, oldest, newest of each key's bounded queue, to which a micro-batch's items come in ascending order; rows
    without an item are left out. The queues of a shard of keys are one state."""

    def step(shard: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(chunks), ignore_index=True)
        ids, produced, totals, key_of, place, items, own = _merged(*(state.get if state.exists else ([], [], [], [])), pdf, item)
        touched, first = np.unique(own, return_index=True)
        produced = produced + np.bincount(own, minlength=len(ids))
        keep = place >= totals[key_of] - most
        sizes, items = np.minimum(totals, most), items[keep]
        ends = np.cumsum(sizes)
        state.update((ids, sizes.tolist(), items.tolist(), produced.tolist()))
        size, made, end = sizes[touched], produced[touched], ends[touched]
        yield pd.DataFrame({key: _values(shard, pdf[key], first), "size": size, "produced": made, "dropped": made - size, "oldest": items[end - size], "newest": items[end - 1]})

    if most < 1:
        raise ValueError("a queue needs room for an item")
    return _sharded(stream, key, item, step, "size long, produced long, dropped long, oldest long, newest long", "update", shards)


def count_batches(stream: DataFrame, key: str, item: str, size: int, shards: int = SHARDS) -> DataFrame:
    """In append mode: key, batch, item for every batch of exactly `size` items of a key; what does not fill one waits; rows without an item are left out.
    What waits of a shard of keys is one state."""

    def step(shard: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(chunks), ignore_index=True)
        ids, done, totals, key_of, place, items, own = _merged(*(state.get if state.exists else ([], [], [], [])), pdf, item)
        full = totals // size
        out = place < (full * size)[key_of]
        state.update((ids, (totals - full * size).tolist(), items[~out].tolist(), (done + full).tolist()))
        if out.any():
            first = np.zeros(len(ids), np.int64)
            first[own[::-1]] = np.arange(len(own))[::-1]
            whose = key_of[out]
            yield pd.DataFrame({key: _values(shard, pdf[key], first[whose]), "batch": done[whose] + place[out] // size, item: items[out]})

    if size < 1:
        raise ValueError("a batch needs an item")
    return _sharded(stream, key, item, step, f"batch long, {item} long", "append", shards)


def counted(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """The same batches of a table at rest."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("batch", F.floor(k / size)).where(k < n - n % size)


@dataclass
class Admission:
    """Whether a producer may go on: the queue has room, and not too many samples would be stale after the next sync."""

    required: int
    threshold: float
    sync_every: int
    most_queued: int
    stale: int = 0

    @property
    def most_stale(self) -> int:
        return int(self.required * (1 + self.threshold) * self.sync_every)

    def paused(self, queued: int) -> bool:
        return queued >= self.most_queued or self.stale >= self.most_stale

    def admitted(self) -> None:
        self.stale += 1

    def synced(self, active: int, queued: int) -> None:
        """After new weights: what runs or waits is stale already."""
        self.stale = active + queued


class SideQueue:
    """First in, first out, without a bound: validation results, apart from the samples."""

    def __init__(self) -> None:
        self.items: deque = deque()

    def put(self, item: Any) -> None:
        self.items.append(item)

    def get(self) -> Any:
        return self.items.popleft() if self.items else None


def sample_ids(prompts: DataFrame, total: int, epoch_rows: int, order: str = "row_idx") -> DataFrame:
    """A row per sample, `total` of them: the prompts epoch after epoch, with sample_id `sample_<epoch>_<step>`; steps count on over epochs."""
    epochs = F.sequence(F.lit(0).cast("long"), F.lit((total - 1) // epoch_rows).cast("long"))
    step = F.col("epoch") * epoch_rows + F.col(order)
    made = prompts.withColumn("epoch", F.explode(epochs)).withColumn("step", step).where(F.col("step") < total)
    return made.withColumn("sample_id", F.concat_ws("_", F.lit("sample"), F.col("epoch").cast("string"), F.col("step").cast("string")))


def idle_ratio(waiting: float, step: float) -> float:
    """The share of a step that was spent waiting for samples."""
    return waiting / step if step > 0 else 0.0


def overlapped(batches: Iterable[Any], generate: Any, train: Any) -> list[Any]:
    """The results of training on each batch's generation, while the next one is generated: one step ahead, in order."""
    from concurrent.futures import ThreadPoolExecutor

    out, waiting = [], None
    with ThreadPoolExecutor(1) as ahead:
        for b in batches:
            coming = ahead.submit(generate, b)
            if waiting is not None:
                out.append(train(waiting.result()))
            waiting = coming
        if waiting is not None:
            out.append(train(waiting.result()))
    return out


def assembled(samples: DataFrame, size: int, parts: int, order: str = "sample", length: str = "seqlen") -> DataFrame:
    """samples with batch, part and place: batches of `size` samples in order (one that is not full waits), each balanced over `parts`."""
    from tidemill.operators.balance import assigned
    from tidemill.operators.batch import ROW, numbered

    rows = numbered(samples, order).withColumn("batch", F.floor(F.col(ROW) / size))
    n = rows.groupBy("batch").count().where(F.col("count") == size).select("batch")
    full = rows.join(n, "batch", "left_semi")
    return full.join(assigned(full, "batch", parts, length, equal_size=size % parts == 0), ["batch", ROW]).drop(ROW)


def stale(rows: DataFrame, version: Column, current: Column) -> DataFrame:
    """rows with `behind`: versions behind the current one. Late samples are counted and kept."""
    return rows.withColumn("behind", F.greatest(current - version, F.lit(0)))


def replay_state(events: DataFrame) -> DataFrame:
    """The latest tags of each key that was not removed. events: at, partition_id, key, op (put, remove), status, step."""
    latest = events.groupBy("partition_id", "key").agg(F.max_by(F.struct("op", "status", "step"), "at").alias("x"))
    return latest.where("x.op <> 'remove'").select("partition_id", "key", "x.status", "x.step")


def replay_stream(events: DataFrame) -> DataFrame:
    """In update mode: partition_id, key, status, step, removed as the stream leaves them: the state of a key is its latest tags, and a
    later `at` wins over an earlier one whichever comes first; of tags of one time the greatest by op, status and step. Tags without a time are left out."""
    tags = events.where(F.col("at").isNotNull()).withColumns({"at": F.col("at").cast("long"), "step": F.col("step").cast("long")})
    latest = tags.groupBy("partition_id", "key").agg(F.max(F.struct("at", "op", "status", "step")).alias("x"))
    return latest.select("partition_id", "key", "x.status", "x.step", (F.col("x.op") == "remove").alias("removed"))


def ready(state: DataFrame) -> DataFrame:
    """Of a replay state (columns status, step): what succeeded, of steps in which nothing runs any more."""
    running = state.where("status = 'running'").select("step").distinct()
    return state.where("status = 'success'").join(running, "step", "left_anti")


def replay_sample(events: DataFrame) -> DataFrame:
    """Keys that succeeded, of steps in which nothing runs any more."""
    return ready(replay_state(events))


@dataclass
class TokenBucket:
    """Tokens come at a rate, up to a capacity; a request for more than there are waits, one for more than fit leaves a debt."""

    rate: float
    most: float
    tokens: float | None = None
    at: float = 0.0

    def acquire(self, now: float, n: float = 1.0) -> float:
        """When a request made now is served."""
        have = self.most if self.tokens is None else min(self.most, self.tokens + (max(now, self.at) - self.at) * self.rate)
        start = max(now, self.at)
        need = min(n, self.most)
        wait = max(0.0, (need - have) / self.rate)
        self.tokens, self.at = have + wait * self.rate - n, start + wait
        return self.at


def served(requests: Iterable[tuple[float, float]], rate: float, most: float) -> list[float]:
    bucket = TokenBucket(rate, most)
    return [bucket.acquire(now, n) for now, n in requests]
