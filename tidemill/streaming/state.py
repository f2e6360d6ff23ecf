"""State that grows by element: a replay buffer that waits for its steps, queues and batches, each an arbitrary stateful operator.

A group's state is a map or list in the state store, of which a micro-batch reads and writes the parts that it touches, however many there
are: every read and write is a call to the store, so elements that come together are kept together. Timers of event time say when a step is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK = 4096
PARTS = 16  # of a replay step's keys
BLOCK = 256  # items of a queue in one place of its state
RANK = {"running": 0, "failure": 1, "success": 2, "removed": 3}  # of tags of one time, the last stands


def stored(spark: SparkSession) -> None:
    """Keep state where maps, lists and timers can be kept, from the next query on."""
    if spark.conf.get(STORE, None) != ROCKSDB:
        spark.conf.set(STORE, ROCKSDB)


class Replay(StatefulProcessor):
    """Of a partition and step the latest tags of each key. When no key runs and no tag has come for `hold`, those that succeeded are
    released, and the step is forgotten; a step with a key that runs waits.

    Tags are appended in chunks to lists, one for each of PARTS parts of the keys, as they come; which one of a key stands is told when the timer is
    due, one part at a time. A part that has more than doubled is put together before, so that tags of one key don't pile up."""

    def __init__(self, hold_ms: int, key: str):
        self.hold, self.key = hold_ms, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tags = [handle.getListState(f"tags{p}", f"keys array<{self.key}>, ats array<long>, ranks array<int>") for p in range(PARTS)]
        self.step = handle.getValueState("step", "last long, held array<long>, kept array<long>")

    def _latest(self, part: int) -> pd.DataFrame:
        chunks = list(self.tags[part].get())
        tags = pd.DataFrame({c: [x for chunk in chunks for x in chunk[i]] for i, c in enumerate(("key", "at_ms", "r"))})
        return tags.sort_values(["at_ms", "r"], kind="stable").drop_duplicates("key", keep="last")

    def _put(self, part: int, tags: pd.DataFrame, anew: bool) -> None:
        columns = [tags[c].tolist() for c in ("key", "at_ms", "r")]
        if anew:
            self.tags[part].clear()
        for i in range(0, len(tags), CHUNK):
            self.tags[part].appendValue(tuple(c[i : i + CHUNK] for c in columns))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, held, kept = self.step.get() or (-1, [0] * PARTS, [0] * PARTS)
        before, held, kept = last, list(held), list(kept)
        for pdf in rows:
            pdf = pdf.assign(r=pdf["status"].map(RANK)).sort_values(["at_ms", "r"], kind="stable").drop_duplicates("key", keep="last")
            last = max(last, int(pdf["at_ms"].max()))
            for part, tags in pdf.groupby(pd.util.hash_array(pdf["key"].to_numpy()) % PARTS):
                self._put(part, tags, False)
                held[part] += len(tags)
                if held[part] > 2 * kept[part] + CHUNK:
                    latest = self._latest(part)
                    self._put(part, latest, True)
                    held[part] = kept[part] = len(latest)
        self.step.update((last, held, kept))
        if last != before:
            if before >= 0:
                self.handle.deleteTimer(before + self.hold)
            self.handle.registerTimer(last + self.hold)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        step = self.step.get()
        if step is None:
            return
        parts = [p for p in range(PARTS) if step[1][p]]
        if any((self._latest(p)["r"] == RANK["running"]).any() for p in parts):
            return
        for p in parts:
            latest = self._latest(p)
            done = latest["key"][latest["r"] == RANK["success"]].tolist()
            for i in range(0, len(done), CHUNK):
                yield pd.DataFrame([(key[0], key[1], k) for k in done[i : i + CHUNK]], columns=["partition_id", "step", "key"])
            self.tags[p].clear()
        self.step.clear()

    def close(self) -> None:
        pass


def released(events: DataFrame, hold: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """In append mode: partition_id, step, key of what succeeded, once its step has no key that runs and got no tag for `hold` of event
    time. events: at (timestamp), partition_id, key, step, status (running, success, failure, removed); a key belongs to one step.

    Of a key the tag with the latest `at` stands, in whatever order tags come, those of one time by their rank; tags behind the watermark
    (`late`) are dropped, and so are those without partition, step, key, time or a known status. A step that gets tags after its
    release begins anew."""
    stored(events.sparkSession)
    hold_ms = events.sparkSession.sql(f"SELECT CAST(unix_millis(TIMESTAMP_SECONDS(0) + INTERVAL {hold}) AS LONG)").first()[0]
    known = events.where(F.col("status").isin(*RANK)).na.drop(subset=["at", "partition_id", "key", "step"])
    tags = known.withWatermark("at", late).select("partition_id", F.col("step").cast("long").alias("step"), "key", "status", "at", F.unix_millis("at").alias("at_ms"))
    kind = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"partition_id {kind['partition_id']}, step long, key {kind['key']}"
    return tags.groupBy("partition_id", "step").transformWithStateInPandas(Replay(hold_ms, kind["key"]), out, "append", "eventTime")


class Queue(StatefulProcessor):
    """Of each key a ring of at most `most` items: an item that comes goes to the next place, the oldest goes when there are too many. Up to BLOCK
    places are one value; more are in blocks of BLOCK, of which items touch those that they come to, and which go once all their items have gone."""

    def __init__(self, most: int, key: str, item: str):
        self.most, self.key, self.item = most, key, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", "items array<long>")
        self.ends = handle.getValueState("ends", "head long, tail long, last array<long>")  # last: all items, or those of the block that is not full

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, tail, last = self.ends.get() or (0, 0, [])
        items = sorted(int(x) for pdf in rows for x in pdf[self.item].tolist())
        before, come = head, tail
        tail += len(items)
        head = max(head, tail - self.most)
        start, keep = come - len(last), head
        run = [*last, *items]
        if self.most > BLOCK:
            keep = tail // BLOCK * BLOCK
            for at in range(before // BLOCK, min(head, start) // BLOCK):
                self.blocks.removeKey((at,))
            for at in range(max(start, head // BLOCK * BLOCK), keep, BLOCK):
                self.blocks.updateValue((at // BLOCK,), (run[at - start : at - start + BLOCK],))
        self.ends.update((head, tail, run[keep - start :]))
        oldest = run[head - start] if head >= start else self.blocks.getValue((head // BLOCK,))[0][head % BLOCK]
        yield pd.DataFrame([(key[0], tail - head, tail, head, oldest, run[-1], len(items), head - before)], columns=[self.key, "size", "produced", "dropped", "oldest", "newest", "came", "went"])

    def close(self) -> None:
        pass


def queues(stream: DataFrame, key: str, item: str, most: int, observed: str = "queue") -> DataFrame:
    """In update mode: key, size, produced, dropped, oldest, newest of each key's queue of `most` items (more than none), to which a micro-batch's items
    come in ascending order; rows without an item are left out. What comes and goes in a micro-batch is observed under the name `observed`, for
    `sinks.Observed`: produced, dropped, and the keys touched."""
    if most < 1:
        raise ValueError("a queue needs room for an item")
    stored(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, size long, produced long, dropped long, oldest long, newest long, came long, went long"
    rows = stream.select(key, F.col(item).cast("long").alias(item)).na.drop(subset=[item])
    moved = rows.groupBy(key).transformWithStateInPandas(Queue(most, key, item), out, "update", "none")
    return moved.observe(observed, F.sum("came").alias("produced"), F.sum("went").alias("dropped"), F.count("*").alias("touched")).drop("came", "went")


class Batches(StatefulProcessor):
    """Of each key the items that do not fill a batch yet, as a list that grows at its end by what a micro-batch brings."""

    def __init__(self, size: int, key: str, item: str):
        self.size, self.key, self.item = size, key, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "items array<long>")
        self.counts = handle.getValueState("counts", "waiting long, done long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, done = self.counts.get() or (0, 0)
        items = sorted(int(x) for pdf in rows for x in pdf[self.item].tolist())
        if waiting + len(items) < self.size:
            self.waiting.appendValue((items,))
            self.counts.update((waiting + len(items), done))
            return
        whole = [x for (part,) in self.waiting.get() for x in part] + items if waiting else items
        full = len(whole) // self.size
        rest = whole[full * self.size :]
        if rest:
            self.waiting.put([(rest,)])
        elif waiting:
            self.waiting.clear()
        self.counts.update((len(rest), done + full))
        step = max(1, CHUNK // self.size) * self.size
        for at in range(0, full * self.size, step):
            part = whole[at : min(at + step, full * self.size)]
            yield pd.DataFrame({self.key: [key[0]] * len(part), "batch": [done + (at + i) // self.size for i in range(len(part))], self.item: part})

    def close(self) -> None:
        pass


def full_batches(stream: DataFrame, key: str, item: str, size: int) -> DataFrame:
    """In append mode: key, batch, item for every batch of exactly `size` items of a key; what does not fill one waits; rows without an item are left out."""
    if size < 1:
        raise ValueError("a batch needs an item")
    stored(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, F.col(item).cast("long").alias(item)).na.drop(subset=[item])
    return rows.groupBy(key).transformWithStateInPandas(Batches(size, key, item), f"{key} {kind}, batch long, {item} long", "append", "none")
