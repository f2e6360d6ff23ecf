"""Metrics of a stream to several sinks, each batch once, and statistics of queues from a listener.

A micro-batch's transaction is the stream's name and the batch's number. A sink writes it as a folder of its own, replaced when the batch is
run again, so a batch that failed halfway, in this sink or in another, is there once after a restart, and never in part.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.functions.registry import Registry

#: write(batch, folder of the transaction): replaces what is there
SINKS = Registry("metric sink")
SINKS.register("json")(lambda df, folder: df.write.mode("overwrite").json(folder))
SINKS.register("parquet")(lambda df, folder: df.write.mode("overwrite").parquet(folder))
SINKS.register("csv")(lambda df, folder: df.write.mode("overwrite").option("header", "true").csv(folder))


def _into(path: str, app: str, batch: int) -> str:
    return f"{path}/app={app}/batch={batch}"


def write_once(stream: DataFrame, app: str, sinks: Mapping[str, str], state: str, custom: Mapping[str, Callable[[DataFrame, str], None]] | None = None) -> StreamingQuery:
    """Start the stream over all that is there, into sinks (kind: path), each batch once in each. app: its name, one for one checkpoint (`state`). custom: further
    kinds. The batch is worked out once for all sinks."""
    kinds = {**SINKS.entries, **(custom or {})}
    if unknown := [k for k in sinks if k not in kinds]:
        raise ValueError(f"unknown metric sinks {unknown}; there are {sorted(kinds)}")

    def put(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for kind, path in sinks.items():
                kinds[kind](df, _into(path, app, batch))
        finally:
            df.unpersist()

    return stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode("append").foreachBatch(put).start()


def read_sink(spark: SparkSession, kind: str, path: str, schema: StructType) -> DataFrame:
    """What a sink holds: its rows with app and batch. Of no batches: no rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fields = StructType([*schema.fields, *StructType.fromDDL("app string").fields, StructField("batch", LongType())])
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], fields)
    reader = spark.read.schema(fields)
    return (reader.option("header", "true") if kind == "csv" else reader).format(kind).load(path)


class Observed(StreamingQueryListener):
    """Sums of what batches of streams observe, by the name of the observation; a batch counts once however often it is told of."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, int, str], dict[str, int]] = {}
        self.ended: dict[str, str | None] = {}
        self.change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = json.loads(event.progress.json)
        with self.change:
            for name, row in (progress.get("observedMetrics") or {}).items():
                self.seen[progress["id"], progress["batchId"], name] = {k: v or 0 for k, v in row.items()}

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended[str(event.runId)] = event.exception
            self.change.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until this listener has been told of all that the query did."""
        query.awaitTermination()
        with self.change:
            if not self.change.wait_for(lambda: str(query.runId) in self.ended, seconds):
                raise TimeoutError("the listener was not told of the query's end")

    def sums(self, name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for (_, _, of), row in self.seen.items():
            for k, v in row.items() if of == name else ():
                out[k] = out.get(k, 0) + v
        return out


def observed_queues(counts: DataFrame, name: str = "queue") -> DataFrame:
    """Rows of queues, observed under the name: those of `state.queues` are already, under its `observed`; of others, with columns came and went,
    what a batch brought to a key's queue, and what had to go."""
    if not {"came", "went"} <= set(counts.columns):
        return counts
    return counts.observe(name, F.sum("came").alias("produced"), F.sum("went").alias("dropped"), F.count("*").alias("touched"))


def queue_stats(listener: Observed, most: int, name: str = "queue") -> dict[str, int]:
    """size, produced, dropped of all queues together, and the most that one holds."""
    s = listener.sums(name)
    produced, dropped = s.get("produced", 0), s.get("dropped", 0)
    return {"size": produced - dropped, "produced": produced, "dropped": dropped, "most": most}
