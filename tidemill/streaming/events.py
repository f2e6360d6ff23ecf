"""Windows of event time, and running a stream over what is there to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def read_events(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """The files at path as a stream, their time as a timestamp."""
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern that only this path fits: a stream takes a file as it takes a folder
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(glob)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """window_start, by, n, total: tumbling, or sliding with `slide`; later rows than `late` go."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    """by, session_start, session_end, n."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(s, by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their keys within the time that late rows have."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Run over all that is there, then stop; the result as a table. mode: complete (the last result stands), append, or update, in which
    the last row of each of `keys` stands: micro-batches are written beside one another, each once however often it is run, and
    put together when read."""
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys of a row")
    spark, out = stream.sparkSession, f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    elif mode == "update":
        query = writer.foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/__batch={k}")).outputMode(mode).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).outputMode(mode).start()
    query.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(out)
    fields = stream.schema.names
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    written = spark.read.schema(StructType([*stream.schema.fields, StructField("__batch", LongType())])).parquet(out)
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*fields), "__batch").alias("x"))
    return last.select(*(F.col(f"x.{c}").alias(c) for c in fields))


def flagged(value: Column, low: float, high: float) -> Column:
    return ~value.between(low, high)
