"""What the operators share: checkpoints in the cluster's folder, batches of whole texts, hashing by document."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import cut, ship

__all__ = ["WORD", "columns", "cut", "doc_crc", "fresh", "grouped", "lean", "release", "ship", "table", "tasks", "texts"]

BATCH_BYTES = "4m"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text as UTF-8 and further columns of df, whatever else it holds. Batches go to Python by size, since texts differ
    in length: what a task holds of them is bounded in bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches, in order, put together so that each group holds about `most` bytes of text (a longer text: alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [x or 0 for x in pc.binary_length(batch.column("text")).to_pylist()]
        start = 0
        for i, n in enumerate(sizes):
            if size and size + n > most:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield held
                held, size, start = [], 0, i
            size += n
        held.append(batch.slice(start))
    if held:
        yield held


def release() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Work that gives its memory back to the system when a task ends: Python workers live on, beside one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def columns(group: list[pa.RecordBatch], *names: str) -> list[list]:
    return [[x for b in group for x in b.column(n).to_pylist()] for n in names]


def doc_crc(doc_id: int | None) -> int:
    """crc32 of the decimal text of doc_id, as F.crc32(doc_id as string) has it; a null id: 0."""
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def tasks(df: DataFrame) -> int:
    """Partitions for a shuffle of df's rows: what the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
