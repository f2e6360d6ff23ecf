"""Reading prompt, chat and preference tables, sampling and splitting them, and writing rollouts and metrics."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.draws import word
from tidemill.functions.registry import Registry
from tidemill.operators.batch import ROW, numbered

READERS = Registry("table reader")
READERS.register("parquet")(lambda spark, path: spark.read.parquet(path))
READERS.register("json")(lambda spark, path: spark.read.option("multiLine", "true").json(path))
READERS.register("jsonl")(lambda spark, path: spark.read.json(path))


def read_tables(spark: SparkSession, files: str | Sequence[str]) -> DataFrame:
    """Files one after another, with row_idx, in the order of the rows within them (of a folder: by the names of its files); by their
    extension, else a ValueError."""
    out = None
    for k, path in enumerate([files] if isinstance(files, str) else files):
        kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if kind not in READERS:
            raise ValueError(f"no reader for {path!r}; there are {sorted(READERS.entries)}")
        df = READERS[kind](spark, path)
        if _has(df, "_metadata.file_path"):  # splits are not read in the order of files
            inside = "row_index" if _has(df, "_metadata.row_index") else "file_block_start"
            df = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col(f"_metadata.{inside}").alias("__block"))
        else:
            df = df.withColumns({"__path": F.lit(""), "__block": F.lit(0).cast("long")})
        df = df.withColumns({"__file": F.lit(k), "__at": F.monotonically_increasing_id()})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    order = ("__file", "__path", "__block", "__at")
    return numbered(out, *order).drop(*order)


def _has(df: DataFrame, column: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        df.select(column).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def sampled(rows: DataFrame, most: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """At most so many rows: by a hash of row number and seed, without replacement, or the first ones. Negative: all."""
    if most <= 0:
        return rows
    order = (word(seed, ROW), ROW) if shuffle else (ROW,)
    return rows.orderBy(*order).limit(most)


def ordered(rows: DataFrame, shuffle: bool, seed: int = 0) -> DataFrame:
    """rows with row_idx in a seeded order, or as they were."""
    return numbered(rows.withColumnRenamed(ROW, "__old").withColumn("__h", word(seed, "__old")), "__h", "__old").drop("__old", "__h") if shuffle else rows


def batches(rows: DataFrame, size: int, drop_last: bool = True) -> DataFrame:
    """rows with batch_id; without an incomplete last batch. No batch at all is an error."""
    n = rows.count()
    if not n or drop_last and n < size:
        raise ValueError("there is no batch")
    out = rows.withColumn("batch_id", F.floor(F.col(ROW) / size))
    return out.where(F.col("batch_id") < n // size) if drop_last else out


def steps(n_batches: int, epochs: int, given: int | None = None) -> int:
    return given if given is not None else n_batches * epochs


def ranked(rows: DataFrame, ranks: int, batch: int) -> DataFrame:
    """rows with rank and each rank's own batch_id, of batch / ranks rows; what does not fill a batch goes."""
    per = batch // ranks
    out = rows.withColumns({"rank": F.col(ROW) % ranks, "batch_id": F.floor(F.floor(F.col(ROW) / ranks) / per)})
    return out.where(F.col("batch_id") < rows.count() // ranks // per)


def split(rows: DataFrame, parts: int) -> DataFrame:
    """rows with part: equal runs of rows; the remainder goes."""
    if not isinstance(parts, int) or isinstance(parts, bool) or parts <= 0:
        raise ValueError("the number of parts must be a positive integer")
    n = rows.count()
    if not n:
        raise ValueError("there is nothing to split")
    size = n // parts
    return rows.where(F.col(ROW) < size * parts).withColumn("part", F.floor(F.col(ROW) / max(size, 1)))


def finished(rows: DataFrame) -> DataFrame:
    """Prompt rows with what may be missing from extra_info: index 0, no tool arguments."""
    has = lambda name: "extra_info" in rows.columns and name in rows.schema["extra_info"].dataType.names
    value = lambda name, default: F.coalesce(F.col(f"extra_info.{name}"), default) if has(name) else default
    empty = F.lit("{}")
    return rows.withColumns({"index": value("index", F.lit(0)), "tools_kwargs": value("tools_kwargs", empty), "interaction_kwargs": value("interaction_kwargs", empty), "raw_prompt": F.col("prompt")})


# sinks
def write_responses(prompts: DataFrame, responses: DataFrame, path: str) -> None:
    """prompts with an array of their responses in order. responses: row_idx, k, response."""
    got = responses.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("k", "response"))).alias("r")).select(ROW, F.col("r.response").alias("responses"))
    prompts.join(got, ROW, "left").drop(ROW).write.mode("overwrite").parquet(path)


def write_dump(rollouts: DataFrame, path: str) -> None:
    """input, output, gts, score and more as JSON lines, a folder per step."""
    rollouts.write.mode("append").partitionBy("step").json(path)


def read_dump(spark: SparkSession, path: str, mask: str | None = None) -> DataFrame:
    """Dumped rollouts by step, with row numbers; `mask`: a pattern of text columns that becomes *; values that are not text as JSON."""
    df = spark.read.json(path)
    for name, kind in df.dtypes:
        if kind == "string" and mask:
            df = df.withColumn(name, F.regexp_replace(name, mask, "*"))
        elif kind.startswith(("struct", "array", "map")):
            df = df.withColumn(name, F.to_json(name))
    return numbered(df, "step", *[c for c in ("input", "output") if c in df.columns], F.monotonically_increasing_id())


def browse(dump: DataFrame, keyword: str | None = None, request: str | None = None, fields: Sequence[str] | None = None, descending: bool = True) -> DataFrame:
    """Rollouts by score (score_1 or 0 where there is none) that hold a keyword or have a request id, hyphens aside."""
    out = dump
    if request is not None:
        bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
        out = out.where(bare(F.col("request_id")) == request.replace("-", ""))
    if keyword is not None:
        texts = [F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(keyword)) for c, k in dump.dtypes if k == "string"]
        out = out.where(F.greatest(*texts, F.lit(False)))
    by = F.coalesce(*(F.col(c) for c in ("score", "score_1") if c in dump.columns), F.lit(0.0))
    out = out.orderBy(by.desc() if descending else by.asc())
    return out.select(*fields) if fields else out


def write_metrics(metrics: DataFrame, path: str) -> None:
    """step and the metrics as JSON lines."""
    metrics.write.mode("append").json(path)


def validation_sample(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows of input, output and score in an order that depends on the input and a seed only."""
    return rows.orderBy(word("input", seed), "input").limit(n)


def newest(names: Sequence[str], keep: int | None = None) -> tuple[str | None, list[str]]:
    """Of folders named global_step_N: the latest, and those that retention drops."""
    steps_ = sorted((int(m[1]), s) for s in names if (m := re.fullmatch(r"global_step_(\d+)", s)))
    return (steps_[-1][1] if steps_ else None), [s for _, s in (steps_[:-keep] if keep else [])]


def replayed(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written if it is not there."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def too_long(length: Column, most: int) -> Column:
    return F.coalesce(length > most, F.lit(True))
