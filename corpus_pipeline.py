"""From raw documents to packed token sequences, in stages that each reread what the one before wrote.

A stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of `documents`. Rows are told
apart by their text or by a number that the stage gives them, never by doc_id: null ids, ids of several texts and repeated rows are rows of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import lines, mixing, nearcopies, packing, quality
from tidemill.llm.queries import tokenizer_path
from tidemill.llm.runtime import WORD, cut, ship, table
from tidemill.session import dropped, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if line dedup leaves it less than this share of its words.
LEAST_LEFT = 0.2

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, in __row; written, so that a row keeps it when a task is run again."""
    return cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")))


def _these(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of the numbers in a table's only column."""
    return rows.join(numbers.toDF("__number"), F.col("__row") == F.col("__number"), "left_semi").select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep. Null and empty texts have no words and go; repeated rows stay or go alike; a null lang is one of its own.

    The verdict follows from text and lang, so rows are known by a hash of both, and nothing need be written for it: should two texts
    have one hash (of 64 bits), both stay if either does."""
    ship(spark)
    rows = docs.select(*COLUMNS, F.xxhash64("text", "lang").alias("__row"))
    return _these(rows, quality.quality(rows.select(F.col("__row").alias("doc_id"), "text", "lang")).where("kept").select("doc_id"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without their recurring lines; one that is left hardly a word goes. n_chars follows the text. Null texts stay null; rows
    without an id stay as they are; repeated rows lose the same lines."""
    done = lines.dedup_lines(docs.select(*COLUMNS, mixing.word_count(F.col("text")).alias("__words")))
    left = (F.col("n_dropped") == 0) | (mixing.word_count(F.col("text")) >= F.greatest(F.lit(1), LEAST_LEFT * F.col("__words")))
    return done.where(left).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity of 0.8 or more), that of least doc_id, null last. Texts
    without words, null ones too, are copies of one another, and so are repeated rows; rows that share an id but not their text stay."""
    ship(spark)
    rows = _rows(docs)
    found = nearcopies.near_copies(rows.select(F.col("__row").alias("doc_id"), "text")).toDF("__of", "component_id")
    groups = rows.select("__row", "doc_id").join(found, F.col("__row") == F.col("__of"))
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))["__row"].alias("first"))
    return _these(rows, first.select("first"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; words beside whole copies are the first ones of the text, joined by spaces. Rows without words are taken 0 times."""
    ship(spark)
    rows = _rows(docs)
    taken = mixing.mix(rows, ["__row"]).where("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    plan = taken.select(F.col("__row").alias("__number"), whole.alias("__whole"), rest.alias("__rest"))
    joined = rows.join(plan, F.col("__row") == F.col("__number"))
    parts = F.concat(F.array_repeat(F.lit(0), F.col("__whole")), F.when(F.col("__rest") > 0, F.array("__rest")).otherwise(F.array().cast("array<int>")))
    made = joined.withColumn("__part", F.explode(parts))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("__part"), F.lit(1))), " ")
    text = F.when(F.col("__part") > 0, part).otherwise(F.col("text"))
    return made.withColumn("n_chars", F.when(F.col("__part") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; a null or empty text is its end alone, and repeated rows are packed each."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet to the shared checkpoint folder and read again; what a stage has read goes after it."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            dropped(spark, f"{top}/{k - 1}")
    return docs
