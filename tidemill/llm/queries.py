"""The registered queries over these operators, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import clusters, embeddings, langid, licenses, lines, lmscore, mixing, packing, quality, search, simhash, substrings, tokencount
from tidemill.llm.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), remainder(4) != 2)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"), F.size("licenses").cast("long").alias("n_licenses"), "sentence_ids", "licenses", "rule_sizes", "starts")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "extra")


def op10_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lmscore.score(table(spark, sf_dir, "documents"), remainder(5) == 1)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return found.withColumn("bits_per_byte", bits)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_langid": op1_langid,
    "op2_embeddings": op2_embeddings,
    "op3_licenses": op3_licenses,
    "op4_lines": op4_lines,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_substrings": op7_substrings,
    "op8_simhash": op8_simhash,
    "op9_mixing": op9_mixing,
    "op10_lmscore": op10_lmscore,
    "op11_search": op11_search,
    "op12_clusters": op12_clusters,
    "op13_tokens": op13_tokens,
}

ORACLE_SQL: dict[str, str] = {
    "op4_lines": lines.ORACLE,
    "op11_search": search.ORACLE,
    "op12_clusters": clusters.oracle(),
}
