"""Rollout tables derived from the sample tables: a sequence is an order, a token a line item, a prompt group a customer.

The same definitions as DuckDB SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, uid, data_source: also orders without line items (aborted ones)."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq_id"), F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("data_source"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """A row per token: seq_id, pos from 0, mask, reward, value, and log probabilities of four policies."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"),
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
        (F.col("l_discount") - 0.05).alias("reward"),
        (F.col("l_quantity") / 50).alias("value"),
        (-(F.col("l_tax") * 5 + 0.01)).alias("old_lp"),
        (-(F.col("l_discount") * 5 + 0.01)).alias("rollout_lp"),
        (-(F.col("l_tax") * 4 + F.col("l_discount") + 0.02)).alias("new_lp"),
        (-(F.col("l_discount") * 3 + F.col("l_tax") + 0.02)).alias("ref_lp"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """seq_id, uid, data_source, score (sum of all rewards), length (sum of the mask), n_tokens: a row per sequence, 0 for one without tokens."""
    sums = tokens(spark, d).groupBy("seq_id").agg(F.sum("reward").alias("s"), F.sum("mask").alias("l"), F.count("*").alias("n"))
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t)
    return sequences(spark, d).join(sums, "seq_id", "left").select("seq_id", "uid", "data_source", F.round(zero("s", "double"), 6).alias("score"), zero("l", "long").alias("length"), zero("n", "long").alias("n_tokens"))


def grouped_tokens(spark: SparkSession, d: str) -> DataFrame:
    """tokens with uid and data_source."""
    return tokens(spark, d).join(sequences(spark, d), "seq_id")


#: Common table expressions with the views above: seq, tok (with uid and data_source) and sc.
VIEWS = """WITH seq AS (SELECT o_orderkey AS seq_id, o_custkey AS uid, o_orderpriority AS data_source FROM orders),
tok AS (
  SELECT l.*, s.uid, s.data_source FROM (
    SELECT l_orderkey AS seq_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS pos,
      CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS mask, l_discount - CAST(0.05 AS DOUBLE) AS reward, l_quantity / 50 AS value,
      -(l_tax * 5 + CAST(0.01 AS DOUBLE)) AS old_lp, -(l_discount * 5 + CAST(0.01 AS DOUBLE)) AS rollout_lp,
      -(l_tax * 4 + l_discount + CAST(0.02 AS DOUBLE)) AS new_lp, -(l_discount * 3 + l_tax + CAST(0.02 AS DOUBLE)) AS ref_lp
    FROM lineitem) l JOIN seq s USING (seq_id)),
sc AS (
  SELECT s.seq_id, s.uid, s.data_source, round(coalesce(t.s, CAST(0 AS DOUBLE)), 6) AS score, CAST(coalesce(t.l, 0) AS BIGINT) AS length, CAST(coalesce(t.n, 0) AS BIGINT) AS n_tokens
  FROM seq s LEFT JOIN (SELECT seq_id, sum(reward) AS s, sum(mask) AS l, count(*) AS n FROM tok GROUP BY seq_id) t USING (seq_id))
"""
