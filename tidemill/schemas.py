"""Schemas of the tables, and checks of a table against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGES = "array<struct<role:string,content:string>>"
PROMPTS = f"data_source string, prompt {MESSAGES}, ability string, reward_model struct<style:string,ground_truth:string>, extra_info struct<split:string,index:bigint,answer:string,question:string>"
CHATS = f"messages {MESSAGES}, tools string, enable_thinking boolean"
PREFERENCES = "prompt string, chosen string, rejected string"
RESPONSES = "data_source string, reward_model struct<style:string,ground_truth:string>, responses array<string>"
ROLLOUT_ARRAYS = ("response_mask", "old_log_probs", "rollout_log_probs", "token_level_scores", "token_level_rewards", "advantages", "returns", "values")
DUMPS = "input string, output string, gts string, score double, step bigint"


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def validate(df: DataFrame, required: list[str], aligned: list[str] = (), key: list[str] = ()) -> DataFrame:
    """df, once its columns are checked: required ones there, none named twice. Rows are checked as they are read: `aligned` arrays
    must be of one length, or the query fails; `key`, if given, must be without repeats, which costs a count by key."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("columns named twice")
    present = [c for c in aligned if c in df.columns]
    if len(present) > 1:
        same = F.lit(True)
        for c in present[1:]:
            same = same & (F.size(present[0]) == F.size(c))
        df = df.withColumn(present[0], F.when(same, F.col(present[0])).otherwise(F.raise_error(F.lit(f"arrays of different length among {present}")).cast(df.schema[present[0]].dataType)))
    if key and df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"rows repeat in {list(key)}")
    return df
