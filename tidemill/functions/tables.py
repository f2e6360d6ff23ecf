"""Tools as table functions: calls that give rows, by lateral join, and sessions of a tool with a state, by partition.

Both are polymorphic Python table functions: the schema is worked out when a query is analysed, and a session's function itself asks for its
rows by instance in order of calls. What fails becomes a row that says why.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, UserDefinedTableFunction

from tidemill.functions.extensions import Tool
from tidemill.session import ship


def _row(given: Any, names: list[str]) -> tuple:
    if isinstance(given, dict):
        return tuple(given.get(n) for n in names)
    out = tuple(given) if isinstance(given, (tuple, list)) else (given,)
    if len(out) != len(names):
        raise ValueError(f"a row of {len(out)} values; {len(names)} are taken")
    return out


def rows_function(tool: Callable[..., Iterable[Any]], schema: str | T.StructType | Callable[..., T.StructType]) -> UserDefinedTableFunction:
    """A table function (arguments as JSON, then options) of a tool that gives rows: tuples or mappings of `schema`, which may be a function of the options
    (constants, then). Rows carry `nth`, their number from 0, and `error`; a call that fails gives the rows made before, and one with the error
    and without values. Null arguments give no rows."""
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema  # text is read here, since tasks can't
    fields = lambda options: known(*options) if callable(known) else known

    class Rows:
        @staticmethod
        def analyze(arguments: AnalyzeArgument, *options: AnalyzeArgument) -> AnalyzeResult:
            if not all(o.isConstantExpression for o in options):
                raise ValueError("the options of a tool must be constants")
            own = fields([o.value for o in options])
            return AnalyzeResult(T.StructType([T.StructField("nth", T.IntegerType()), *own.fields, T.StructField("error", T.StringType())]))

        def eval(self, arguments: str, *options: Any) -> Iterator[tuple]:
            if arguments is None:
                return
            names = fields(options).fieldNames()
            n = 0
            try:
                given = json.loads(arguments)
                if not isinstance(given, dict):
                    raise TypeError("arguments must be a JSON object")
                for x in tool(*options, **given):
                    yield (n, *_row(x, names), None)
                    n += 1
            except Exception as e:
                yield (n, *[None] * len(names), f"{type(e).__name__}: {e}")

    return F.udtf(Rows, returnType=None)


def called(calls: DataFrame, function: UserDefinedTableFunction, arguments: Column | str, *options: Any) -> DataFrame:
    """calls with the rows that each gives; a call without rows has none."""
    ship(calls.sparkSession)
    named = calls.withColumn("__arguments", F.col(arguments) if isinstance(arguments, str) else arguments)
    return named.lateralJoin(function(F.col("__arguments").outer(), *map(F.lit, options))).drop("__arguments")


def sessions_function(make: Callable[[], Tool], key: str, order: str) -> UserDefinedTableFunction:
    """A table function of a table with columns key, order and arguments (JSON): a tool's instance for each key, created by its first call, executed for each call in
    order, rewarded and released after the last. Rows: key, order, response, reward and error of each call, and one at the end with a null order and the instance's reward."""

    class Sessions:
        def __init__(self) -> None:
            self.tool, self.instance, self.key = make(), None, None

        @staticmethod
        def analyze(calls: AnalyzeArgument) -> AnalyzeResult:
            if not calls.isTable:
                raise ValueError("calls must be a table")
            kind = {f.name: f.dataType for f in calls.dataType.fields}
            if missing := [c for c in (key, order, "arguments") if c not in kind]:
                raise ValueError(f"missing columns: {missing}")
            fields = [T.StructField(key, kind[key]), T.StructField(order, kind[order]), T.StructField("response", T.StringType()), T.StructField("reward", T.DoubleType()), T.StructField("error", T.StringType())]
            return AnalyzeResult(T.StructType(fields), partitionBy=[PartitioningColumn(key)], orderBy=[OrderingColumn(order)])

        def eval(self, calls: Row) -> Iterator[tuple]:
            self.key, at = calls[key], calls[order]
            try:
                if self.instance is None:
                    self.instance = self.tool.create()
                text, reward, _ = self.tool.execute(self.instance, json.loads(calls["arguments"]))
                yield (self.key, at, text, float(reward or 0.0), None)
            except Exception as e:
                yield (self.key, at, None, 0.0, f"{type(e).__name__}: {e}")

        def terminate(self) -> Iterator[tuple]:
            if self.instance is None:
                return
            try:
                yield (self.key, None, None, float(self.tool.reward(self.instance)), None)
            except Exception as e:
                yield (self.key, None, None, 0.0, f"{type(e).__name__}: {e}")
            finally:
                self.tool.release(self.instance)
                self.instance = None

    return F.udtf(Sessions, returnType=None)


def sessions(calls: DataFrame, make: Callable[[], Tool], key: str, order: str) -> DataFrame:
    """The rows of sessions_function over calls (key, order, arguments and more); rows without a key are one instance."""
    spark: SparkSession = calls.sparkSession
    ship(spark)
    return sessions_function(make, key, order)(calls.select(key, order, "arguments").asTable())


def register(spark: SparkSession, name: str, function: UserDefinedTableFunction) -> None:
    """The function by name in SQL."""
    ship(spark)
    spark.udtf.register(name, function)
