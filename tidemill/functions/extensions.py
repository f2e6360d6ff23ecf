"""Functions that users bring: reward functions from files, tools with schemas, limits of time, scores that may fail."""

from __future__ import annotations

import importlib.util
import inspect
import json
import threading
import typing
import uuid
from collections.abc import Callable
from functools import partial, wraps
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.registry import Registry
from tidemill.functions.text import placed

TOOLS = Registry("tool")
MANAGERS = Registry("reward manager")
KINDS = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}


def load_function(path: str, name: str, **fixed: Any) -> Callable[..., Any]:
    """A function of a Python file, some of its arguments fixed."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name!r}")
    f = getattr(module, name)
    return partial(f, **fixed) if fixed else f


def limited(seconds: float) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """A function that fails with TimeoutError when it takes longer; what it began may still run."""

    def wrap(f: Callable[..., Any]) -> Callable[..., Any]:
        @wraps(f)
        def run(*args: Any, **named: Any) -> Any:
            out: dict[str, Any] = {}

            def work() -> None:
                try:
                    out["value"] = f(*args, **named)
                except BaseException as e:
                    out["error"] = e

            t = threading.Thread(target=work, daemon=True)
            t.start()
            t.join(seconds)
            if t.is_alive():
                raise TimeoutError(f"{getattr(f, '__name__', 'function')} took more than {seconds} s")
            if "error" in out:
                raise out["error"]
            return out["value"]

        return run

    return wrap


def guarded(f: Callable[[str, str], Any], seconds: float | None = None, timeout_score: float = 0.0) -> Callable[[Column, Column], Column]:
    """A column function to struct<score, error>: a row that fails scores 0, one that takes more than so many seconds timeout_score, and each says why."""

    @F.pandas_udf("score double, error string")
    def run(text: pd.Series, truth: pd.Series) -> pd.DataFrame:
        once = limited(seconds)(f) if seconds else f
        rows = []
        for a, b in zip(text, truth, strict=True):
            try:
                got = once(a, b)
                rows.append((float(got["score"] if isinstance(got, dict) else got), None))
            except Exception as e:
                rows.append((timeout_score if isinstance(e, TimeoutError) else 0.0, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["score", "error"])

    return run


# reward managers: rows with `score` (a number or a struct with one), response_length -> rows with token_level_scores
def _number(rows: DataFrame) -> tuple[DataFrame, Column]:
    if "score" in rows.columns and rows.schema["score"].dataType.typeName() == "struct":
        fields = rows.schema["score"].dataType.names
        rows = rows.select(*(c for c in rows.columns if c != "score"), *(F.col(f"score.{n}").alias(n) for n in fields))
    return rows, F.col("score").cast("double")


@MANAGERS.register("naive")
def naive(rows: DataFrame, width: int) -> DataFrame:
    """The score at the last valid token; fields beside it become columns."""
    rows, score = _number(rows)
    return rows.withColumn("token_level_scores", placed(score, "response_length", width))


MANAGERS.register("batch")(naive)


@MANAGERS.register("prime")
def prime(rows: DataFrame, width: int) -> DataFrame:
    """As naive; a row that could not be scored counts 0."""
    rows, score = _number(rows)
    return rows.withColumn("token_level_scores", placed(F.coalesce(score, F.lit(0.0)), "response_length", width))


@MANAGERS.register("dapo")
def dapo(rows: DataFrame, width: int, most: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """As naive, less a penalty for responses that reach into the buffer before the greatest length."""
    from tidemill.functions.scoring import overlong_penalty

    rows, score = _number(rows)
    penalty = overlong_penalty(F.col("response_length"), most, buffer, factor)
    return rows.withColumns({"overlong_reward": penalty, "overlong": penalty < 0, "token_level_scores": placed(score + penalty, "response_length", width)})


@MANAGERS.register("gdpo")
def gdpo(rows: DataFrame, width: int, keys: list[str]) -> DataFrame:
    """As naive; each score component that the estimator asks for must be there, beside the score."""
    rows, score = _number(rows)
    if missing := [k for k in keys if k not in rows.columns]:
        raise ValueError(f"no score components {missing}; there are {rows.columns}")
    return rows.withColumn("token_level_scores", placed(score, "response_length", width))


def last_outputs(rows: DataFrame, key: str = "sample_id", order: str = "turn") -> DataFrame:
    """Of a sample's several outputs the last one, which is scored for all."""
    last = rows.groupBy(F.col(key).alias("__k")).agg(F.max(order).alias("__o"))
    return rows.join(last, (F.col(key) == F.col("__k")) & (F.col(order) == F.col("__o")), "left_semi")


# tools
def _kind(hint: Any) -> dict[str, Any]:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin is typing.Literal:
        return {"type": KINDS.get(type(args[0]), "string"), "enum": list(args)}
    if origin is list and args:
        return {"type": "array", "items": _kind(args[0])}
    known = [a for a in args if a is not type(None)]
    if args and origin is not dict and len(known) == 1:
        return _kind(known[0])
    return {"type": KINDS.get(origin or hint, "string")}


class FunctionTool:
    """A function with a schema from its signature; call() gives text, reward and metrics."""

    def __init__(self, f: Callable[..., Any], name: str | None = None):
        self.f, self.name = f, name or f.__name__
        hints, fields, needed = typing.get_type_hints(f), {}, []
        for p in inspect.signature(f).parameters.values():
            if p.kind in (p.VAR_POSITIONAL, p.VAR_KEYWORD):
                raise ValueError(f"{self.name} takes any number of arguments; a schema needs them named")
            fields[p.name] = _kind(hints.get(p.name, str))
            if p.default is p.empty:
                needed.append(p.name)
        about = (inspect.getdoc(f) or "").split("\n\n")[0]
        self.schema = {"type": "function", "function": {"name": self.name, "description": about, "parameters": {"type": "object", "properties": fields, "required": needed}}}

    def call(self, **arguments: Any) -> tuple[str, float, dict[str, Any]]:
        got = self.f(**arguments)
        if not isinstance(got, tuple):
            got = (got,)
        if not 1 <= len(got) <= 3:
            raise TypeError(f"{self.name} gave {len(got)} values; one to three are taken")
        text, reward, metrics = (*got, *(None, 0.0, {})[len(got) :])
        return text if isinstance(text, str) else json.dumps(text), float(reward or 0.0), dict(metrics or {})


class Tool:
    """A tool with a state of its own for each instance: create, execute as often as wanted, release."""

    schema: dict[str, Any] = {}

    def __init__(self) -> None:
        self.held: dict[str, dict[str, Any]] = {}

    def create(self, instance: str | None = None, **given: Any) -> str:
        name = instance or uuid.uuid4().hex
        self.held[name] = dict(given)
        return name

    def execute(self, instance: str, arguments: dict[str, Any]) -> tuple[str, float, dict[str, Any]]:
        raise TypeError(f"{type(self).__name__} does not say what it does")

    def reward(self, instance: str) -> float:
        return 0.0

    def release(self, instance: str) -> None:
        self.held.pop(instance, None)


def tool(f: Callable[..., Any]) -> FunctionTool:
    """Register a function as a tool under its name."""
    made = FunctionTool(f)
    TOOLS.register(made.name)(made)
    return made


def tool_results(calls: DataFrame, name: str, arguments: str = "arguments") -> DataFrame:
    """calls with response, reward and error of the named tool, its arguments being JSON text."""
    made = TOOLS[name]

    @F.pandas_udf("response string, reward double, error string")
    def run(args: pd.Series) -> pd.DataFrame:
        rows = []
        for a in args:
            try:
                text, reward, _ = made.call(**json.loads(a))
                rows.append((text, reward, None))
            except Exception as e:
                rows.append((None, 0.0, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["response", "reward", "error"])

    return calls.withColumn("__r", run(F.col(arguments))).select("*", "__r.*").drop("__r")
