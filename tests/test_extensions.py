"""Functions that users bring."""

import time
from typing import Literal

import pytest
from pyspark.sql import functions as F

from tidemill.functions import extensions as X


def test_load_function(tmp_path):
    (tmp_path / "mine.py").write_text("def score(a, b, scale=1):\n    return scale * (a == b)\n")
    assert X.load_function(str(tmp_path / "mine.py"), "score", scale=3)("x", "x") == 3
    with pytest.raises(FileNotFoundError):
        X.load_function(str(tmp_path / "no.py"), "score")
    with pytest.raises(AttributeError):
        X.load_function(str(tmp_path / "mine.py"), "nope")


def test_limits():
    with pytest.raises(TimeoutError):
        X.limited(0.05)(time.sleep)(1)
    with pytest.raises(ZeroDivisionError):
        X.limited(1)(lambda: 1 / 0)()
    assert X.limited(1)(lambda x: x + 1)(1) == 2


def test_guarded(spark):
    df = spark.createDataFrame([("1", "1"), ("x", "1"), (None, "1")], "a string, b string")
    got = df.withColumn("r", X.guarded(lambda a, b: {"score": int(a) == int(b)})(F.col("a"), F.col("b"))).select("r.*").collect()
    assert [r.score for r in got] == [1.0, 0.0, 0.0] and got[0].error is None and got[1].error.startswith("ValueError")


def test_managers(spark):
    df = spark.createDataFrame([(0.5, 2), (None, 4)], "score double, response_length int")
    assert [r.token_level_scores for r in X.MANAGERS["prime"](df, 4).collect()] == [[0, 0.5, 0, 0], [0, 0, 0, 0]]
    late = X.MANAGERS["dapo"](df.where("score > 0").withColumn("response_length", F.lit(4)), 4, most=4, buffer=2, factor=1.0).first()
    assert late.token_level_scores == [0, 0, 0, -0.5] and late.overlong
    struct = spark.createDataFrame([((1.0, "p"), 1)], "score struct<score double, pred string>, response_length int")
    got = X.MANAGERS["naive"](struct, 2).first()
    assert got.token_level_scores == [1.0, 0] and got.pred == "p"


def test_tools(spark):
    def look(city: str, days: int = 1, unit: Literal["c", "f"] = "c", tags: list[str] | None = None):
        """The weather of a city."""
        return {"city": city, "days": days}, 0.5

    made = X.tool(look)
    f = made.schema["function"]
    assert f["description"] == "The weather of a city." and f["parameters"]["required"] == ["city"]
    assert f["parameters"]["properties"] == {"city": {"type": "string"}, "days": {"type": "integer"}, "unit": {"type": "string", "enum": ["c", "f"]}, "tags": {"type": "array", "items": {"type": "string"}}}
    assert made.call(city="x") == ('{"city": "x", "days": 1}', 0.5, {})
    calls = spark.createDataFrame([('{"city": "y"}',), ("oops",)], "arguments string")
    got = X.tool_results(calls, "look").collect()
    assert got[0].reward == 0.5 and got[0].error is None and got[1].response is None and got[1].error
    with pytest.raises(ValueError):
        X.FunctionTool(lambda *a: a)
    with pytest.raises(TypeError):
        X.FunctionTool(lambda: (1, 2, 3, 4), "four").call()
