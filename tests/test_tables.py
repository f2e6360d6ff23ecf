"""The table algebra, sharing out, sources, texts, scores, queues."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import scoring as S
from tidemill.functions import text as T
from tidemill.operators import balance as L
from tidemill.operators import dispatch
from tidemill.operators.batch import ROW, Batch, concat, from_rows
from tidemill.schemas import validate
from tidemill.sources import tables as R
from tidemill.streaming import samples as Q


@pytest.fixture
def abc(spark):
    return from_rows(spark, [{"x": 1, "label": "a"}, {"x": 3, "label": "b"}, {"x": 5, "label": "c"}], "x long, label string", {"info": "test"})


def labels(b):
    return "".join(r.label for r in b.rows.orderBy(ROW).collect())


def test_rows(abc):
    assert labels(abc.repeat(2)) == "aabbcc" and labels(abc.repeat(2, interleave=False)) == "abcabc"
    times = Batch(abc.rows.withColumn("n", F.element_at(F.array(F.lit(3), F.lit(0), F.lit(2)), (F.col(ROW) + 1).cast("int"))))
    assert labels(times.repeat_each("n")) == "aaacc"
    padded, extra = abc.pad_to(2)
    assert (labels(padded), extra, labels(padded.unpad(extra))) == ("abca", 1, "abc")
    assert abc.pad_to(3)[1] == 0 and labels(abc.pad_to(8)[0]) == "abcabcab"
    assert labels(abc.padding(2)) == "abccc" and labels(abc.padding(2, first=True)) == "abcaa"
    assert labels(abc.take([2, 0, 0])) == "caa" and labels(abc.take([True, False, True])) == "ac"
    for s in (slice(None, None, -1), slice(1, None), slice(0, 3, 2), slice(-2, None), slice(5, 9), slice(2, 0, -1)):
        assert labels(abc[s]) == "abc"[s]
    assert abc[-1].label == "c" and len(abc) == 3
    for bad, error in (("x", TypeError), (7, IndexError)):
        with pytest.raises(error):
            abc[bad]
    assert [labels(c) for c in abc.chunks(3)] == ["a", "b", "c"]
    for f in (lambda: abc.chunks(2), lambda: abc.mini_batches(2), lambda: abc.fold(2)):
        with pytest.raises(ValueError):
            f()
    assert labels(concat([abc, abc])) == "abcabc"
    assert [r.piece for r in abc.split_ids(2).orderBy(ROW).collect()] == [0, 0, 1]
    assert labels(abc.fold(3).unfold_rows()) == "abc"


def test_columns(abc):
    assert abc.select(["x"]).columns == ["x"] and abc.pop(["x"])[1].columns == ["label"]
    assert abc.rename("x", "y").columns == ["y", "label"]
    with pytest.raises(ValueError):
        abc.rename(["x"], ["y", "z"])
    with pytest.raises(KeyError):
        abc.select(["nope"])
    more = Batch(abc.rows.select(ROW, "x", (F.col("x") * 2).alias("y")), {"other": 1})
    both = abc.union(more)
    assert [r.y for r in both.rows.orderBy(ROW).collect()] == [2, 6, 10] and both.meta == {"info": "test", "other": 1}
    for wrong in (Batch(more.rows.withColumn("x", F.col("x") + 1)), Batch(more.rows.where("x > 1"))):
        with pytest.raises(Exception, match="differ"):
            abc.union(wrong).rows.collect()
    with pytest.raises(ValueError):
        abc.union(Batch(more.rows, {"info": "no"}))


def test_meta_of_metrics(abc):
    a, b = Batch(abc.rows, {"metrics": {"t": 1}, "k": 0}), Batch(abc.rows, {"metrics": [{"t": 2}, {"t": 3, "u": 4}], "k": 0})
    assert concat([a, b]).meta == {"k": 0, "metrics": {"t": [1, 2, 3], "u": [4]}}


def test_unfold_and_padding_rows(spark):
    b = from_rows(spark, [{"v": [1, 2, 3, 4], "w": "p"}, {"v": [5, 6, 7, 8], "w": "q"}], "v array<int>, w string")
    got = [(r.v, r.w) for r in b.unfold(2, ["v"]).rows.orderBy(ROW).collect()]
    assert got == [([1, 2], "p"), ([3, 4], "p"), ([5, 6], "q"), ([7, 8], "q")]
    padded = b.with_padding_rows(4, {"w": F.lit("pad")}).rows.orderBy(ROW).collect()
    assert [r.is_padding for r in padded] == [False, False, True, True] and padded[3].w == "pad"


def test_mini_batches(spark):
    b = from_rows(spark, [{"x": i} for i in range(12)], "x long")
    got = b.mini_batches(4, 2, seed=5).collect()
    for e in (0, 1):
        own = [r for r in got if r.epoch == e]
        assert sorted(r.x for r in own) == list(range(12)) and all(sum(r.mini_batch == k for r in own) == 4 for k in range(3))


def test_save_and_load(abc, tmp_path):
    abc.save(str(tmp_path / "b"))
    again = Batch.load(abc.rows.sparkSession, str(tmp_path / "b"))
    assert labels(again) == "abc" and again.meta == abc.meta


def test_workload():
    assert [L.workload(n) for n in (100, 200, 150, 50)] == [2467600, 4955200, 3708900, 1231300]


@pytest.mark.parametrize("equal", [False, True])
def test_partitions_cover(equal):
    r = random.Random(0)
    for _ in range(30):
        k = r.randint(1, 6)
        n = k * r.randint(1, 8) if equal else r.randint(k, 40)
        loads = [L.workload(r.randint(1, 500)) for _ in range(n)]
        for f in (L.partitions, L.greedy):
            got = f(loads, k, equal)
            assert sorted(i for s in got for i in s) == list(range(n)) and (not equal or {len(s) for s in got} == {n // k})
        assert all(s == sorted(s) and s for s in L.partitions(loads, k, equal))
    with pytest.raises(ValueError):
        L.partitions([1], 2)
    with pytest.raises(ValueError):
        L.differencing([1, 2, 3], 2, equal_size=True)


def test_groups_stay_together():
    lengths, uids = [100] * 4 + [200] * 4 + [150] * 4 + [50] * 4, [u for u in range(4) for _ in range(4)]
    got = L.group_partitions(lengths, uids, 2)
    assert sorted(i for s in got for i in s) == list(range(16)) and all(len({uids[i] for i in s}) == 2 and len(s) == 8 for s in got)


def test_micro_batches():
    r = random.Random(1)
    lengths = [r.randint(1, 300) for _ in range(40)]
    got = L.micro_batches(lengths, 600)
    assert sorted(i for s in got for i in s) == list(range(40))
    together = L.micro_batches(lengths, 600, [i // 4 for i in range(40)])
    where = {i: k for k, s in enumerate(together) for i in s}
    assert all(len({where[4 * g + j] for j in range(4)}) == 1 for g in range(10))
    with pytest.raises(ValueError):
        L.micro_batches([700], 600)
    assert L.required_multiple(4, 6) == 12 and L.ceil_div(7, 2) == 4 and L.round_up(7, 4) == 8


def test_permutation_and_back(spark):
    p = spark.createDataFrame([(0, 2), (1, 0), (2, 1)], "old long, new long")
    b = from_rows(spark, [{"label": c} for c in "abc"], "label string")
    moved = b.reorder(p, "old", "new")
    assert labels(moved) == "bca" and labels(moved.reorder(L.inverse(p, "old", "new"), "old", "new")) == "abc"


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a long, b string").write.parquet(str(tmp_path / "p.parquet"))
    (tmp_path / "q.jsonl").write_text('{"a": 2, "c": "y"}\n{"a": 3, "c": "z"}\n')
    got = R.read_tables(spark, [str(tmp_path / "p.parquet"), str(tmp_path / "q.jsonl")]).orderBy(ROW).collect()
    assert [r.a for r in got] == [1, 2, 3] and [r.c for r in got] == [None, "y", "z"]
    with pytest.raises(ValueError):
        R.read_tables(spark, "x.csv")


def test_sources(spark, tmp_path):
    rows = from_rows(spark, [{"x": i} for i in range(10)], "x long").rows
    assert R.sampled(rows, 4).count() == 4 and R.sampled(rows, 4, True, 1).count() == 4 and R.sampled(rows, -1).count() == 10
    assert sorted(r.x for r in R.ordered(rows, True, 2).collect()) == list(range(10))
    assert R.batches(rows, 4).count() == 8 and R.batches(rows, 4, drop_last=False).count() == 10
    for f in (lambda: R.batches(rows, 11), lambda: R.split(rows, 0), lambda: R.split(rows.limit(0), 2)):
        with pytest.raises(ValueError):
            f()
    assert R.newest(["global_step_2", "global_step_10", "x"], keep=1) == ("global_step_10", ["global_step_2"]) and R.newest([]) == (None, [])
    made = []
    for _ in range(2):
        got = R.replayed(spark, str(tmp_path / "cache"), lambda: (made.append(1), rows)[1])
    assert got.count() == 10 and len(made) == 1
    dump = spark.createDataFrame([("q a-b", "one", 1.0, 1, "r-1"), ("q", "two", 2.0, 2, "r2")], "input string, output string, score double, step long, request_id string")
    R.write_dump(dump, str(tmp_path / "dump"))
    back = R.read_dump(spark, str(tmp_path / "dump"), mask="tw")
    assert [r.output for r in R.browse(back).collect()] == ["*o", "one"] and R.browse(back, keyword="one").count() == 1 and R.browse(back, request="r1").count() == 1
    R.write_responses(rows, spark.createDataFrame([(0, 1, "b"), (0, 0, "a")], f"{ROW} long, k int, response string"), str(tmp_path / "gen"))
    assert spark.read.parquet(str(tmp_path / "gen")).where("x = 0").first().responses == ["a", "b"]


def test_validate(spark):
    df = spark.createDataFrame([(1, [1, 2], [1]), (2, [1], [1])], "id long, a array<int>, b array<int>")
    with pytest.raises(ValueError):
        validate(df, ["nope"])
    with pytest.raises(Exception, match="different length"):
        validate(df, ["a"], aligned=["a", "b"]).collect()
    assert validate(df.where("id = 2"), ["a"], ["a", "b"], ["id"]).count() == 1


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_arrays(spark):
    a = F.array(*map(F.lit, range(1, 7)))
    assert one(spark, T.truncate(a, 4)) == [1, 2, 3, 4] and one(spark, T.truncate(a, 4, "left")) == [3, 4, 5, 6] and one(spark, T.truncate(a, 3, "middle")) == [1, 5, 6]
    with pytest.raises(Exception, match="too long"):
        one(spark, T.truncate(a, 4, "error"))
    assert one(spark, T.pad(a, 8, 0)) == [1, 2, 3, 4, 5, 6, 0, 0] and one(spark, T.pad(a, 8, 0, left=True)) == [0, 0, 1, 2, 3, 4, 5, 6] and one(spark, T.pad(a, 2, 0)) == [1, 2, 3, 4, 5, 6]
    assert one(spark, T.without_left_padding(a, F.array(*map(F.lit, (0, 0, 1, 1, 1, 1))))) == [3, 4, 5, 6]
    assert one(spark, T.response_part(a, F.lit(3), F.lit(2))) == [3, 4] and one(spark, T.placed(F.lit(2.5), F.lit(2), 4)) == [0, 2.5, 0, 0] and one(spark, T.mask_of(F.lit(2), 3)) == [1, 1, 0]


def test_media(spark):
    parts = T.segments(F.lit("look <image> and <image>"))
    assert [(p.type, p.text) for p in one(spark, parts)] == [("text", "look "), ("image", None), ("text", " and "), ("image", None)]
    assert [p.image for p in one(spark, T.with_media(parts, F.array(F.lit("x"), F.lit("y"))))] == [None, "x", None, "y"]
    with pytest.raises(Exception, match="differ in number"):
        one(spark, T.with_media(parts, F.array(F.lit("x"))))


def test_tool_calls(spark):
    types = {"f": {"items": "array", "n": "integer", "x": "number", "ok": "boolean", "o": "object", "s": "string"}}
    text = "hi <tool_call>\n<function=f>\n<parameter=items>\n[1, 2, 3]\n</parameter>\n<parameter=n>7</parameter><parameter=x>2.0</parameter><parameter=ok>TRUE</parameter><parameter=o>{\"a\": 1}</parameter><parameter=s>null</parameter><parameter=u>9</parameter>\n</function>"
    content, calls = T.xml_calls(text, types)
    assert content == "hi " and calls == [{"name": "f", "arguments": {"items": [1, 2, 3], "n": 7, "x": 2, "ok": True, "o": {"a": 1}, "s": None, "u": "9"}}]
    assert T.xml_calls("<function=f><parameter=items>__import__('os').getpid()</parameter></function>", types)[1][0]["arguments"]["items"] == "__import__('os').getpid()"
    channel = '<|start|>assistant<|channel|>commentary to=functions.get_current_weather <|constrain|>json<|message|>{"location": "Tokyo"}<|call|>'
    assert [tuple(c) for c in one(spark, T.channel_calls(F.lit(channel)))] == [("get_current_weather", '{"location": "Tokyo"}')]
    assert T.brace_calls('call:go{to:<|"|>x,y<|"|>,n:3,f:1.5,ok:true,z:null}') == [{"name": "go", "arguments": {"to": "x,y", "n": 3, "f": 1.5, "ok": True, "z": None}}]
    assert T.token_ids({"input_ids": [[1, 2]]}) == [1, 2]
    assert T.template_prefix(lambda m, ask: [9, 9] + [5] * len(m) + [7] * ask) == ([9, 9], [7])


def test_answers(spark):
    g = lambda t, flexible=False: one(spark, S.gsm8k_answer(F.lit(t), flexible))
    assert g("so #### 1,234") == "1234" and g("no") is None and g("is 5 or 7.", True) in ("7.", "7") and g("#### 1 #### -2") == "-2"
    assert S.last_boxed("a \\boxed{\\frac{1}{2}} b \\fbox{x{y}z}") == "x{y}z" and S.last_boxed("\\boxed{a") is None and S.last_boxed("is \\boxed 5$ x") == "5" and S.last_boxed("") is None
    for a, b in (("\\frac12", "\\frac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("x=3/4", "\\frac{3}{4}"), ("\\sqrt3", "\\sqrt{3}"), ("5\\text{ cm}", "5"), (".5", "\\frac{1}{2}"), ("90^\\circ", "90"), ("\\tfrac1{3}", "\\frac{1}{3}")):
        assert S.math_normal(a) == b, a
    assert S.math_score("it is \\boxed{\\dfrac{1}{2}}", "1/2") == 1.0 and S.math_score(None, "1") == 0.0
    matrix = lambda k: rf"\begin{{{k}matrix}}1&2\\3&4\end{{{k}matrix}}"
    assert S.math_equal(matrix("b"), matrix("p")) and S.math_equal("50\\%", "0.5") and S.math_equal("(1, 2)", "(1,2.0)") and not S.math_equal("(1, 2)", "[1,2.0]") and not S.math_equal("(1,2)", "(1,3)")
    assert S.geo3k("<think>x</think> so \\boxed{3}", "3") == pytest.approx(1.0) and S.geo3k("\\boxed{3}", "3") == pytest.approx(0.9)
    assert one(spark, S.passed(F.array(*[F.lit(i < 9) for i in range(11)]), continuous=True)) == pytest.approx(0.9)


def test_tool_rewards():
    a = [{"name": "f", "parameters": {"x": 1}}]
    assert S.tool_call_score(a, a) == 3.0 and S.tool_call_score(a, [{"name": "f", "parameters": {"x": 2}}]) == pytest.approx(1.0) and S.tool_call_score(a, [{"name": "g", "parameters": {}}]) == -3.0
    call = '<tool_call>\n{"name": "f", "parameters": {"x": 1}}\n</tool_call>'
    assert S.tool_reward(f"<|im_start|>assistant\n<think>t</think>\n{call}<|im_end|>", call) == {"score": 4.0, "format_reward": 1.0, "accuracy_reward": 3.0}
    assert S.tool_reward("<|im_start|>assistant nothing<|im_end|>", call)["score"] == -3.0
    assert S.overlap_score(["a", "a"], ["a"]) == 0.5 and S.overlap_score([], []) == 1.0


def test_unknown_source_fails(spark):
    with pytest.raises(Exception, match="no scorer"):
        one(spark, S.route(F.lit("nope"), F.lit("x"), F.lit("y"), ["openai/gsm8k"]))


def test_queue():
    q = Q.BoundedQueue(2)
    assert [q.put(i) for i in range(3)] == [True, True, False] and q.get() == 1
    q.closed = True
    assert q.get() == 2 and q.get() is None and q.stats() == {"size": 0, "produced": 3, "consumed": 2, "dropped": 1, "most": 2}
    gate = Q.Admission(4, 0.5, 2, 3)
    assert gate.most_stale == 12 and gate.paused(3) and not gate.paused(2)
    gate.synced(10, 2)
    assert gate.paused(0)
    assert Q.served([(0, 1), (0, 1), (0, 1), (0, 5)], rate=2, most=2) == pytest.approx([0, 0, 0.5, 1.5])


def test_batches_over_micro_batches(spark, tmp_path):
    from tidemill.streaming.events import run_to_table

    for k in range(3):
        spark.range(k * 5, k * 5 + 5).selectExpr("'s' AS k", "id").write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("k string, id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = run_to_table(Q.count_batches(stream, "k", "id", 4), str(tmp_path / "out")).collect()
    assert len(got) == 12 and len({r.id for r in got}) == 12 and all(sum(r.batch == b for r in got) == 4 for b in range(3))


def test_dispatch(spark):
    df = spark.range(20).withColumn("rank", F.col("id") % 4)
    add = lambda batches: (b.assign(id=b["id"] + 1)[["id"]] for b in batches)
    assert sorted(r.id for r in dispatch.run("dp_compute_proto", df, add, "id long", 3).collect()) == list(range(1, 21))
    shared = lambda batches, k: (b.assign(id=b["id"] * k)[["id"]] for b in batches)
    assert sum(r.id for r in dispatch.run("one_to_all", df, shared, "id long", 2).collect()) == 380
    assert [m["n"] for m in dispatch.run("dp_compute_metric", df, {"n": F.count("*")})] == [5] * 4
    with pytest.raises(ValueError):
        dispatch.run("nope")
