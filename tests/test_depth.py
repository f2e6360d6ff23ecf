"""Symbolic equality, sources of their own, state by element, shared prefixes, deals of large steps, resampled metrics."""

import pytest

from tidemill.functions import scoring as S
from tidemill.functions.formulas import identical, read

SAME = [
    ("x^2 + y^2 + 4x - 6y + 13", "(x + 2)^2 + (y - 3)^2 "), ("\\frac{1}{x-1}-\\frac1{x+1}", "\\frac{2}{x^2-1}"), ("2\\sqrt{2}x", "\\sqrt{8}x"), ("\\sin^2 x+\\cos^2 x", "1"), ("\\sin 2x", "2\\sin x\\cos x"), ("(1+i)^2", "2i"),
    ("e^{2x}", "(e^x)^2"), ("|x-1|", "|1-x|"), ("x^{-1}", "1/x"), ("\\sqrt[3]{x}", "x^{1/3}"), ("x_1+x_{2}", "x_2+x_1"), ("(x+1)^{50}(x-1)^{50}", "(x^2-1)^{50}"), ("3!x", "6x"), ("2^{x+1}", "2\\cdot 2^x"), ("\\frac{\\pi}{2}r", "0.5\\pi r"),
    ("x^{y^2}", "x^{(y^2)}"), ("\\cos(x)^2", "\\cos^2(x)"), ("4^{1000}", "2^{2000}"), ("+".join(["x"] * 3000), "3000x"), ("(" * 4000 + "x" + ")" * 4000, "x"), ("x^{10^9}", "x^{1000000000}"), ("abc", "cba"), ("word+1", "1+word"), ("xy+xz+yz", "x(y+z)+yz"),
    ("\\left(x+1\\right)\\dfrac{1}{2}", "\\tfrac{x}{2}+\\frac12"), ("-x^2", "-(x^2)"), ("(a+b+c)^2", "a^2+b^2+c^2+2ab+2bc+2ca"),
]
OTHER = [
    ("x+1", "1+y"), ("\\sqrt{x^2}", "x"), ("-x^2", "(-x)^2"), ("\\ln(xy)", "\\ln x+\\ln y"), ("x", ""), ("(", "("), ("x+", "x"), ("0/0", "1"), ("x/(y-y)", "x/(y-y)"), ("solution", "nosolution"), ("left", "felt"), ("x)", "x"), ("x_", "x"), ("{x", "x"), ("import os; os", "1"),
    ("(x+1)^{60}", "(x+1)^{60}+10^{-30}x"), ("\\frac{x}", "x"), ("\\sqrt[3", "x"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_the_same_function(a, b):
    assert identical(a, b) and identical(b, a)


@pytest.mark.parametrize("a,b", OTHER)
def test_another_function(a, b):
    assert not identical(a, b) and not identical(b, a)


def test_symbolic_answers():
    matrix = "\\begin{%s}\n -7 & 6 & -8 \\\\\n 11 & -9 & 12 \\\\\n 15 & -16 & 19 \n \\end{%s}"
    assert S.answer_match(matrix % ("bmatrix", "bmatrix"), matrix % ("pmatrix", "pmatrix")) == 1
    assert S.answer_match("\\frac{\\sqrt{505}}{7}", "\\frac{\\sqrt{505}}{7}") == 1
    assert S.answer_match("x^2 + y^2 + 4x - 6y + 13", "(x + 2)^2 + (y - 3)^2 ") == 1
    assert S.answer_match("so \\boxed{y = (x-1)(x+1)}", "x^2-1") == 1 and S.answer_match("\\boxed{x^2+1}", "x^2-1") == 0
    assert S.answer_match("\\boxed{(x+1, \\sin 2t)}", "(1+x, 2\\sin t\\cos t)") == 1


def test_reading_is_linear_and_sound():
    import random
    import time

    r, parts = random.Random(3), ["x", "12", "+", "-", "*", "/", "^", "(", ")", "\\frac", "{", "}", "\\sqrt", "[", "]", "\\sin", "|", "!", "_1", "\\pi", " ", "=", ",", "ab"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        identical(t, t)  # whatever it is, it ends without an error
    began = time.perf_counter()
    assert identical("+".join(["\\sqrt[3]{x}\\sin^2 x"] * 4000), "4000\\sin^2(x)\\sqrt[3]{x}") and read("(" * 50000) is None
    assert time.perf_counter() - began < 10


# datasets
CHAT = "id bigint, role string, score double, tags array<string>, extra struct<a:bigint,b:string>, absent string"


@pytest.fixture(scope="module")
def chat(spark, tmp_path_factory):
    rows = [(i, ["user", "assistant", "tool", None][i % 4], None if i % 7 == 0 else i / 4 if i % 11 else float("nan"), [f"t{i % 3}"] * (i % 3), {"a": i, "b": f"é {i}"}) for i in range(500)]
    df = spark.createDataFrame(rows, CHAT.removesuffix(", absent string"))
    folder = tmp_path_factory.mktemp("chat")
    df.repartition(3, "id").write.option("parquet.block.size", "1024").parquet(str(folder / "p.parquet"))
    df.where("score IS NULL OR NOT isnan(score)").repartition(3, "id").write.json(str(folder / "l.jsonl"))
    return df, folder


@pytest.mark.parametrize("split", [1 << 20, 777, 50])
def test_rows_in_parts(spark, chat, split):
    from tidemill.sources.datasets import read_dataset

    df, folder = chat
    got = read_dataset(spark, path=f"{folder}/p.parquet", schema=CHAT, splitBytes=split)
    assert got.rdd.getNumPartitions() >= (3 if split > 1000 else 6)
    assert sorted(map(repr, got.drop("absent").collect())) == sorted(map(repr, df.collect())) and got.where("absent IS NOT NULL").count() == 0
    lines = read_dataset(spark, path=f"{folder}/l.jsonl/part-*".replace("/part-*", ""), schema=CHAT, splitBytes=split)
    assert sorted(map(repr, lines.drop("absent").collect())) == sorted(map(repr, df.where("score IS NULL OR NOT isnan(score)").collect()))
    assert dict(read_dataset(spark, path=f"{folder}/p.parquet").dtypes) == dict(df.dtypes)


@pytest.mark.parametrize("rule", ["id = 7", "id > 100 AND role IN ('user', 'tool')", "role IS NULL", "role IS NOT NULL AND NOT role = 'tool'", "role LIKE 'us%'", "score > 20", "score <= 3 AND id < 90", "extra.a = 5", "id % 2 = 0", "id = 3 OR role = 'tool'", "role <=> NULL", "role NOT IN ('user', 'tool')", "role > 'b'"])
def test_filters_mean_the_same(spark, chat, rule):
    from tidemill.sources.datasets import read_dataset

    df, folder = chat
    got = read_dataset(spark, path=f"{folder}/p.parquet", schema=CHAT, splitBytes=900).where(rule).select("id")
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in df.where(rule).select("id").collect())


def test_filters_go_down(spark, chat):
    from pyspark.sql import datasource as D

    from tidemill.sources import datasets as R

    _, folder = chat
    df = R.read_dataset(spark, path=f"{folder}/p.parquet", schema=CHAT).where("id = 7 AND score > 1")
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed, rest = plan.split("PushedFilters: ")[1].split("\n")[0], plan.split("Condition : ")[1].split("\n")[0]
    assert "EqualTo(id,7)" in pushed and "GreaterThan(score" not in pushed and "score" in rest and "id#" not in rest
    reader = R.RowReader({"path": f"{folder}/p.parquet"}, R.T.StructType.fromDDL(CHAT))
    own = [D.EqualTo(("id",), 7), D.GreaterThan(("score",), 1.5), D.EqualTo(("extra", "a"), 1)]
    assert list(reader.pushFilters(own)) == own[1:]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1


def test_a_dataset_of_ones_own(spark, tmp_path):
    from tidemill.sources.datasets import dataset_class, read_dataset

    (tmp_path / "own.py").write_text("""
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

class Reader(DataSourceReader):
    def __init__(self, n): self.n = n
    def partitions(self): return [InputPartition(k) for k in range(self.n)]
    def read(self, p): yield (p.value, f"prompt {p.value}")

class Prompts(DataSource):
    @classmethod
    def name(cls): return "own_prompts"
    def schema(self): return "id bigint, prompt string"
    def reader(self, schema): return Reader(int(self.options["n"]))

class Other: pass
""")
    got = read_dataset(spark, "Prompts", file=str(tmp_path / "own.py"), n=4)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [(k, f"prompt {k}") for k in range(4)]
    with pytest.raises(TypeError):
        dataset_class("Other", str(tmp_path / "own.py"))
    with pytest.raises(ValueError):
        dataset_class("unheard of")


def test_rows_as_they_come(spark, chat, tmp_path):
    from tidemill.sources.datasets import read_dataset
    from tidemill.streaming.events import run_to_table

    path, out = tmp_path / "dumps", f"{tmp_path}/out"
    path.mkdir()
    run = lambda: run_to_table(read_dataset(spark, path=str(path), schema="id bigint, role string", stream=True, splitBytes=30), out)
    assert run().count() == 0
    for k in range(3):
        (path / f"{k:03d}.jsonl").write_text("".join(f'{{"id": {10 * k + i}, "role": "r{i}", "more": [1]}}\n' for i in range(5)))
        (path / "_hidden.jsonl").write_text('{"id": -1}\n')
        got = sorted(r["id"] for r in run().collect())
        assert got == [10 * j + i for j in range(k + 1) for i in range(5)]
    assert run().count() == 15
    (path / "009.jsonl").write_text('{"id": 99, "role": null}')  # no line end
    assert run().where("id = 99 AND role IS NULL").count() == 1


# state by element
def stream_of(spark, folder, schema, *batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def at(hours):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


def test_replay_waits_for_steps(spark, tmp_path):
    from tidemill.streaming.events import run_to_table
    from tidemill.streaming.state import released

    schema = "at timestamp, partition_id string, key string, step int, status string, extra int"
    row = lambda h, key, step, status, part="train": (at(h), part, key, step, status, 0)
    out = run_to_table(released(stream_of(
        spark, tmp_path, schema,
        # tags out of order: b's running comes after its success, c is removed before it succeeds late
        [row(2, "b", 1, "success"), row(1, "b", 1, "running"), row(1, "a", 1, "running"), row(4, "c", 1, "removed"), row(3, "c", 1, "success"), row(1, "x", 2, "running"), row(1, "v", 1, "success", "val"), (None, "train", "n", 1, "success", 0), row(1, None, 1, "success"), row(1, "odd", 1, "paused")],
        # step 1 of train still runs when the watermark passes; step 1 of val goes
        [row(11, "y", 3, "running")],
        [row(12, "a", 1, "success"), row(12, "d", 1, "failure"), row(13, "y", 3, "success"), row(13, "y", 3, "success")],
        # late: behind the watermark, so it is dropped; x never ends
        [row(5, "late", 1, "success"), row(24, "z", 4, "running")],
        # step 1 begins anew after its release; a stays, and 24 + 6 hours pass for z
        [row(25, "e", 1, "success"), row(26, "z", 4, "success")],
        [row(60, "w", 9, "running")],
    )), f"{tmp_path}/out")
    got = sorted(map(tuple, out.collect()))
    assert got == [("train", 1, "a"), ("train", 1, "b"), ("train", 1, "e"), ("train", 3, "y"), ("train", 4, "z"), ("val", 1, "v")]


def test_queues_and_batches_by_element(spark, tmp_path):
    from tidemill.streaming.events import run_to_table
    from tidemill.streaming.state import full_batches, queues

    schema = "k string, item long, n int"
    batches = [[("a", 3, 0), ("a", 1, 0), ("b", 9, 0)], [("a", 2, 0), (None, 4, 0), ("b", None, 0)], [("a", i, 0) for i in range(10, 30)], [("a", 40, 0), ("b", 5, 0), (None, 6, 0)]]
    got = run_to_table(queues(stream_of(spark, tmp_path / "q", schema, *batches), "k", "item", 4), f"{tmp_path}/q/out", "update", ["k"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", 4, 24, 20, 27, 40), ("b", 2, 2, 0, 9, 5), (None, 2, 2, 0, 4, 6)], key=repr)
    one = run_to_table(queues(stream_of(spark, tmp_path / "q1", schema, *batches), "k", "item", 1), f"{tmp_path}/q1/out", "update", ["k"])
    assert {(r.k, r.size, r.oldest, r.newest) for r in one.collect()} == {("a", 1, 40, 40), ("b", 1, 5, 5), (None, 1, 6, 6)}
    full = run_to_table(full_batches(stream_of(spark, tmp_path / "b", schema, *batches), "k", "item", 3), f"{tmp_path}/b/out")
    rows = sorted((r.k, r.batch, r.item) for r in full.collect())
    assert [x[2] for x in rows] == [1, 2, 3, *range(10, 30), 40][:24] and [x[1] for x in rows] == [i // 3 for i in range(24)] and {x[0] for x in rows} == {"a"}
    for make in (queues, full_batches):
        with pytest.raises(ValueError):
            make(spark.readStream.format("rate").load().selectExpr("value AS k", "value AS item"), "k", "item", 0)


# shared prefixes
def brute_forest(seqs):
    """kind, group, tokens, n, length, parent_length from every prefix of every sequence."""
    from collections import Counter, defaultdict

    count = Counter((g, tuple(t or ())) for g, t in seqs)
    after = defaultdict(Counter)
    for (g, t), n in count.items():
        for k in range(1, len(t) + 1):
            after[g, t[:k]][("end", 0) if k == len(t) else ("next", t[k])] += n if k == len(t) else 0
    nodes = {p for p, c in after.items() if sum(max(1, n) if kind == "end" else 1 for (kind, _), n in c.items()) >= 2}
    parent = lambda g, t, most: max((k for k in range(1, most + 1) if (g, t[:k]) in nodes), default=0)
    out = [("sequence", g, list(t), n, len(t), parent(g, t, len(t))) for (g, t), n in count.items()]
    return sorted(out + [("prefix", g, list(t), 0, len(t), parent(g, t, len(t) - 1)) for g, t in nodes], key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_prefix_forest(spark, parts):
    import random

    from tidemill.operators.prefixes import prefix_forest, prefix_savings

    r = random.Random(parts)
    stems = [[r.randrange(3) for _ in range(r.randint(0, 9))] for _ in range(12)]
    seqs = [(r.choice(["a", "b", None]), r.choice(stems) + [r.choice([0, 1, 2, None]) for _ in range(r.randint(0, 4))]) for _ in range(400)]
    seqs += [("a", None), ("a", []), ("b", []), ("c", [1] * 300), ("c", [1] * 301), ("c", [1] * 301), ("hot", [5, 6, 7])] + [("hot", [5, 6, 7, 8])] * 50
    df = spark.createDataFrame([(g, t, 0, "x") for g, t in seqs], "part string, ids array<int>, shared int, g string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        forest = prefix_forest(df, "ids", ["part"]).collect()
        saved = {x.part: (x.n, x.tokens, x.kept, x.saved) for x in prefix_savings(prefix_forest(df, "ids", ["part"]), ["part"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, forest), key=repr) == brute_forest(seqs)
    for g in ("a", "b", "c", "hot", None):
        own = [tuple(t or ()) for h, t in seqs if h == g]
        kept = len({t[:k] for t in own for k in range(1, len(t) + 1)})
        assert saved[g] == (len(own), sum(map(len, own)), kept, sum(map(len, own)) - kept)


def test_prefix_forest_of_texts_and_nothing(spark):
    from tidemill.operators.prefixes import prefix_forest

    df = spark.createDataFrame([(["a", "b"],), (["a", "c"],), ([],)], "words array<string>")
    assert sorted(map(tuple, prefix_forest(df, "words").collect())) == sorted([("sequence", [], 1, 0, 0), ("sequence", ["a", "b"], 1, 2, 1), ("sequence", ["a", "c"], 1, 2, 1), ("prefix", ["a"], 0, 1, 0)])
    assert prefix_forest(df.limit(0), "words").count() == 0




# deals of large steps
def parts_of(df, spread_of="load"):
    out = {}
    for r in df.collect():
        out.setdefault(r.step, {}).setdefault(r.part, []).append((r.key, r.load))
    return out


def test_differencing_breaks_ties_by_the_heaviest_set():
    from tidemill.operators.balance import differencing

    assert [sum([8, 7, 6, 5, 4][i] for i in s) for s in differencing([8, 7, 6, 5, 4], 2)] == [16, 14]
    a, b = [[(5, 1, (0,)), (5, 1, (1,))], [(9, 1, (2,)), (9, 1, (3,))]]
    from tidemill.operators.balance import joined, state

    assert joined([state(a, 2), state(b, 2)])[0][2] == (3, 0)  # the state of nines comes first


@pytest.mark.parametrize("equal", [False, True])
def test_large_steps_are_dealt_within_the_bound(spark, equal):
    import random

    from pyspark.sql import functions as F

    from tidemill.operators.balance import differencing
    from tidemill.operators.deal import dealt

    r = random.Random(4)
    rows = [(0, i, r.randint(1, 10**6)) for i in range(2100)] + [(1, i, r.choice([1, 1000])) for i in range(35)] + [(None, i, i + 1) for i in range(700)] + [(3, i, 10**9 if i == 0 else 1) for i in range(350)]
    df = spark.createDataFrame([(s, k, w, 0, 0) for s, k, w in rows], "step int, key long, w long, part int, bucket int").repartition(5)
    got = parts_of(dealt(df, "step", 7, load=F.col("w"), key="key", equal_size=equal, bucket=100, fan=4))
    for s in (0, 1, None, 3):
        own = {k: w for t, k, w in rows if t == s}
        sums = [sum(w for _, w in p) for _, p in sorted(got[s].items())]
        assert sorted(k for p in got[s].values() for k, _ in p) == sorted(own) and sorted(got[s]) == list(range(7))
        assert sums == sorted(sums, reverse=True) and sums[0] - sums[-1] <= max(own.values())
        if equal:
            assert {len(p) for p in got[s].values()} == {len(own) // 7}
    assert [sorted(k for k, _ in got[1][p]) for p in range(7)] == differencing([w for t, _, w in rows if t == 1], 7, equal)
    big = sorted(sum(w for _, w in p) for p in got[0].values())
    assert (big[-1] - big[0]) * (10 if equal else 100) < 10**6  # far better than the bound


def test_deals_that_cannot_be(spark):
    from pyspark.sql import functions as F

    from tidemill.operators.deal import dealt, micro_dealt

    df = spark.createDataFrame([(0, i, 10) for i in range(9)], "step int, row_idx long, seqlen long")
    for k, equal in ((10, False), (4, True)):
        with pytest.raises(ValueError):
            dealt(df, "step", k, equal_size=equal)
    assert dealt(df.limit(0), "step", 4).count() == 0 and micro_dealt(df.limit(0), "step", 100).count() == 0
    with pytest.raises(ValueError):
        micro_dealt(df, "step", 9)
    floats = dealt(df.withColumn("seqlen", F.col("seqlen") / 4), "step", 3, load=F.col("seqlen"))
    assert [r[0] for r in floats.groupBy("part").agg(F.sum("load")).select("sum(load)").collect()] == [7.5] * 3


def test_micro_batches_of_large_steps(spark):
    import random

    from tidemill.operators.balance import workload
    from tidemill.operators.deal import micro_dealt

    r = random.Random(6)
    rows = [(s, 1000 * s + i, r.randint(1, 500), None if i < 3 else i // 3) for s in range(2) for i in range(900)]
    df = spark.createDataFrame(rows, "step int, row_idx long, seqlen long, uid int")
    got = micro_dealt(df, "step", 2048, group="uid", bucket=200).join(df, ["step", "row_idx"]).collect()
    assert len(got) == len(rows)
    shards, batches, homes = {}, {}, {}
    for x in got:
        shards[x.step, x.shard] = shards.get((x.step, x.shard), 0) + workload(x.seqlen)
        batches[x.step, x.shard, x.micro_batch] = batches.get((x.step, x.shard, x.micro_batch), 0) + x.seqlen
        homes.setdefault((x.step, x.uid), set()).add((x.shard, x.micro_batch))
    assert all(len(h) == 1 for h in homes.values()) and len(shards) == 10
    heaviest = max(sum(workload(n) for s, _, n, u in rows if (s, u) == g) for g in homes)
    for s in range(2):
        own = [w for (t, _), w in shards.items() if t == s]
        assert max(own) - min(own) <= heaviest
    assert max(batches.values()) <= 2048 + 1500 and sum(v <= 2048 for v in batches.values()) > 0.5 * len(batches)


# resampled metrics
def test_draws_are_the_same_everywhere(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tidemill.operators import resampling as R

    got = spark.range(20).select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")), lambda j: R.place(F.col("id"), j, F.lit(13).cast("long"), 5)).alias("at")).collect()
    want = R.places(13, 7, 20, 5)
    assert np.array_equal(np.array([r.at for r in got]), want) and 0 <= want.min() and want.max() < 13
    many = R.places(4, 4, 3000, 1)
    assert abs(np.bincount(many.ravel(), minlength=4) / many.size - 0.25).max() < 0.01


def test_majority_by_places_is_the_rule():
    import random

    import numpy as np

    from tidemill.operators.metrics import majority
    from tidemill.operators.resampling import majority_values

    r = random.Random(8)
    for _ in range(50):
        n, k = r.randint(1, 9), r.randint(1, 9)
        votes, values = [r.randrange(3) for _ in range(n)], [r.random() for _ in range(n)]
        at = np.array([[r.randrange(n) for _ in range(k)] for _ in range(20)])
        want = [majority([votes[i] for i in row], [values[i] for i in row]) for row in at.tolist()]
        assert majority_values(np.array(values), np.array(votes), at).tolist() == want


def test_validation_draws(spark):
    import math
    import random

    from tidemill.operators import metrics as M

    r = random.Random(2)
    rows = [(s, f"{s}{u}", i, None if i == 9 and u == 0 else r.choice([0.0, 0.5, 1.0, r.random()]), r.choice(["A", "B", None])) for s in "xy" for u in range(4) for i in range([10, 1, 2, 7][u])]
    df = spark.createDataFrame(rows, "data_source string, uid string, order int, acc double, pred string")
    run = lambda **k: {(x.data_source, x.metric): x.value for x in M.validation_metrics(df, ["acc"], "pred", **k).collect()}
    sampled, exact, old = run(times=800), run(draws="exact", times=800), run(draws="numpy")
    want = {}
    for s in "xy":
        for u in range(4):
            own = [(v, p) for t, uid, _, v, p in rows if uid == f"{s}{u}" and v is not None]
            for m, v in M.group_metrics([v for v, _ in own], [p for _, p in own]).items():
                want.setdefault((s, m), []).append(v)
    assert old == {k: pytest.approx(sum(v) / len(v)) for k, v in want.items()}
    assert sampled.keys() == exact.keys() == old.keys() and ("x", "maj@4/std") in old and ("x", "best@9/mean") in old
    for k, v in exact.items():  # means within five standard errors of the expectation
        if k[1].endswith("/mean") and not k[1].startswith("maj"):
            error = 5 * exact[k[0], k[1].replace("/mean", "/std")] / math.sqrt(800) + 1e-9
            assert abs(sampled[k] - v) < error and abs(old[k] - v) < error
        elif not k[1].startswith("maj"):
            assert abs(sampled[k] - v) < 0.05 and abs(old[k] - v) < 0.05
        else:
            assert abs(sampled[k] - old[k]) < 0.06
    assert run(times=0) == {k: v for k, v in exact.items() if k[1].startswith(("mean", "std"))}
    assert M.validation_metrics(df.limit(0), ["acc"], "pred").count() == 0
    with pytest.raises(ValueError):
        M.validation_metrics(df, ["acc"], draws="dice")


# conversations as tokens
def test_sft_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemill.functions.chat import TEMPLATES, decoded, sft_tokens

    path, special = public_tokenizers.path("byte_bpe_50k.json"), ["<|im_start|>", "<|im_end|>"]
    chats = [[("system", "be kind"), ("user", "Hello there, 漢字 😀"), ("assistant", "Hi!\n\nHow  are you?"), ("tool", None), ("assistant", "")], [("assistant", " leading space")], [], None, [("user", "x" * 20000), ("assistant", "<|im_end|> inside")]]
    rows = [(i, None if c is None else [{"role": r, "content": t} for r, t in c], 7) for i, c in enumerate(chats)]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>, loss_mask int")
    got = {r.id: r for r in sft_tokens(df, TEMPLATES["chatml"], path, special=special).collect()}
    t = Tokenizer.from_file(path)
    t.add_special_tokens(special)
    for i, c in enumerate(chats):
        if c is None:
            assert got[i].input_ids is None and got[i].loss_mask is None
            continue
        texts = [f"<|im_start|>{r}\n{x or ''}<|im_end|>\n" for r, x in c]
        assert got[i].input_ids == [x for m in texts for x in t.encode(m, add_special_tokens=False).ids] and len(got[i].loss_mask) == len(got[i].input_ids)
        said = t.decode([x for x, m in zip(got[i].input_ids, got[i].loss_mask) if m], skip_special_tokens=False)
        assert said == "".join(f"{x or ''}<|im_end|>\n" for r, x in c if r == "assistant")
    back = sft_tokens(df, TEMPLATES["chatml"], path, special=special).select("id", decoded("input_ids", path, special).alias("t")).collect()
    assert {r.id: r.t for r in back}[3] is None and {r.id: r.t for r in back}[1] == "<|im_start|>assistant\n leading space<|im_end|>\n"
    with pytest.raises(Exception, match="no role"):
        sft_tokens(df, __import__("dataclasses").replace(TEMPLATES["chatml"], before={"user": "u"}), path).collect()


def test_templates_are_told_from_renderings(spark):
    from pyspark.sql import functions as F

    from tidemill.functions.chat import TEMPLATES, template_of

    def render(messages, ask):
        return "<s>" + "".join(f"[{m['role'].upper()}] {m['content']} [/]\n" for m in messages) + ("[ASSISTANT] " if ask else "")

    t = template_of(render, ("user", "assistant", "system"))
    assert (t.start, t.before["user"], t.after["user"], t.ask) == ("<s>", "[USER] ", " [/]\n", "[ASSISTANT] ")
    chat = [{"role": "system", "content": "a"}, {"role": "user", "content": "b"}]
    df = spark.createDataFrame([(chat,)], "m array<struct<role:string,content:string>>")
    assert df.select(t.rendered(F.col("m"), True)).first()[0] == render(chat, True)
    known = df.select(*(x.rendered(F.col("m"), True) for x in TEMPLATES.entries.values())).first()
    assert known[3] == "<bos><start_of_turn>system\na<end_of_turn>\n<start_of_turn>user\nb<end_of_turn>\n<start_of_turn>model\n"
    for bad in (lambda m, a: "".join(f"{i}{x['content']}" for i, x in enumerate(m)), lambda m, a: m[-1]["content"], lambda m, a: "|".join(x["content"] for x in m)):
        with pytest.raises(ValueError):
            template_of(bad)


# tools
def test_tools_that_give_rows(spark):
    from pyspark.sql import types as T

    from tidemill.functions.tables import called, register, rows_function

    def split(sep, text, stop=None):
        for i, w in enumerate(text.split(sep)):
            if w == stop:
                raise KeyError(w)
            yield {"word": w, "size": len(w)} if i % 2 else (w, len(w))

    f = rows_function(split, "word string, size int")
    calls = spark.createDataFrame([(1, '{"text": "a-bb-c"}', 0), (2, '{"text": "a-b-c", "stop": "b"}', 0), (3, "{", 0), (4, None, 0), (5, '{"none": 1}', 0), (6, "[1]", 0), (7, '{"text": "x"}', 0)], "id int, args string, nth int").withColumnRenamed("nth", "own")
    got = sorted(((r.id, r.nth, r.word, r.size, r.error.split(":")[0] if r.error else None) for r in called(calls, f, "args", "-").collect()), key=repr)
    assert got == sorted([(1, 0, "a", 1, None), (1, 1, "bb", 2, None), (1, 2, "c", 1, None), (2, 0, "a", 1, None), (2, 1, None, None, "KeyError"), (3, 0, None, None, "JSONDecodeError"), (5, 0, None, None, "TypeError"), (6, 0, None, None, "TypeError"), (7, 0, "x", 1, None)], key=repr)
    # the schema may depend on constant options
    wide = rows_function(lambda n, text: [tuple(text[i : i + 1] for i in range(n))], lambda n: T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)]))
    register(spark, "letters", wide)
    calls.where("id = 1").createOrReplaceTempView("some_calls")
    assert spark.sql("""SELECT c.id, r.* FROM some_calls c, LATERAL letters('{"text": "xyz"}', 3) r""").collect()[0].asDict() == {"id": 1, "nth": 0, "c0": "x", "c1": "y", "c2": "z", "error": None}
    with pytest.raises(Exception, match="constants"):
        spark.sql("SELECT * FROM some_calls c, LATERAL letters('{}', c.id)").collect()


def test_sessions_of_tools(spark):
    from tidemill.functions.extensions import Tool
    from tidemill.functions.tables import sessions

    class Sum(Tool):
        def execute(self, instance, arguments):
            self.held[instance]["n"] = self.held[instance].get("n", 0) + arguments["x"]
            return str(self.held[instance]["n"]), arguments["x"] / 2, {}

        def reward(self, instance):
            return 10.0 / (self.held[instance].get("n", 0) - 3)

        def release(self, instance):
            super().release(instance)
            assert not self.held

    rows = [("a", 2, '{"x": 2}', 0), ("a", 1, '{"x": 4}', 0), ("a", 3, "no", 0), ("b", 1, '{"x": 3}', 0), (None, 1, '{"x": 5}', 0)]
    df = spark.createDataFrame(rows, "key string, at int, arguments string, more int").repartition(3)
    got = [(r.key, r["at"], r.response, r.reward, r.error.split(":")[0] if r.error else None) for r in sessions(df, Sum, "key", "at").collect()]
    want = [("a", 1, "4", 2.0, None), ("a", 2, "6", 1.0, None), ("a", 3, None, 0.0, "JSONDecodeError"), ("a", None, None, 10 / 3, None), ("b", 1, "3", 1.5, None), ("b", None, None, 0.0, "ZeroDivisionError"), (None, 1, "5", 2.5, None), (None, None, None, 5.0, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sessions(df.limit(0), Sum, "key", "at").count() == 0


# objects
def test_objects_of_mixed_types(spark):
    from pyspark.sql import functions as F

    from tidemill.operators import objects as O

    a = spark.createDataFrame([(0, 7, 1.5), (1, None, float("nan"))], "row_idx long, truth int, score double")
    b = spark.createDataFrame([(2, '{"x": [1, 2]}')], "row_idx long, truth string")
    c = spark.createDataFrame([(3, 9)], "row_idx long, truth long")
    both = O.united(a, b, c)
    assert dict(both.dtypes)["truth"] == "variant" and dict(both.dtypes)["score"] == "double"
    assert [(r[0], r[1]) for r in both.orderBy("row_idx").select(O.kind_of("truth"), F.to_json("truth")).collect()] == [("BIGINT", "7"), (None, None), ("STRING", '"{\\"x\\": [1, 2]}"'), ("BIGINT", "9")]
    assert dict(O.united(a, c).dtypes)["truth"] == "bigint"  # whole numbers don't differ
    assert dict(O.narrowed(O.united(a, c).withColumn("truth", F.col("truth").cast("variant"))).dtypes)["truth"] == "bigint"
    assert dict(O.narrowed(both).dtypes)["truth"] == "variant"
    assert [r[0] for r in O.narrowed(both.where("row_idx <> 2")).orderBy("row_idx").select("truth").collect()] == [7, None, 9]


def test_equality_of_objects(spark):
    from pyspark.sql import functions as F

    from tidemill.operators.objects import same

    texts = ["1", "1.0", '"1"', "true", "null", None, '{"a": 1, "b": [1, {"c": null}]}', '{"b": [1.0, {"c": null}], "a": 1.00}', '{"a": 1}', "[]", "{}", '"NaN"', "1e0"]
    equal = [{0, 1}, {6, 7}]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", F.parse_json("t"))
    pairs = rows.alias("a").join(rows.alias("b")).select(F.col("a.i"), F.col("b.i"), same(F.col("a.v"), F.col("b.v"))).collect()
    for i, j, x in pairs:
        assert x == (i == j or {i, j} in equal), (texts[i], texts[j])
    nan = F.lit(float("nan")).cast("variant")
    assert spark.range(1).select(same(nan, nan), same(nan, F.lit("NaN").cast("variant")), same(nan, F.lit(None).cast("variant"))).first() == (True, False, False)


def test_records_both_ways(spark):
    from pyspark.sql import functions as F

    from tidemill.operators import objects as O

    rows = spark.createDataFrame([(0, "a'b", 1, [1, 2], '{"k": 1}'), (1, None, 2, None, "3"), (2, "c", None, [], "null")], "row_idx long, `it's` string, n int, xs array<int>, j string").withColumn("j", F.parse_json("j"))
    records = O.to_records(rows)
    assert records.dtypes == [("row_idx", "bigint"), ("record", "string")]
    back = O.from_records(records, ["it's", "n", "xs", "j", "absent"])
    assert dict(back.dtypes) == {"row_idx": "bigint", "it's": "string", "n": "bigint", "xs": "array<bigint>", "j": "variant", "absent": "variant"}
    got = back.orderBy("row_idx").select("`it's`", "n", "xs", F.to_json("j"), "absent").collect()
    assert [tuple(r) for r in got] == [("a'b", 1, [1, 2], '{"k":1}', None), (None, 2, None, "3", None), ("c", None, [], None, None)]
    with pytest.raises(Exception, match="(?i)malformed"):
        O.from_records(spark.createDataFrame([("{",)], "record string"), ["a"]).collect()


def test_collation(spark):
    from pyspark.sql import functions as F

    from tidemill.operators.objects import collated, variant

    rows = spark.range(10).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 2 == 0, F.col("id").cast("variant")).otherwise(variant(F.struct("id"), spark.range(1).select(F.struct("id").alias("s")).schema["s"].dataType)).alias("x"), F.array("id").alias("ids")).repartition(4)
    got = collated(rows, 4).orderBy("batch_id").select("batch_id", "row_idx", F.to_json("x").alias("x"), "ids").collect()
    assert [len(r.row_idx) for r in got] == [4, 4, 2] and got[1].row_idx == [4, 5, 6, 7] and got[2].x == '[8,{"id":9}]' and got[0].ids == [[0], [1], [2], [3]]
    assert collated(rows.limit(0), 4).count() == 0


# sinks, listeners, cubes
def test_sinks_have_each_batch_once(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from tidemill.streaming.sinks import SINKS, read_sink, write_once

    schema = "step long, name string, value double"
    stream = stream_of(spark, tmp_path, schema, *[[(k, f"m{i}", k + i / 2) for i in range(3)] for k in range(4)])
    sinks, tries = {"csv": f"{tmp_path}/csv", "json": f"{tmp_path}/json", "shaky": f"{tmp_path}/shaky"}, []

    def shaky(df, folder):
        tries.append(folder)
        SINKS["parquet"](df, folder)
        if len(tries) in (2, 4):  # after it has written, twice
            raise OSError("gone")

    run = lambda: write_once(stream, "a", sinks, f"{tmp_path}/state", {"shaky": shaky}).awaitTermination()
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            run()
    run()
    run()  # nothing new
    want = sorted((k, f"m{i}", k + i / 2, "a", k) for k in range(4) for i in range(3))
    for kind, path in sinks.items():
        got = read_sink(spark, "parquet" if kind == "shaky" else kind, path, stream.schema)
        assert sorted(map(tuple, got.collect())) == want, kind
    assert [t.rsplit("=", 1)[1] for t in tries] == ["0", "1", "1", "2", "2", "3"] or len(tries) == 6
    assert read_sink(spark, "json", f"{tmp_path}/none", stream.schema).count() == 0
    with pytest.raises(ValueError):
        write_once(stream, "a", {"carrier pigeon": "x"}, f"{tmp_path}/s2")


def test_a_listener_adds_up_queues(spark, tmp_path):
    from tidemill.streaming.sinks import Observed, observed_queues, queue_stats
    from tidemill.streaming.state import queues

    batches = [[("a", i) for i in range(5)] + [("b", 1)], [("a", 9)], [("b", i) for i in range(10, 14)]]
    told = Observed()
    spark.streams.addListener(told)
    try:
        stream = observed_queues(queues(stream_of(spark, tmp_path, "k string, item long", *batches), "k", "item", 3))
        for _ in range(2):  # the second run has nothing to do, and adds nothing
            told.wait(stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("update").format("noop").start())
    finally:
        spark.streams.removeListener(told)
    assert queue_stats(told, 3) == {"size": 6, "produced": 11, "dropped": 5, "most": 3}
    assert told.sums("queue")["touched"] == 4 and told.sums("other") == {}


def test_metric_cube(spark):
    from tidemill.operators.metrics import metric_cube

    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), (None, "x", 5.0), ("a", "x", None)], "s string, v string, value double")
    got = {(r.s, r.v, r.grouping_id): (r.n, r["mean"], r.least, r.most) for r in metric_cube(df, ["s", "v"], "value").collect()}
    assert got == {("a", "x", 0): (1, 1.0, 1.0, 1.0), ("a", "y", 0): (1, 3.0, 3.0, 3.0), (None, "x", 0): (1, 5.0, 5.0, 5.0), ("a", None, 1): (2, 2.0, 1.0, 3.0), (None, None, 1): (1, 5.0, 5.0, 5.0), (None, "x", 2): (2, 3.0, 1.0, 5.0), (None, "y", 2): (1, 3.0, 3.0, 3.0), (None, None, 3): (3, 3.0, 1.0, 5.0)}
    with pytest.raises(ValueError):
        metric_cube(df, ["s"], "value", [["v"]])


def test_running_sums_in_runs_of_runs(spark):
    from itertools import accumulate

    from pyspark.sql import functions as F

    from tidemill.functions.text import offsets
    from tidemill.operators.batch import running

    rows = spark.range(500).select(F.col("id").alias("row_idx"), (F.col("id") % 7).alias("n")).repartition(5)
    want = list(accumulate(i % 7 for i in range(500)))
    assert [r[0] for r in running(rows, "n", 5).orderBy("row_idx").select("__end").collect()] == want
    assert [r[0] for r in offsets(rows, "n", "row_idx", 6).orderBy("row_idx").select("end").collect()] == want


def test_scorers_that_fail(spark):
    import time

    from pyspark.sql import functions as F

    from tidemill.functions.extensions import guarded

    def slow(text, truth):
        if text == "slow":
            time.sleep(5)
        return float(text)

    df = spark.createDataFrame([(0, "1.5", "x"), (1, "slow", "x"), (2, "no", "x")], "i int, text string, truth string")
    got = {r.i: (r.score, (r.error or "").split(":")[0]) for r in df.select("i", guarded(slow, 0.5, timeout_score=-1.0)("text", "truth").alias("r")).select("i", "r.*").collect()}
    assert got == {0: (1.5, ""), 1: (-1.0, "TimeoutError"), 2: (0.0, "ValueError")}
    with pytest.raises(Exception, match="no score for 'no' against 'x'"):
        df.where("i <> 1").select(S.as_udf(slow)(F.col("text"), F.col("truth"))).collect()
    nulls = spark.createDataFrame([(None, "1"), ("1", None), (None, None)], "text string, truth string")
    for f in (S.math_score, S.answer_match, S.geo3k):
        assert [r[0] for r in nulls.select(S.as_udf(f)("text", "truth")).collect()] == [0.0, 0.0, 0.0]


def test_labels_that_read_as_numbers(spark):
    from tidemill.functions.masked import dense_index

    index = lambda rows, kind: [r[1] for r in dense_index(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}"), "x", "g").select("i", "g").orderBy("i").collect()]
    assert index(["0042", " 42 ", "-7", "+7"], "string") == [42, 42, -7, 7] and index(["0042", "42", "a"], "string") == [0, 1, 2]
    assert index([2.0, 3.0000001, -1.0], "double") == [2, 3, -1] and index([0.5, 2.0, 0.5], "double") == [0, 1, 0] and index([1.0, float("nan")], "double") == [0, 1]
    assert index([None, "5", "5"], "string") == [0, 1, 1] and index([True, False], "boolean") == [1, 0] and index([], "string") == []


def test_a_response_back_at_full_width(spark):
    from pyspark.sql import functions as F

    from tidemill.functions import text as T

    df = spark.createDataFrame([([float(i) for i in range(8)], 3, 4), ([1.0, 2.0], 1, 1)], "v array<double>, p int, n int")
    part = T.response_part("v", F.col("p"), F.col("n"))
    assert [r[0] for r in df.select(T.full_width(part, "p", 8, -1.0)).collect()] == [[-1.0, -1.0, 2.0, 3.0, 4.0, 5.0, -1.0, -1.0], [1.0] + [-1.0] * 7]
    with pytest.raises(Exception, match="does not fit"):
        df.select(T.full_width("v", "p", 8)).collect()
