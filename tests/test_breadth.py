"""What the queries of tidemill/plans/breadth.py do not reach: errors, draws, streams over files, driver-side helpers."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemill.functions import extensions as X
from tidemill.functions import losses as P
from tidemill.functions import masked as K
from tidemill.functions import scoring as S
from tidemill.operators import advantage as A
from tidemill.operators import balance as L
from tidemill.operators import dispatch as D
from tidemill.operators import metrics as M
from tidemill.operators.batch import appended, prefixed
from tidemill.sources import tables as R
from tidemill.streaming import events as E
from tidemill.streaming import samples as Q


def test_formulas():
    for text, want in {"1/3": 1 / 3, "2\\pi": 2 * math.pi, "\\frac{1}{2}+3": 3.5, "-(2^3)": -8, "\\sqrt{16}/2": 2, "2^{-1}": 0.5, "3*4-5": 7, "2(3+4)": 14, "x+1": None, "1/0": None, "__import__('os')": None, "9**9**9": None, "": None, "(1": None, "2" * 300: float("2" * 300), "+".join(["1"] * 5000): 5000, "2^{1010}": 2.0**1010}.items():
        got = S.formula(text)
        assert got == (pytest.approx(want) if want is not None else None), text
    assert S.math_equal("\\frac{\\pi}{2}", "pi/2") and S.math_equal("12_{8}", "12") and S.math_equal("2^3", "8") and not S.math_equal("x+1", "1+y")
    assert S.math_equal("(0, 1]", "(0,1.0]") and not S.math_equal("(0,1]", "[0,1)") and not S.math_equal("(0,1,2)", "(0,1)")


def test_every_source_has_a_scorer():
    assert S.scorer("aime2025") is S.RULES["line"] and S.scorer("taco") is S.RULES["code"]
    with pytest.raises(ValueError):
        S.scorer("unheard/of")


def test_resampling_draws_exactly_n_in_proportion(spark):
    seqs = spark.createDataFrame([(i, float(i % 4)) for i in range(2000)], "seq_id long, score double")
    got = A.resample(seqs, "pow", 2.0, seed=5).collect()
    assert len(got) == 2000 and sorted(r.draw for r in got) == list(range(2000))
    n = collections.Counter(r.score for r in got)
    assert n[0.0] == 0 and all(n[k] / 2000 == pytest.approx(k * k / 14, abs=0.05) for k in (1.0, 2.0, 3.0))
    assert sorted(map(tuple, A.resample(seqs.repartition(7), "pow", 2.0, seed=5).collect())) == sorted(map(tuple, got))
    heavy = spark.createDataFrame([(i, 1000.0 if i == 7 else 1.0) for i in range(500)], "seq_id long, score double")
    got = collections.Counter(r.seq_id for r in A.resample(heavy).collect())
    assert sum(got.values()) == 500 and got[7] > 490


def test_whitening_is_that_of_two_passes(spark):
    rows = [(i % 2 * 1.0, 1e6 + math.sin(i)) for i in range(400)]
    x = [v for m, v in rows if m]
    mean = sum(x) / (len(x) + 1e-8)
    var = sum((v - mean) ** 2 for v in x) / (len(x) + 1e-8) * len(x) / (len(x) - 1)
    got = K.whiten(spark.createDataFrame(rows, "mask double, v double"), "v", "mask", "w").collect()
    assert [r.w for r in got] == pytest.approx([(v - mean) / math.sqrt(var + 1e-8) for _, v in rows], rel=1e-6)
    with pytest.raises(Exception, match="two values"):
        K.whiten(spark.createDataFrame([(1.0, 2.0)], "mask double, v double"), "v", "mask", "w").collect()


def test_greatest_covariances_are_exact(spark):
    rows = spark.range(20000).selectExpr("id % 100 as seq_id", "id div 100 as pos", "1 as mask", "cast(hash(id) % 1000 as double) / 100 as advantage", "cast(hash(id, 1) % 1000 as double) / 100 as new_lp", "0.0D as old_lp")
    built = P._with_first(P._covariance(rows, "__by"), P._covariance(rows, "__by"), 0.01).collect()
    hits = sorted(((-r["__by"], r.seq_id, r.pos) for r in built if r["__s"] is not None))
    assert hits == sorted((-r["__by"], r.seq_id, r.pos) for r in built)[:200]
    assert sum(r["__s"] is not None for r in P._with_first(P._covariance(rows, "__by"), P._covariance(rows, "__by"), 0.9).collect()) == 18000


def test_late_batches_keep_what_earlier_ones_gave(spark, tmp_path):
    for k, users in enumerate(([1, 2, 2], [1, 3], [3, 3, 3])):
        spark.createDataFrame([(10 * k + i, u) for i, u in enumerate(users)], "event_id long, user_id long").selectExpr("*", "timestamp '2024-01-01' as ts").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = E.run_to_table(Q.queue_counts(stream, "user_id", "event_id", 2), f"{tmp_path}/run", "update", ["user_id"])
    assert sorted((r.user_id, r.size, r.produced, r.dropped) for r in out.collect()) == [(1, 2, 2, 0), (2, 2, 2, 0), (3, 2, 4, 2)]
    with pytest.raises(ValueError):
        E.run_to_table(stream, f"{tmp_path}/x", "update")


def test_rows_are_read_in_the_order_of_files(spark, tmp_path):
    for k in range(3):
        spark.range(k * 1000, k * 1000 + 10 + 400 * (2 - k)).coalesce(1).write.parquet(f"{tmp_path}/t.parquet/{k}")
    for k in range(3):
        part = next((tmp_path / "t.parquet" / str(k)).glob("part-*"))
        part.rename(tmp_path / "t.parquet" / f"part-{k}.parquet")
    import shutil

    for k in range(3):
        shutil.rmtree(tmp_path / "t.parquet" / str(k))
    got = [r.id for r in R.read_tables(spark, f"{tmp_path}/t.parquet").orderBy("row_idx").collect()]
    assert got == sorted(got) and len(got) == 1230


def test_values_for_all_tasks_are_bounded(spark):
    with pytest.raises(ValueError):
        D.run("one_to_all", spark.range(2), lambda b, _: b, "id long", b"x" * 1000, 100)


def test_balance_modes(spark):
    rows = spark.createDataFrame([(0, i, (i * 37) % 91 + 1, i // 3) for i in range(48)], "step long, row_idx long, seqlen long, uid long")
    for mode, options in (("batch", {}), ("mini", {"mini": 16}), ("group", {"group": "uid"})):
        got = L.in_rank_order(rows, "step", 4, mode, **options).join(rows, ["step", "row_idx"]).collect()
        n = collections.Counter(r.part for r in got)
        assert len(got) == 48 and set(n.values()) == {12}, mode
        if mode == "mini":
            assert set(collections.Counter((r.part, r.row_idx // 16) for r in got).values()) == {4}
        if mode == "group":
            assert len({(r.uid, r.part) for r in got}) == 16
    for bad in ({"mode": "other"}, {"mode": "mini"}, {"mode": "group"}):
        with pytest.raises(ValueError):
            L.in_rank_order(rows, "step", 4, **bad)
    with pytest.raises(Exception, match="multiple"):
        L.in_rank_order(rows, "step", 5, "group", group="uid").collect()


def test_latent_attention_flops(spark):
    c = {"hidden_size": 8, "vocab_size": 16, "layers": 3, "heads": 2, "nope_dim": 4, "rope_dim": 2, "v_dim": 3, "kv_rank": 5, "q_rank": None, "experts": 4, "expert_size": 6, "chosen": 2, "shared": 1, "dense_layers": 1, "intermediate_size": 20}
    attention = 8 * 2 * 6 + 8 * (5 + 2) + 2 * (4 + 3) * 5 + 2 * 3 * 8
    n = (8 * 4 + 3 * 8 * 6 * 3) * 2 + 3 * 8 * 20 + attention * 3 + 2 * 16 * 8
    lengths = spark.createDataFrame([(10,), (20,)], "seqlen long")
    want = (6 * n * 30 + 3 * 500 * 3 * (6 + 3) * 2) / 2 / 1e12
    assert M.flops_of(lengths, "deepseek_v3", c, 2.0).first().tflops == pytest.approx(want)


def test_losses_by_name_and_refusals(spark):
    rows = spark.createDataFrame([(0, 0, 1, -1.0, -1.1, 0.5)], "seq_id long, pos long, mask int, new_lp double, old_lp double, advantage double")
    with pytest.raises(ValueError):
        P.policy_loss("bypass_mode", rows, loss="other")
    assert P.DISTILLATION["forward_kl_topk"]() is not None
    with pytest.raises(ValueError):
        P.DISTILLATION["other"]


def test_helpers():
    assert prefixed({"a": 1}, "x/") == {"x/a": 1} and appended({"a": [1]}, {"a": 2, "b": 3}) == {"a": [1, 2], "b": [3]}
    log = []
    assert Q.overlapped([1, 2, 3], lambda b: (log.append(("made", b)), b)[1], lambda b: (log.append(("used", b)), b * 10)[1]) == [10, 20, 30]
    assert log.index(("made", 1)) < log.index(("used", 1)) < log.index(("used", 2)) and Q.overlapped([], None, None) == []
    side = Q.SideQueue()
    side.put(1)
    assert side.get() == 1 and side.get() is None and Q.idle_ratio(1.0, 4.0) == 0.25 and Q.idle_ratio(1.0, 0.0) == 0.0

    class Counter(X.Tool):
        def execute(self, instance, arguments):
            self.held[instance]["n"] += arguments["by"]
            return str(self.held[instance]["n"]), 0.0, {}

    tool = Counter()
    name = tool.create(n=1)
    assert tool.execute(name, {"by": 2})[0] == "3" and tool.reward(name) == 0.0
    tool.release(name)
    assert not tool.held
    with pytest.raises(TypeError):
        X.Tool().execute("x", {})
    with pytest.raises(ValueError):
        M.merged_validation(None, None)


def test_managers(spark):
    rows = spark.createDataFrame([(1.0, 2, 0.5)], "score double, response_length int, style double")
    assert X.MANAGERS["gdpo"](rows, 4, ["style"]).first().token_level_scores == [0.0, 1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        X.MANAGERS["gdpo"](rows, 4, ["absent"])


def test_dense_index_of_numbers_and_nulls(spark):
    numbers = spark.createDataFrame([(5,), (2,), (5,)], "k long")
    assert [r.group_index for r in K.dense_index(numbers, "k").collect()] == [5, 2, 5]
    words = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k string")
    assert sorted((r.k or "", r.group_index) for r in K.dense_index(words, "k").collect()) == [("", 0), ("a", 1), ("b", 2), ("b", 2)]


def test_shared_folder_is_named_on_a_cluster(spark):
    from tidemill.session import shared_folder

    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir() and F.lit(1) is not None and DATA
