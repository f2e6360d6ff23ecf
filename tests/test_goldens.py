"""Values known by hand or worked out from the formulas."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import losses, masked
from tidemill.operators import advantage as A
from tidemill.operators import metrics as M
from tidemill.operators import offpolicy as O

REWARDS = [[100, 0, 0, 0], [1, 2, 3, 4], [200, 200, 0, 0], [150, 0, 0, 150], [4, 5, 6, 7], [8, 9, 10, 11]]
MASKS = [[1, 0, 0, 0], [1, 1, 1, 1], [1, 0, 1, 0], [0, 1, 0, 1], [1, 1, 0, 1], [0, 0, 0, 0]]
KEYS = ["a_0_0", "a_0_1", "a_2_0", "a_2_1", "a_3_0", "a_4_0"]
ADVANTAGES = {
    "grpo": [-0.272975041, -0.818925124, 1.546858567, 0.940247365, -0.746131780, -0.649073987], "rloo": [-54, -162, 306, 186, -147.6, -128.4],
    "opo": [-33.833333, -123.833333, 266.166667, 166.166667, -111.833333, -95.833333], "gpg": [-45, -135, 255, 155, -123, -107], "grpo_passk": [0, 0, 0.606611203, 0, 0, 0],
}


@pytest.fixture(scope="module")
def seqs(spark):
    rows = [(i, "p", float(sum(r)), sum(m), k) for i, (r, m, k) in enumerate(zip(REWARDS, MASKS, KEYS, strict=True))]
    return spark.createDataFrame(rows, "seq_id long, uid string, score double, length long, batch_key string").persist()


def by_id(df, c="advantage"):
    return [r[c] for r in df.orderBy("seq_id").collect()]


@pytest.mark.parametrize("name", ADVANTAGES)
def test_group_advantages(seqs, name):
    assert by_id(A.advantage(name, seqs)) == pytest.approx(ADVANTAGES[name], rel=1e-6, abs=1e-8)


def test_single_rows(spark):
    one = spark.createDataFrame([(0, "a", 3.0, 2)], "seq_id long, uid string, score double, length long")
    assert by_id(A.rloo(one)) == [3.0] and by_id(A.rloo_vectorized(one)) == [0.0] and by_id(A.grpo(one)) == pytest.approx([3 / (1 + 1e-6)]) and by_id(A.opo(one)) == [3.0]
    with pytest.raises(Exception, match="two rows"):
        A.grpo_passk(one).collect()


def test_sessions(seqs):
    got = by_id(A.multi_trajectory(seqs))
    assert got == pytest.approx([-0.594346053] * 2 + [1.494870377] * 2 + [-0.507895718, 0], rel=1e-6)


def test_unknown_names():
    for f in (lambda: A.SEQUENCE["nope"], lambda: losses.POLICY["nope"], lambda: A.SEQUENCE.register("grpo")(len), lambda: A.KLController(0.1, 1.0, 0), lambda: A.resample_weights(F.lit(1.0), "nope")):
        with pytest.raises((ValueError, Exception)):
            f()
    assert A.KLController(0.1, 1.0, 100).update(2.0, 10) == pytest.approx(0.1 * 1.02)


R11, M11, V11 = [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1, 0, 0], [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0], [3, 0.5, 4, 5, 6, -2, 0.25, 7, 9, 0, 0]


def token_rows(spark, rewards, masks, values):
    rows = [(s, i, int(m), float(r), float(v)) for s, (rr, mm, vv) in enumerate(zip(rewards, masks, values, strict=True)) for i, (r, m, v) in enumerate(zip(rr, mm, vv, strict=True))]
    return spark.createDataFrame(rows, "seq_id long, pos long, mask int, reward double, value double")


def test_gae(spark):
    got = A.gae(token_rows(spark, [R11], [M11], [V11]), 0.9, 0.8).where("mask = 1").orderBy("pos").collect()
    assert [r.returns for r in got] == pytest.approx([3.46534912, 3.424096, 3.1168, 2.44, 1.0])
    assert [r.advantage for r in got] == pytest.approx([1.017077817, 0.661231099, 0.214464618, -0.358579309, -1.534194237])
    other = [v if m else 77.0 for v, m in zip(V11, M11, strict=True)]
    again = A.gae(token_rows(spark, [R11], [M11], [other]), 0.9, 0.8).where("mask = 1").orderBy("pos").collect()
    assert [(r.advantage, r.returns) for r in again] == [(r.advantage, r.returns) for r in got]


def test_discounted_over_many_blocks(spark):
    import random

    r = random.Random(1)
    x = [r.uniform(-1, 1) for _ in range(3000)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "seq_id long, pos long, x double")
    for rate in (0.3, 0.97, 1.0):
        want, run = [], 0.0
        for v in reversed(x):
            run = v + rate * run
            want.append(run)
        got = [q.y for q in A.discounted(df, ["seq_id"], "pos", F.col("x"), rate, "y").orderBy("pos").collect()]
        assert got == pytest.approx(want[::-1], rel=1e-9, abs=1e-12)


def test_reward_to_go_restarts(spark):
    got = A.reinforce_plus_plus(token_rows(spark, [[1, 2, 3, 4]], [[1, 1, 0, 1]], [[0] * 4]), 0.5).orderBy("pos").collect()
    assert [g.returns for g in got] == [2.0, 2.0, 5.0, 4.0]


def test_loss_modes(spark):
    x, m = [[1, 2, 3], [4, 5, 6], [7, 8, 9]], [[1, 1, 0], [1, 1, 1], [0, 0, 0]]
    df = token_rows(spark, x, m, x).withColumnRenamed("reward", "loss")
    want = {"token-mean": 3.6, "seq-mean-token-sum": 9.0, "seq-mean-token-sum-norm": 3.0, "seq-mean-token-mean": 3.249999988}
    assert {k: losses.agg_loss(df, mode=k).first()[0] for k in want} == pytest.approx(want, rel=1e-9)
    assert losses.agg_loss(df, mode="seq-mean-token-sum-norm", norm=9).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        losses.agg_loss(df, mode="nope")
    with pytest.raises(ValueError):
        losses.agg_loss(df, workers=2)


@pytest.fixture(scope="module")
def off(spark):
    old, roll, m = [[-1, -2, -0.5], [-0.3, -0.1, -2]], [[-1.2, -1.5, -0.5], [-0.4, -0.9, -1]], [[1, 1, 1], [1, 1, 0]]
    rows = [(s, i, m[s][i], float(old[s][i]), float(roll[s][i])) for s in range(2) for i in range(3)]
    return spark.createDataFrame(rows, "seq_id long, pos long, mask int, old_lp double, rollout_lp double").persist()


def test_off_policy(off):
    got = [r.weight for r in O.importance_weights(off, "token", 2).orderBy("seq_id", "pos").collect()]
    assert got == pytest.approx([1.221402758, 0.606530660, 1, 1.105170918, 2, 0])
    got = [r.weight for r in O.importance_weights(off, "sequence", 100).where("pos = 0").orderBy("seq_id").collect()]
    assert got == pytest.approx([0.740818221, 2.459603111])
    x = O.off_policy_metrics(off).first()
    assert (x.kl, x.k3_kl, x.chi2_token, x.chi2_seq) == pytest.approx((-0.12, 0.111729053, 0.806827861, 2.299229550), rel=1e-6)
    assert [r.kept_mask for r in O.reject(off, "token_k1", "0.5_1.5").orderBy("seq_id", "pos").collect()] == [1, 0, 1, 1, 0, 0]


def test_thresholds():
    assert O.weight_bounds(2) == (2.0, None) and O.weight_bounds("0.5_2") == (2.0, 0.5)
    for bad in ("", "0", "2_1", "1_2_3", -1):
        with pytest.raises(ValueError):
            O.weight_bounds(bad)
    with pytest.raises(TypeError):
        O.weight_bounds(True)
    assert O.rejection_options("token_k1,seq_sum_k2,token_k1", "2,0.1") == {"token_k1": (2.0, 0.5), "seq_sum_k2": (0.1, None)}
    for options, spec in (("nope", 1), ("token_k2", "0.5_1"), ("token_k1,token_k2", "1,2,3"), ("token_k1", None)):
        with pytest.raises(ValueError):
            O.rejection_options(options, spec)


def test_empty_mask_fails(off):
    with pytest.raises(Exception, match="no valid token"):
        O.off_policy_metrics(off.withColumn("mask", F.lit(0))).collect()


def test_group_statistics(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "g long, x double")
    got = [tuple(r) for r in masked.group_mean_std(df, "x", "g").orderBy("g").collect()]
    assert got == [(0, 2.0, pytest.approx(2**0.5), 2), (1, 0.0, 1.0, 1)]
    with pytest.raises(Exception, match="two values"):
        masked.masked_moments(df.withColumn("m", (F.col("x") == 1).cast("int")), "x", "m").collect()


def test_bootstrap():
    got = M.group_metrics([0.8, 0.9, 0.7], ["A", "B", "A"])
    assert got["mean@3"] == pytest.approx(0.8) and got["std@3"] == pytest.approx(0.0816496581)
    assert (got["best@2/mean"], got["best@2/std"]) == pytest.approx((0.8437, 0.0679728622)) and (got["worst@2/mean"], got["worst@2/std"]) == pytest.approx((0.757, 0.0687822652))
    assert (got["maj@2/mean"], got["maj@2/std"]) == pytest.approx((0.7986, 0.0802373978))
    assert M.majority(["A", "B", "A"], [0.9, 0.8, 0.7]) == 0.9 and M.sizes(1) == [] and M.sizes(2) == [2] and M.sizes(6) == [2, 4, 6] and M.sizes(8) == [2, 4, 8]
    assert M.bootstrap([1.0], 2, [max, min]) == [(1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        M.bootstrap([], 2, [max])


def test_metric_rules(spark):
    df = spark.createDataFrame([("a", "mean", 1.0), ("a", "sum", 2.0)], "name string, agg string, value double")
    with pytest.raises(Exception, match="several aggregations"):
        M.by_rule(df).collect()
    with pytest.raises(Exception, match="no such aggregation"):
        M.by_rule(df.where("agg = 'sum'").withColumn("agg", F.lit("median"))).collect()
    assert [M.rule_of(n) for n in ("timing_s/gen", "x_mean", "a/max", "b/min", "total_x", "other")] == ["sum", "avg", "max", "min", "sum", "avg"]
    assert M.flattened({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a/b": 1, "a/c/d": 2, "e": 3}
    assert spark.range(1).select(M.sanitised(F.lit("val@4//x y!z"))).first()[0] == "val_at_4/x y_z"
    assert M.met(["step 1 reward: 0.5", "reward: 0.9"], "reward", 0.8) and not M.met([], "reward", 0.1)


@pytest.mark.parametrize("kind", ["kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3", "k3+"])
def test_kl_kinds(spark, kind):
    import math

    d = 0.3
    want = {"k": d, "a": d, "m": d * d / 2, "l": math.exp(-d) + d - 1}
    want = want["l"] if kind.startswith(("low", "k3")) else want["m"] if kind in ("mse", "k2") else d
    assert spark.range(1).select(losses.kl_penalty(F.lit(d), F.lit(0.0), kind)).first()[0] == pytest.approx(want)
    with pytest.raises(NotImplementedError):
        losses.kl_penalty(F.lit(1.0), F.lit(1.0), "full")
