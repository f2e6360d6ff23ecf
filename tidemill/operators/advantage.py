"""Advantage estimators.

Sequence estimators work on a row per sequence (seq_id, uid, score, length) by windows over uid, so that one exchange on uid serves
all their statistics. Token estimators work on a row per token (seq_id, pos, mask, reward, ...), by windows over seq_id; recursions are
running sums of discounted terms. Both add columns; `spread` brings a sequence's advantage to its tokens.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.draws import word
from tidemill.functions.masked import EPS, masked, scalar_join, whiten
from tidemill.functions.registry import Registry

SEQUENCE = Registry("advantage estimator")
TOKEN = Registry("token advantage estimator")
STD_EPS = 1e-6


def _group() -> tuple[Column, Column, Column]:
    """Size, mean (0 for a single row) and sample deviation (1 for a single row) of the scores of a row's group."""
    w = Window.partitionBy("uid")
    n = F.count("*").over(w)
    return n, F.when(n == 1, 0.0).otherwise(F.avg("score").over(w)), F.when(n == 1, 1.0).otherwise(F.stddev_samp("score").over(w))


@SEQUENCE.register("grpo")
def grpo(seqs: DataFrame, norm_by_std: bool = True) -> DataFrame:
    """Scores by the group's mean and deviation."""
    _, mean, std = _group()
    centred = F.col("score") - mean
    return seqs.withColumn("advantage", centred / (std + STD_EPS) if norm_by_std else centred)


SEQUENCE.register("grpo_vectorized")(grpo)


@SEQUENCE.register("reinforce_plus_plus_baseline")
def group_centred(seqs: DataFrame) -> DataFrame:
    """Scores by the group's mean; the tokens are whitened later."""
    return seqs.withColumn("advantage", F.col("score") - _group()[1])


@SEQUENCE.register("rloo")
def rloo(seqs: DataFrame) -> DataFrame:
    """The score less the mean of the others'; a single row keeps its score."""
    n, mean, _ = _group()
    return seqs.withColumn("advantage", F.when(n > 1, (F.col("score") - mean) * n / (n - 1)).otherwise(F.col("score")))


@SEQUENCE.register("rloo_vectorized")
def rloo_vectorized(seqs: DataFrame) -> DataFrame:
    """As rloo, but a single row gets 0."""
    w = Window.partitionBy("uid")
    n = F.count("*").over(w)
    return seqs.withColumn("advantage", F.when(n > 1, (n * F.col("score") - F.sum("score").over(w)) / (n - 1)).otherwise(0.0))


@SEQUENCE.register("opo")
def opo(seqs: DataFrame) -> DataFrame:
    """The score less the group's mean weighted by length; a single row has baseline 0. A group without a valid token: null."""
    w = Window.partitionBy("uid")
    weighted = F.try_divide(F.sum(F.col("length") * F.col("score")).over(w), F.sum("length").over(w))
    return seqs.withColumn("advantage", F.col("score") - F.when(F.count("*").over(w) == 1, 0.0).otherwise(weighted))


@SEQUENCE.register("gpg")
def gpg(seqs: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """Centred scores, times the batch's rows per non-zero score."""
    scale = seqs.agg((F.count("*") / F.greatest(F.sum(F.when(F.col("score") != 0, 1).otherwise(0)), F.lit(1))).alias("__scale"))
    return scalar_join(seqs, scale).withColumn("advantage", F.col("__scale") * (F.col("score") - _group()[1]) / f_norm).drop("__scale")


@SEQUENCE.register("grpo_passk")
def grpo_passk(seqs: DataFrame, norm_by_std: bool = True) -> DataFrame:
    """Only a group's best row (of equals, that of least seq_id) gets more than 0: its lead on the second. A single row fails."""
    w = Window.partitionBy("uid")
    ranked = w.orderBy(F.col("score").desc(), "seq_id")
    second = F.nth_value("score", 2).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    few = F.raise_error(F.lit("a group needs two rows or more")).cast("double")
    lead = F.when(F.row_number().over(ranked) == 1, F.col("score") - second).otherwise(0.0)
    scaled = lead / (F.stddev_samp("score").over(w) + STD_EPS) if norm_by_std else lead
    return seqs.withColumn("advantage", F.when(F.count("*").over(w) < 2, few).otherwise(scaled))


def spread(tokens: DataFrame, seqs: DataFrame) -> DataFrame:
    """tokens with their sequence's advantage where the mask is set, 0 elsewhere."""
    return tokens.join(seqs.select("seq_id", "advantage"), "seq_id").withColumn("advantage", F.col("advantage") * F.col("mask"))


def gdpo(scores: DataFrame, keys: list[str], weights: Mapping[str, float] | None = None) -> DataFrame:
    """Rows with one score per key: the weighted sum of each key's grpo advantages. To be spread and whitened."""
    if missing := [k for k in keys if k not in scores.columns]:
        raise ValueError(f"no scores for {missing}; there are {scores.columns}")
    w = Window.partitionBy("uid")
    n, total = F.count("*").over(w), F.lit(0.0)
    for k in keys:
        mean, std = F.when(n == 1, 0.0).otherwise(F.avg(k).over(w)), F.when(n == 1, 1.0).otherwise(F.stddev_samp(k).over(w))
        total = total + float((weights or {}).get(k, 1.0)) * (F.col(k) - mean) / (std + STD_EPS)
    return scores.withColumn("advantage", total)


def _forward() -> Window:
    return Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _backward() -> Window:
    # from the last token on: a frame that reaches to the partition's end would be summed anew for every row
    return Window.partitionBy("seq_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def discounted(rows: DataFrame, keys: list[str], index: str, x: Column, rate: float, out: str) -> DataFrame:
    """rows with `out`: the sum, over this and later rows of equal keys, of x times rate to the power of how far on in `index` they are.

    Running sums of x times powers of the rate, within blocks short enough for the powers to stay in range; beyond the next block
    they are below a double's precision. So a long sequence takes time in proportion to its length."""
    if rate <= 0:
        return rows.withColumn(out, x)
    width = math.ceil(46 / -math.log(rate)) if rate < 1 else 1 << 40
    rows = rows.withColumns({"__b": F.floor(F.col(index) / width), "__x": x * F.pow(F.lit(rate), F.col(index) % width)})
    block = Window.partitionBy(*keys, "__b")
    local = F.sum("__x").over(block.orderBy(F.col(index).desc(), F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"__s": local / F.pow(F.lit(rate), F.col(index) % width), "__t": F.sum("__x").over(block)})
    after = F.max("__t").over(Window.partitionBy(*keys).orderBy("__b").rangeBetween(1, 1))
    tail = F.coalesce(after, F.lit(0.0)) * F.pow(F.lit(rate), width - F.col(index) % width) if rate < 1 else F.lit(0.0)
    return rows.withColumn(out, F.col("__s") + tail).drop("__b", "__x", "__s", "__t")


@TOKEN.register("gae")
def gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 1.0, whitened: bool = True) -> DataFrame:
    """advantage and returns by generalised advantage estimation; tokens without mask are passed over: their neighbours follow one
    another, and they take what comes after them."""
    on = F.col("mask") != 0
    w = Window.partitionBy("seq_id")
    before, after = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1), w.orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = tokens.withColumns({
        "__k": F.coalesce(F.sum(on.cast("long")).over(before), F.lit(0)), "__next": F.coalesce(F.last(F.when(on, F.col("value")), ignorenulls=True).over(after), F.lit(0.0))})
    delta = F.when(on, F.col("reward") + gamma * F.col("__next") - F.col("value")).otherwise(0.0)
    out = discounted(rows, ["seq_id"], "__k", delta, gamma * lam, "advantage").drop("__k", "__next").withColumn("returns", F.col("advantage") + F.col("value"))
    return whiten(out, "advantage", "mask", "advantage") if whitened else out


@TOKEN.register("reinforce_plus_plus")
def reinforce_plus_plus(tokens: DataFrame, gamma: float = 1.0) -> DataFrame:
    """returns: discounted rewards to come, up to a token without mask, which itself has all; advantage: those whitened, under the mask."""
    rows = tokens.withColumn("__z", F.sum((F.col("mask") == 0).cast("long")).over(_forward()))
    out = discounted(rows, ["seq_id", "__z"], "pos", F.col("reward"), gamma, "returns").drop("__z")
    return whiten(out, "returns", "mask", "advantage").withColumn("advantage", F.col("advantage") * F.col("mask"))


@TOKEN.register("remax")
def remax(tokens: DataFrame, baselines: DataFrame) -> DataFrame:
    """returns: masked rewards to come; advantage: less the sequence's baseline. baselines: seq_id, baseline, one for every sequence."""
    joined = tokens.join(baselines, "seq_id", "left")
    base = F.coalesce("baseline", F.raise_error(F.lit("a sequence has no baseline")).cast("double"))
    out = joined.withColumn("returns", F.sum(masked("reward", "mask")).over(_backward()))
    return out.withColumn("advantage", F.col("returns") - base * F.col("mask")).drop("baseline")


@TOKEN.register("optimal_token_baseline")
def optimal_token_baseline(tokens: DataFrame, importance: str | None = None, zero_tail: bool = True, compact: bool = False) -> DataFrame:
    """returns: masked rewards to come; advantage: less a baseline per group and position, weighted by the squared norm of the
    gradient so far. tokens: uid, old_lp and sum_pi_squared too; importance: a column of ratios. A group of one has no baseline;
    with zero_tail, nor has the one longest sequence of a group beyond the second. compact: positions count valid tokens only."""
    weight = 1 - 2 * F.exp("old_lp") + F.col("sum_pi_squared")
    if importance:
        weight = weight * F.col(importance) ** 2
    out = tokens.withColumn("returns", F.sum(masked("reward", "mask")).over(_backward())).withColumn("__w", F.sum(weight * F.col("mask")).over(_forward()))
    place = F.sum("mask").over(_forward()) - 1 if compact else F.col("pos")
    out = out.withColumn("__place", place.cast("long"))
    lengths = tokens.groupBy("uid", "seq_id").agg(F.sum("mask").alias("__length")).where("__length > 0" if compact else "true")
    by_length = Window.partitionBy("uid").orderBy(F.col("__length").desc(), "seq_id")
    whole = by_length.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lengths = lengths.select("seq_id", "__length", F.nth_value("__length", 2).over(whole).alias("__second"), F.max("__length").over(whole).alias("__longest"), F.count("*").over(Window.partitionBy("uid")).alias("__n"))
    cell = Window.partitionBy("uid", "__place")
    out = out.join(lengths, "seq_id", "left")
    on = F.col("mask") != 0
    base = F.sum(F.when(on, F.col("returns") * F.col("__w"))).over(cell) / (F.sum(F.when(on, F.col("__w"))).over(cell) + EPS)
    alone = (F.col("__length") == F.col("__longest")) & (F.col("__second") < F.col("__longest")) & (F.col("__place") >= F.col("__second"))
    base = F.when(F.col("__n") < 2, 0.0).when(alone & F.lit(zero_tail), 0.0).otherwise(F.coalesce(base, F.lit(0.0)))
    return out.withColumn("advantage", F.when(on, F.col("returns") - base).otherwise(0.0)).drop("__w", "__place", "__length", "__second", "__longest", "__n")


@TOKEN.register("tir_optimal_token_baseline")
def tir_optimal_token_baseline(tokens: DataFrame, importance: str | None = None, zero_tail: bool = True) -> DataFrame:
    return optimal_token_baseline(tokens, importance, zero_tail, compact=True)


def multi_trajectory(rows: DataFrame, norm_by_std: bool = True) -> DataFrame:
    """grpo over sessions: rows of key `uid_session_index`; a session's last row stands for it, and all its rows get that row's advantage."""
    key = r"^(.*)_([^_]*)_(\d+)$"
    parts = rows.withColumns({"__session": F.regexp_replace("batch_key", r"_\d+$", ""), "__index": F.regexp_extract("batch_key", key, 3).cast("long")})
    last = parts.withColumn("__last", F.row_number().over(Window.partitionBy("__session").orderBy(F.col("__index").desc())) == 1)
    final = grpo(last.where("__last"), norm_by_std).select(F.col("__session").alias("__s"), F.when(F.col("length") > 0, F.col("advantage")).otherwise(0.0).alias("advantage"))
    return last.join(final, F.col("__session") == F.col("__s")).drop("__session", "__index", "__last", "__s")


def kl_rewards(tokens: DataFrame, penalty: Column, beta: float) -> DataFrame:
    """token rewards: scores less beta times the masked penalty."""
    kl = penalty * F.col("mask")
    return tokens.withColumns({"kl": kl, "token_reward": F.col("reward") - beta * kl})


def resample_weights(score: Column, how: str, power: float = 2.0, extremes: tuple[Column, Column] | None = None) -> Column:
    """Of rows by score: `pow` |score|^power; `max_min` 1 at the batch's extremes else 0; `max_random` 0.4 at the greatest else 0.1. extremes: least and greatest."""
    if how == "pow":
        return F.abs(score) ** power + EPS
    if how not in ("max_min", "max_random") or extremes is None:
        raise ValueError(f"no such resampling: {how}")
    low, high = extremes
    if how == "max_min":
        return F.when((score == low) | (score == high), 1.0).otherwise(0.0) + EPS
    return F.when(score == high, 0.4).otherwise(0.1) + EPS


def resample(seqs: DataFrame, how: str = "pow", power: float = 2.0, seed: int = 0) -> DataFrame:
    """Exactly as many rows as seqs, drawn with replacement in proportion to the weights, with `draw`, the draw's number.

    Rows stand for intervals of whole numbers, one after another in order of seq_id; draw i is a hash of i and the seed. Draws and
    intervals meet in cells about as many as rows, and an interval stands in all cells it covers, so one heavy row is no hot key."""
    from tidemill.operators.batch import ROW, numbered, running

    stats = seqs.agg(F.min("score").alias("__low"), F.max("score").alias("__high"))
    weighed = scalar_join(seqs, stats).withColumn("__w", resample_weights(F.col("score"), how, power, (F.col("__low"), F.col("__high")))).drop("__low", "__high")
    total = weighed.agg(F.sum("__w").alias("__total"))
    whole = scalar_join(numbered(weighed, "seq_id"), total).withColumn("__w", F.ceil(F.col("__w") / F.col("__total") * float(1 << 44))).drop("__total")
    held = running(whole, "__w")
    size = held.agg(F.max("__end").alias("__size"), F.count("*").alias("__n"))
    n = held.count()
    cell = lambda x: F.floor(x / F.ceil(F.col("__size") / F.col("__n")))
    covers = F.sequence(cell(F.col("__end") - F.col("__w")), cell(F.col("__end") - 1))
    rows = scalar_join(held, size).withColumn("__cell", F.explode(covers)).drop("__size", "__n")
    draws = scalar_join(seqs.sparkSession.range(n).select(F.col("id").alias("draw")), size).withColumn("__at", F.pmod(word("draw", seed), F.col("__size")))
    draws = draws.withColumn("__in", cell(F.col("__at"))).drop("__size", "__n")
    got = rows.join(draws, (F.col("__cell") == F.col("__in")) & (F.col("__at") >= F.col("__end") - F.col("__w")) & (F.col("__at") < F.col("__end")))
    return got.select(*seqs.columns, "draw")


def last_of_session_baseline(rows: DataFrame, baselines: DataFrame) -> DataFrame:
    """rows with the score of the last baseline row of their uid (columns uid, index, score); a uid without one fails."""
    base = baselines.groupBy("uid").agg(F.max_by("score", "index").alias("__b"))
    none = F.raise_error(F.lit("a prompt has no baseline")).cast("double")
    return rows.join(base, "uid", "left").withColumn("baseline", F.coalesce("__b", none)).drop("__b")


class KLController:
    """The weight of the KL penalty; adaptive if a target and a horizon are given."""

    def __init__(self, beta: float, target: float | None = None, horizon: float | None = None):
        if target is not None and not (horizon and horizon > 0):
            raise ValueError("the horizon must be positive")
        self.beta, self.target, self.horizon = beta, target, horizon

    def update(self, current: float, steps: int) -> float:
        if self.target is not None:
            self.beta *= 1 + max(-0.2, min(0.2, current / self.target - 1)) * steps / self.horizon
        return self.beta


def advantage(name: str, seqs: DataFrame, tokens: DataFrame | None = None, resampled: str | None = None, **options) -> DataFrame:
    """By an estimator's name: of sequences, or of tokens if it is one of tokens. Tokens without a mask count all. resampled: after token
    advantages, sequences (with score) are drawn anew by that rule, and come with their tokens, as many times as drawn (`draw`)."""
    if name not in TOKEN:
        return SEQUENCE[name](seqs, **options)
    if "mask" not in tokens.columns:
        tokens = tokens.withColumn("mask", F.lit(1))
    out = TOKEN[name](tokens, **options)
    return out.join(resample(seqs, resampled).select("seq_id", "draw"), "seq_id") if resampled else out


def batch_kl(tokens: DataFrame) -> DataFrame:
    """kl: one row, the mean over sequences of the masked mean of their tokens' kl; 0 of none."""
    by_seq = tokens.groupBy("seq_id").agg((F.sum("kl") / (F.sum("mask") + EPS)).alias("k"))
    return by_seq.agg(F.coalesce(F.avg("k"), F.lit(0.0)).alias("kl"))


def adapted(beta: Column, current: Column, target: float, horizon: float, steps: int) -> Column:
    """The adaptive weight of the KL penalty after so many steps at the current divergence."""
    return beta * (1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), current / target - 1)) * steps / horizon)


def kl_step(tokens: DataFrame, penalty: Column, controller: KLController, steps: int) -> tuple[DataFrame, float]:
    """kl_rewards with the controller's weight, and the batch's KL (the mean over sequences of their masked means), by which the weight then moves."""
    out = kl_rewards(tokens, penalty, controller.beta)
    current = float(batch_kl(out).first()[0])
    controller.update(current, steps)
    return out, current
