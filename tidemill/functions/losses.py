"""Policy, value and distillation losses as per-token expressions, and their aggregation.

Token rows: seq_id, mask, new_lp, old_lp, advantage. A loss is a builder of columns: `loss` per token, and aggregates for its metrics.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.draws import word
from tidemill.functions.masked import EPS, clip, masked_mean, masked_sum, scalar_join
from tidemill.functions.registry import Registry
from tidemill.operators.batch import ROW, numbered

POLICY = Registry("policy loss")
MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


def _cols() -> tuple[Column, Column, Column]:
    return F.col("new_lp"), F.col("old_lp"), F.col("advantage")


def _step(limit: float | None = 20.0) -> Column:
    new, old, _ = _cols()
    return clip(new - old, -limit, limit) if limit else new - old


def agg_loss(rows: DataFrame, loss: str = "loss", mode: str = "token-mean", mask: str = "mask", seq: str = "seq_id", norm: float | None = None, batch_tokens: float | None = None, workers: int = 1) -> DataFrame:
    """One row with `loss` over all tokens. Sequences without a valid token do not count in the means over sequences."""
    if mode == "token-mean":
        if workers > 1 and batch_tokens is None:
            raise ValueError("with several workers, the batch's number of tokens is needed")
        total = masked_sum(loss, mask) / (F.lit(float(batch_tokens)) if batch_tokens else F.sum(mask))
        return rows.agg((total * workers).alias("loss"))
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {MODES}")
    per = masked_mean(loss, mask) if mode == "seq-mean-token-mean" else masked_sum(loss, mask)
    by_seq = rows.groupBy(seq).agg(per.alias("x"), F.sum(mask).alias("n")).where("n > 0")
    if mode != "seq-mean-token-sum-norm":
        return by_seq.agg(F.avg("x").alias("loss"))
    width = rows.groupBy(seq).count().agg(F.max("count").alias("w"))  # the padded length, if no scale is given
    out = by_seq.agg(F.avg("x").alias("x"))
    return out.select((F.col("x") / F.lit(float(norm))).alias("loss")) if norm else scalar_join(out, width).select((F.col("x") / F.col("w")).alias("loss"))


@dataclass
class Built:
    """rows with `loss`, the metrics over them, and the only mode that the loss knows, if there is one."""

    rows: DataFrame
    metrics: dict[str, Column] = field(default_factory=dict)
    mode: str | None = None

    def result(self, mode: str = "token-mean", **options) -> DataFrame:
        out = agg_loss(self.rows, mode=self.mode or mode, **options)
        return scalar_join(out, self.rows.agg(*(c.alias(k) for k, c in self.metrics.items()))) if self.metrics else out


def _metrics(clipped: Column | None, lower: Column | None = None, step: Column | None = None) -> dict[str, Column]:
    frac = lambda c: masked_mean(F.when(c, 1.0).otherwise(0.0), "mask")
    return {"clipfrac": frac(clipped) if clipped is not None else F.max(F.lit(0.0)), "kl": masked_mean(-(_step() if step is None else step), "mask"), "clipfrac_lower": frac(lower) if lower is not None else F.max(F.lit(0.0))}


@POLICY.register("vanilla")
def vanilla(rows: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 3.0) -> Built:
    """Clipped ratios, and for negative advantages no loss above c times the advantage."""
    if c <= 1:
        raise ValueError("c must be over 1")
    _, _, a = _cols()
    r = F.exp(_step())
    plain, cut = -a * r, -a * clip(r, 1 - low, 1 + high)
    upper, cap = F.greatest(plain, cut), -a * c
    return Built(rows.withColumn("loss", F.when(a < 0, F.least(cap, upper)).otherwise(upper)), _metrics(cut > plain, (upper > cap) & (a < 0)))


def _dppo(rows: DataFrame, valid: Column, c: float) -> Built:
    new, _, a = _cols()
    r = F.exp(_step())
    return Built(rows.withColumn("loss", F.when(valid, -a * F.least(r, F.lit(c)) * new).otherwise(0.0)), _metrics(~valid, (r > c) & valid))


@POLICY.register("dppo_tv")
def dppo_tv(rows: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 20.0) -> Built:
    """Only tokens whose probability moved no further than a bound in the advantage's direction."""
    new, old, a = _cols()
    gap = F.exp(new) - F.exp(old)
    return _dppo(rows, F.when(a > 0, gap <= high).otherwise(gap >= -low), c)


@POLICY.register("dppo_kl")
def dppo_kl(rows: DataFrame, low: float = 0.2, high: float = 0.2, c: float = 20.0) -> Built:
    """Only tokens within a bound of binary KL divergence, or on the safe side."""
    new, old, a = _cols()
    p, q = F.exp(old), F.exp(new)
    kl = p * (old - new) + (1 - p) * F.log((1 - p + EPS) / (1 - q + EPS))
    return _dppo(rows, F.when(a > 0, (kl <= high) | (q <= p)).otherwise((kl <= low) | (q >= p)), c)


def _per_sequence(x: Column, least: float | None = None) -> Column:
    """The sequence's mean of x over valid tokens; least: of the denominator, else EPS is added to it."""
    w = Window.partitionBy("seq_id")
    n = F.sum("mask").over(w)
    return F.sum(F.when(F.col("mask") != 0, x).otherwise(0.0)).over(w) / (F.greatest(n, F.lit(least)) if least else n + EPS)


@POLICY.register("gspo")
def gspo(rows: DataFrame, low: float = 0.2, high: float = 0.2) -> Built:
    """One ratio for a sequence, of its tokens' mean step."""
    _, _, a = _cols()
    rows = rows.withColumn("__r", F.exp(F.least(_per_sequence(_step(None), 1), F.lit(10.0))))
    plain, cut = -a * F.col("__r"), -a * clip("__r", 1 - low, 1 + high)
    return Built(rows.withColumn("loss", F.greatest(plain, cut)), _metrics(cut > plain, None, _step(None)), "seq-mean-token-mean")


@POLICY.register("sapo")
def sapo(rows: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Built:
    """A soft gate in place of clipping, steeper for negative advantages."""
    _, _, a = _cols()
    tau = F.when(a > 0, F.lit(tau_pos)).otherwise(F.lit(tau_neg))
    gate = 1 / (1 + F.exp(-tau * (F.exp(_step()) - 1))) * (4 / tau)
    return Built(rows.withColumn("loss", -gate * a), _metrics(None), "seq-mean-token-mean")


@POLICY.register("gpg")
def gpg(rows: DataFrame) -> Built:
    return Built(rows.withColumn("loss", -F.col("new_lp") * F.col("advantage")))


@POLICY.register("reinforce")
def reinforce(rows: DataFrame, weight: str | None = None) -> Built:
    x = -F.col("new_lp") * F.col("advantage")
    return Built(rows.withColumn("loss", x * F.col(weight) if weight else x), {"kl": masked_mean(-_step(None), "mask")})


@POLICY.register("cispo")
def cispo(rows: DataFrame, low: float = 0.2, high: float = 0.2) -> Built:
    """The clipped ratio as a weight."""
    new, _, a = _cols()
    r = F.exp(_step())
    return Built(rows.withColumn("loss", -clip(r, 1 - low, 1 + high) * a * new), _metrics((r < 1 - low) | (r > 1 + high)))


def _covariance(rows: DataFrame, out: str) -> DataFrame:
    """(advantage - its mean) * (log probability - its mean), means over valid tokens."""
    means = rows.agg(masked_mean("advantage", "mask").alias("__a"), masked_mean("new_lp", "mask").alias("__l"), F.sum("mask").alias("__n"))
    return scalar_join(rows, means).withColumn(out, (F.col("advantage") - F.col("__a")) * (F.col("new_lp") - F.col("__l")))


def _with_first(rows: DataFrame, able: DataFrame, ratio: float) -> DataFrame:
    """rows with __s and __p, set in those of `able` with the greatest __by (ties by place): `ratio` times __n of them, 1 at least.

    Most of `able` goes by an approximate quantile, whose error is below the share; what is left is numbered in ranges. One task meets the
    quantile's sketches of all others, so they are no finer than the share needs."""
    share = F.greatest((F.col("__n") * ratio).cast("long"), F.lit(1))
    accuracy = max(1000, min(1_000_000, math.ceil(8 / ratio))) if ratio > 0 else 1_000_000
    counted = able.agg(F.count("*").alias("__all"), F.max("__n").alias("__n"), F.percentile_approx("__by", F.lit([1 - min(1.0, 4 * ratio + 4 / accuracy), 0.0]), accuracy).alias("__q"))
    # of few rows, or more than the quantile is for, all stay
    low = F.when(share < 4 * ratio * F.col("__all"), F.col("__q")[0]).otherwise(F.col("__q")[1])
    near = scalar_join(able, counted.select(low.alias("__low"), share.alias("__share"))).where(F.col("__by") >= F.col("__low"))
    first = numbered(near.select("seq_id", "pos", "__by", "__share"), F.col("__by").desc(), "seq_id", "pos").where(F.col(ROW) < F.col("__share"))
    top = first.select(F.col("seq_id").alias("__s"), F.col("pos").alias("__p"))
    return rows.join(top, (F.col("seq_id") == F.col("__s")) & (F.col("pos") == F.col("__p")), "left")


@POLICY.register("clip_cov")
def clip_cov(rows: DataFrame, low: float = 0.2, high: float = 0.2, ratio: float = 0.0002, least: float = 1.0, most: float = 5.0, seed: int = 0) -> Built:
    """A few tokens of high covariance, drawn by a hash of place and seed, get no loss."""
    _, _, a = _cols()
    r = F.exp(_step(None))
    plain, cut = -a * r, -a * clip(r, 1 - low, 1 + high)
    rows = _covariance(rows, "__cov").withColumn("__id", word("seq_id", "pos", seed))
    able = (F.col("mask") > 0) & ~(cut > plain) & (F.col("__cov") > least) & (F.col("__cov") < most)
    rows = _with_first(rows, rows.where(able).withColumn("__by", -F.col("__id").cast("double")), ratio)
    hit = F.col("__s").isNotNull()
    return Built(rows.withColumn("loss", F.when(hit, 0.0).otherwise(F.greatest(plain, cut))), {"clipfrac": masked_mean(F.when(hit, 1.0).otherwise(0.0), "mask"), "kl": masked_mean(-_step(None), "mask")})


@POLICY.register("kl_cov")
def kl_cov(rows: DataFrame, ratio: float = 0.0002, coef: float = 1.0) -> Built:
    """The tokens of greatest covariance (ties by place) pay for the size of their step."""
    rows = _covariance(rows, "__cov")
    rows = _with_first(rows, rows.where("mask > 0").withColumn("__by", F.col("__cov")), ratio)
    plain = -F.col("advantage") * F.exp(_step(None))
    return Built(rows.withColumn("loss", F.when(F.col("__s").isNotNull(), plain + coef * F.abs(_step(None))).otherwise(plain)), {"kl": masked_mean(F.abs(_step(None)), "mask")})


@POLICY.register("geo_mean")
def geo_mean(rows: DataFrame, low: float = 0.2, high: float = 0.2) -> Built:
    """Per sequence: minus the mean advantage times the geometric mean of ratios clipped on the advantage's side."""
    _, _, a = _cols()
    sign, d = F.signum(a), _step(None)
    bent = sign * F.least(sign * d, sign * clip(d, -low, high))
    w = Window.partitionBy("seq_id")
    rows = rows.withColumn("__loss", -_per_sequence(a) * F.exp(_per_sequence(bent))).withColumn("__first", F.row_number().over(w.orderBy("pos")) == 1)
    off = (d < -low) | (d > high)
    built = Built(rows, _metrics(off & (a > 0), off & (a < 0), d))
    built.result = lambda *_, **__: scalar_join(rows.where("__first").agg(F.avg("__loss").alias("loss")), rows.agg(*(c.alias(k) for k, c in built.metrics.items())))
    return built


@POLICY.register("bypass_mode")
def bypass_mode(rows: DataFrame, loss: str = "ppo_clip", level: str | None = None, threshold: float | str = 2.0, normalise: bool = False, options: str | None = None, rejection: float | str | None = None, **more) -> Built:
    """Rollout log probabilities stand for old ones (column old_lp): the mask loses what rejection leaves out, and then a clipped loss, or the
    plain gradient with importance weights of the current policy."""
    from tidemill.operators.offpolicy import correct

    if loss not in ("reinforce", "ppo_clip"):
        raise ValueError(f"no such loss in bypass mode: {loss!r}")
    moved = rows.withColumns({"__old": F.col("old_lp"), "rollout_lp": F.col("old_lp"), "old_lp": F.col("new_lp")})
    fixed = correct(moved, level, threshold, options, rejection, normalise).withColumn("old_lp", F.col("__old")).drop("__old")
    return vanilla(fixed, **more) if loss == "ppo_clip" else reinforce(fixed, "weight" if level else None, **more)


def policy_loss(name: str, rows: DataFrame, mode: str = "token-mean", **options) -> DataFrame:
    """One row: the loss by its name, and its metrics."""
    return POLICY[name](rows, **options).result(mode)


# value, KL, SFT and distillation
def value_loss(rows: DataFrame, predicted: str, old: str, returns: str, cut: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """One row: half the greater of the squared errors of the prediction and of the prediction kept near the old value."""
    free, held = (F.col(predicted) - F.col(returns)) ** 2, (clip(predicted, F.col(old) - cut, F.col(old) + cut) - F.col(returns)) ** 2
    out = agg_loss(rows.withColumn("loss", F.greatest(free, held)), mode=mode).select((F.col("loss") * 0.5).alias("loss"))
    return scalar_join(out, rows.agg(masked_mean(F.when(held > free, 1.0).otherwise(0.0), "mask").alias("clipfrac"), masked_mean(predicted, "mask").alias("mean")))


def kl_penalty(new: Column, ref: Column, kind: str) -> Column:
    """An estimate per token of the divergence; a + at the end of the kind makes no difference to the value."""
    d = new - ref
    match kind.removesuffix("+"):
        case "kl" | "k1":
            return d
        case "abs":
            return F.abs(d)
        case "mse" | "k2":
            return 0.5 * d * d
        case "low_var_kl" | "k3":
            back = clip(-d, -20.0, 20.0)
            return clip(F.exp(back) - back - 1, -10.0, 10.0)
    raise NotImplementedError(f"no KL estimate {kind!r}")


def entropy_loss(rows: DataFrame, entropy: str = "entropy", mode: str = "token-mean", **options) -> DataFrame:
    """One row: the entropy of tokens, aggregated as a loss is."""
    return agg_loss(rows, entropy, mode, **options)


def sft_loss(rows: DataFrame, log_prob: str = "new_lp", mask: str = "mask", batch_tokens: float | None = None) -> DataFrame:
    """One row: minus the log probabilities that predict a token with loss (its mask stands one place further on), over the tokens with loss."""
    after = F.coalesce(F.lead(mask).over(Window.partitionBy("seq_id").orderBy("pos")), F.lit(0))
    moved = rows.withColumn("__m", after)
    total = F.lit(float(batch_tokens)) if batch_tokens else F.sum("__m")
    return moved.agg((-F.sum(F.when(F.col("__m") != 0, F.col(log_prob)).otherwise(0.0)) / total).alias("loss"))


def total_loss(policy: Column, entropy: Column, kl: Column, entropy_coef: float = 0.0, kl_coef: float = 0.0) -> Column:
    return policy - entropy_coef * entropy + kl_coef * kl


def forward_kl_topk(teacher: str, student: str) -> dict[str, Column]:
    """Per row, of arrays of the teacher's top log probabilities and the student's on the same tokens: the divergence (0 at least) and both masses."""
    product = F.zip_with(teacher, student, lambda p, q: F.exp(p) * (p - q))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    mass = lambda c: add(F.transform(c, F.exp))
    return {"loss": F.greatest(add(product), F.lit(0.0)), "teacher_mass": mass(teacher), "student_mass": mass(student)}


DISTILLATION = Registry("distillation loss")


@DISTILLATION.register("forward_kl_topk")
def _topk(teacher: str = "teacher_lps", student: str = "student_lps") -> Column:
    return forward_kl_topk(teacher, student)["loss"]


for _kind in ("kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3"):
    DISTILLATION.register(_kind)(lambda teacher="ref_lp", student="new_lp", kind=_kind: kl_penalty(F.col(student), F.col(teacher), kind))


def overlap(teacher_ids: str, student_ids: str) -> Column:
    """How many of the top tokens both have."""
    return F.size(F.array_intersect(teacher_ids, student_ids)).cast("long")


def distillation(rows: DataFrame, loss: Column, most: float | None = None, as_policy: Callable[[DataFrame], Built] | None = None, mode: str = "token-mean") -> DataFrame:
    """One row: the (bounded) loss over tokens, or a policy loss whose advantage is minus the loss."""
    loss = F.least(loss, F.lit(most)) if most is not None else loss
    if as_policy:
        return as_policy(rows.withColumn("advantage", -loss)).result(mode)
    return agg_loss(rows.withColumn("loss", loss), mode=mode)
