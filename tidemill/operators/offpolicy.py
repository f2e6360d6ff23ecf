"""Off-policy correction over token rows (seq_id, pos, mask, old_lp, rollout_lp): importance weights, rejection masks and diagnostics.

One window partition, seq_id, serves all statistics of a sequence; the metrics are one aggregate by sequence and one over those."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.masked import EPS, clip, masked, masked_mean, masked_sum, scalar_join

BOUND = 20.0
TOKEN_OPTIONS = ("token_k1", "token_k2", "token_k3")
OPTIONS = (*TOKEN_OPTIONS, *(f"seq_{how}_k{k}" for how in ("sum", "mean") for k in (1, 2, 3)), "seq_max_k2", "seq_max_k3")


def weight_bounds(spec: float | int | str) -> tuple[float, float | None]:
    """Upper and lower bound of importance weights: a number or "u" has no lower one, "l_u" both."""
    if isinstance(spec, bool) or not isinstance(spec, int | float | str):
        raise TypeError(f"a threshold is a number or a string, not {type(spec).__name__}")
    parts = [p.strip() for p in spec.split("_")] if isinstance(spec, str) else [spec]
    if len(parts) > 2 or any(p == "" for p in parts):
        raise ValueError(f"not a threshold: {spec!r}")
    values = [float(p) for p in parts]
    if any(v <= 0 or math.isnan(v) for v in values) or len(values) == 2 and values[0] > values[1]:
        raise ValueError(f"thresholds must be positive, the lower one first: {spec!r}")
    return values[-1], values[0] if len(values) == 2 else None


def rejection_options(options: str, spec: float | str | None) -> dict[str, tuple[float, float | None]]:
    """Each option, once, with its bounds: k1 options have two ("l_u", or "u" with l = 1 / u), the others an upper one."""
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    if unknown := [o for o in names if o not in OPTIONS] or [options] * (not names):
        raise ValueError(f"unknown rejection options {unknown}; there are {OPTIONS}")
    if spec is None:
        raise ValueError("a rejection threshold is needed")
    given = [p.strip() for p in str(spec).split(",")]
    if len(given) == 1:
        given *= len(names)
    if len(given) != len(names):
        raise ValueError("one threshold for all options, or one each")
    out = {}
    for name, text in zip(names, given, strict=True):
        upper, lower = weight_bounds(text)
        if name.endswith("k1"):
            out[name] = upper, 1 / upper if lower is None else lower
        elif lower is not None:
            raise ValueError(f"{name} has an upper bound only: {text!r}")
        else:
            out[name] = upper, None
    return out


def log_ratio() -> Column:
    return F.col("old_lp") - F.col("rollout_lp")


def _seq() -> Window:
    return Window.partitionBy("seq_id")


def importance_weights(rows: DataFrame, level: str = "token", threshold: float | str = 2.0, normalise: bool = False) -> DataFrame:
    """rows with raw_weight and weight (0 without mask): of the token's ratio or its sequence's product; cut at the upper bound, or, with
    a lower bound too, 0 outside; normalise: by the mean of the weights (of the sequences' means)."""
    upper, lower = weight_bounds(threshold)
    if level == "token":
        x = log_ratio()
    elif level == "sequence":
        x = F.sum(masked(log_ratio(), "mask")).over(_seq())
    else:
        raise ValueError(f"weights are of a token or a sequence, not {level!r}")
    out = rows.withColumn("raw_weight", F.exp(clip(x, -BOUND, BOUND)) * F.col("mask"))
    raw = F.col("raw_weight")
    out = out.withColumn("weight", F.least(raw, F.lit(upper)) if lower is None else F.when((raw >= lower) & (raw <= upper), raw).otherwise(0.0))
    if normalise:
        if level == "token":
            mean = out.agg(masked_mean("weight", "mask").alias("__m"))
        else:
            mean = out.groupBy("seq_id").agg(masked_mean("weight", "mask").alias("x"), F.sum("mask").alias("n")).where("n > 0").agg(F.avg("x").alias("__m"))
        out = scalar_join(out, mean).withColumn("weight", F.when(F.col("__m") > EPS, F.col("weight") / F.col("__m")).otherwise(F.col("weight"))).drop("__m")
    return out


def weight_metrics(rows: DataFrame, level: str = "token", threshold: float | str = 2.0) -> DataFrame:
    """One row of statistics over rows with raw_weight and weight."""
    upper, lower = weight_bounds(threshold)
    low = 1 / upper if lower is None else lower
    share = lambda c: masked_mean(F.when(c, 1.0).otherwise(0.0), "mask")
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    cut = clip("weight", 0.0, upper)
    on, raw = F.col("mask") != 0, F.col("raw_weight")
    of_tokens = {"mean": masked_mean("weight", "mask"), "m1": masked_mean(cut, "mask"), "m2": masked_mean(cut * cut, "mask")}
    if level == "token":
        of_tokens |= {"max": F.max(F.when(on, F.col("weight"))), "min": F.min(F.when(on, F.col("weight"))), "fraction_high": share(raw > upper), "fraction_low": share(raw < low)}
    if lower is not None:
        of_tokens["oob_ratio"] = share((raw < lower) | (raw > upper))
    tokens = rows.agg(*(c.alias(k) for k, c in of_tokens.items()))
    by_seq = rows.groupBy("seq_id").agg(masked_mean("weight", "mask").alias("w"), masked_sum(log_ratio(), "mask").alias("s"))
    of_seqs = {"seq_mean": F.avg("w"), "seq_std": F.coalesce(F.stddev_samp("w"), F.lit(0.0)), "seq_max": F.max("w"), "seq_min": F.min("w"), "seq_max_deviation": F.max(F.abs(F.col("w") - 1)), "seq_fraction_high": flag(F.col("w") > upper), "seq_fraction_low": flag(F.col("w") < low)}
    if level == "sequence":
        of_seqs |= {"max": F.exp(F.least(F.max("s"), F.lit(BOUND))), "min": F.exp(F.min("s")), "fraction_high": flag(F.col("s") > math.log(upper)), "fraction_low": flag(F.col("s") < math.log(low))}
    out = scalar_join(tokens, by_seq.agg(*(c.alias(k) for k, c in of_seqs.items())))
    normal = F.col("m1") + EPS
    return out.withColumns({"std": F.sqrt(F.greatest(F.col("m2") - F.col("m1") ** 2, F.lit(0.0))), "eff_sample_size": normal * normal / F.col("m2")}).drop("m1", "m2")


def _statistic(option: str) -> Column:
    """Of a token, or of its sequence, the value that an option bounds."""
    d = clip(log_ratio(), -BOUND, BOUND)
    x = {"1": -d, "2": 0.5 * d * d, "3": F.exp(d) - 1 - d}[option[-1]]
    if option in TOKEN_OPTIONS:
        return x
    how, w = option.split("_")[1], _seq()
    if how == "max":
        return F.coalesce(F.max(F.when(F.col("mask") != 0, x)).over(w), F.lit(0.0))
    total = F.sum(masked(x, "mask")).over(w)
    return total if how == "sum" else total / (F.sum("mask").over(w) + EPS)


def _kept(option: str, bounds: tuple[float, float | None], x: Column) -> Column:
    upper, lower = bounds
    return (x >= math.log(lower)) & (x <= math.log(upper)) if option.endswith("k1") else x <= upper


def reject(rows: DataFrame, options: str, threshold: float | str | None) -> DataFrame:
    """rows with kept_mask: the mask where all options keep the token."""
    kept = F.lit(True)
    for option, bounds in rejection_options(options, threshold).items():
        kept = kept & _kept(option, bounds, _statistic(option))
    return rows.withColumn("kept_mask", F.when(kept, F.col("mask")).otherwise(0))


def rejection_metrics(rows: DataFrame, options: str, threshold: float | str | None) -> DataFrame:
    """option, mean, max, min, masked_fraction, seq_masked_fraction: a row per option, and one for `all` of them (without statistic)."""
    specs = rejection_options(options, threshold)
    out = rows.withColumns({f"__{o}": _statistic(o) for o in specs})
    keep = {o: _kept(o, b, F.col(f"__{o}")) for o, b in specs.items()}
    together = F.lit(True)
    for k in keep.values():
        together = together & k
    on = F.col("mask") != 0
    cases = F.explode(F.array(*(F.struct(F.lit(o).alias("option"), F.col(f"__{o}").alias("x"), k.alias("keep")) for o, k in keep.items()), F.struct(F.lit("all").alias("option"), F.lit(None).cast("double").alias("x"), together.alias("keep"))))
    long = out.where(on).select("seq_id", cases.alias("c")).select("seq_id", "c.*")
    by_seq = long.groupBy("option", "seq_id").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.max("x").alias("hi"), F.min("x").alias("lo"), F.sum(F.when(F.col("keep"), 0).otherwise(1)).alias("gone"))
    mean = F.sum("s") / (F.sum("n") + EPS)
    return by_seq.groupBy("option").agg(mean.alias("mean"), F.max("hi").alias("max"), F.min("lo").alias("min"), (F.sum("gone") / (F.sum("n") + EPS)).alias("masked_fraction"), F.avg(F.when(F.col("gone") > 0, 1.0).otherwise(0.0)).alias("seq_masked_fraction"))


def off_policy_metrics(rows: DataFrame) -> DataFrame:
    """One row: perplexities of both policies and how far apart they are. No valid token: fails."""
    d = log_ratio()
    by_seq = rows.groupBy("seq_id").agg(
        F.sum("mask").alias("n"), masked_mean("old_lp", "mask").alias("t"), masked_mean("rollout_lp", "mask").alias("r"), masked_sum(-d, "mask").alias("kl"),
        masked_sum(F.exp(d) - d - 1, "mask").alias("k3"), masked_sum(F.exp(2 * clip(d, -BOUND, BOUND)), "mask").alias("sq"), masked_sum(d, "mask").alias("s"))
    gap, n = F.col("r") - F.col("t"), F.sum("n") + EPS
    none = F.raise_error(F.lit("there is no valid token")).cast("double")
    return by_seq.agg(
        F.when(F.coalesce(F.sum("n"), F.lit(0)) == 0, none).otherwise(F.avg(F.exp(-F.col("t")))).alias("training_ppl"), F.avg(-F.col("t")).alias("training_log_ppl"),
        (F.sum("kl") / n).alias("kl"), (F.sum("k3") / n).alias("k3_kl"), F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(gap).alias("log_ppl_diff"), F.avg(F.abs(gap)).alias("log_ppl_abs_diff"), F.max(gap).alias("log_ppl_diff_max"), F.min(gap).alias("log_ppl_diff_min"), F.avg(F.exp(gap)).alias("ppl_ratio"),
        (F.sum("sq") / n - 1).alias("chi2_token"), (F.avg(F.exp(2 * clip("s", -BOUND, BOUND))) - 1).alias("chi2_seq"))


def correct(rows: DataFrame, level: str | None = None, threshold: float | str = 2.0, options: str | None = None, rejection: float | str | None = None, normalise: bool = False) -> DataFrame:
    """rows with the mask replaced by what rejection leaves, and weights if a level is given."""
    if level:
        rows = importance_weights(rows, level, threshold, normalise)
    return reject(rows, options, rejection).drop("mask").withColumnRenamed("kept_mask", "mask") if options else rows


def corrected(rows: DataFrame, level: str | None = None, threshold: float | str = 2.0, options: str | None = None, rejection: float | str | None = None, normalise: bool = False, prefix: str = "rollout_corr/") -> tuple[DataFrame, DataFrame]:
    """What correct gives, and the metrics (name, value) of all its steps: of the weights, of each rejection and all of them, and of how far the policies are apart; the last
    over the mask as it was."""
    tall = lambda df, names, label: df.select(F.explode(F.array(*(F.struct(F.concat(F.lit(prefix), label(k)).alias("name"), F.col(k).cast("double").alias("value")) for k in names))).alias("x")).select("x.*")
    wide = off_policy_metrics(rows)
    out = tall(wide, wide.columns, F.lit)
    if level:
        weights = weight_metrics(importance_weights(rows, level, threshold, normalise), level, threshold)
        out = out.unionByName(tall(weights, weights.columns, lambda k: F.lit(f"rollout_is_{'ratio_' if k.startswith('fraction') else ''}{k}")))
    if options:
        gone = rejection_metrics(rows, options, rejection)
        named = lambda k: F.concat(F.lit("rollout_rs_"), F.when(F.col("option") == "all", F.lit(k)).otherwise(F.concat("option", F.lit(f"_{k}"))))
        out = out.unionByName(tall(gone, [c for c in gone.columns if c != "option"], named).where("value IS NOT NULL"))
    return correct(rows, level, threshold, options, rejection, normalise), out


def bypass(rows: DataFrame) -> DataFrame:
    """The rollout's log probabilities stand for the old policy's."""
    if "rollout_lp" not in rows.columns:
        raise ValueError("there is no rollout_lp")
    return rows.withColumn("old_lp", F.col("rollout_lp"))
