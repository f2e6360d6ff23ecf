"""Masked statistics, as aggregate expressions over token rows and as queries where two passes are needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-8


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def masked(x: Column | str, m: Column | str) -> Column:
    """x where the mask is set, else 0, whatever x is there (null, NaN)."""
    return F.when(col(m) != 0, col(x) * col(m)).otherwise(F.lit(0.0))


def masked_sum(x: Column | str, m: Column | str) -> Column:
    return F.sum(masked(x, m))


def masked_mean(x: Column | str, m: Column | str) -> Column:
    return masked_sum(x, m) / (F.sum(col(m)) + EPS)


def scalar_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a table of a single row, which an aggregate without groups is."""
    return df.crossJoin(F.broadcast(one_row))


def masked_moments(df: DataFrame, x: Column | str, m: Column | str, by: Sequence[str] = (), unbiased: bool = True) -> DataFrame:
    """by, n, mean, var: the variance around the masked mean, from the moments of one pass. The mask is 0 or 1. A group with n of 0 or 1 fails if unbiased."""
    v = F.when(col(m) != 0, col(x))
    out = df.groupBy(*by).agg(F.sum(col(m)).alias("n"), masked_mean(x, m).alias("mean"), F.avg(v).alias("__avg"), F.var_pop(v).alias("__var"))
    var = F.coalesce((F.col("__var") + (F.col("__avg") - F.col("mean")) ** 2) * F.col("n"), F.lit(0.0)) / (F.col("n") + EPS)
    if unbiased:
        few = F.raise_error(F.lit("masked variance needs two values or more")).cast("double")
        var = F.when(F.col("n") < 2, few).otherwise(var * F.col("n") / (F.col("n") - 1))
    return out.select(*by, "n", "mean", var.alias("var"))


def whiten(df: DataFrame, x: str, m: str, out: str, shift_mean: bool = True) -> DataFrame:
    """df with `out`: x by the batch's masked mean and deviation, at all positions; with shift_mean False the mean is added back."""
    stats = masked_moments(df, x, m).select(F.col("mean").alias("__mean"), F.col("var").alias("__var"))
    z = (F.col(x) - F.col("__mean")) / F.sqrt(F.col("__var") + EPS)
    return scalar_join(df, stats).withColumn(out, z if shift_mean else z + F.col("__mean")).drop("__mean", "__var")


def clip(x: Column | str, low: Column | float | str, high: Column | float | str) -> Column:
    """x between bounds, which can be columns; where the bounds cross, the lower one."""
    lit = lambda v: F.lit(float(v)) if isinstance(v, int | float) else col(v)
    return F.greatest(F.least(col(x), lit(high)), lit(low))


def response_mask(df: DataFrame, token: str, eos: int | Sequence[int], seq: str = "seq_id", pos: str = "pos", out: str = "response_mask") -> DataFrame:
    """1 up to the first end token of a sequence, that one included, then 0."""
    ends = [eos] if isinstance(eos, int) else list(eos)
    before = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col(token).isin(ends).cast("int")).over(before), F.lit(0))
    return df.withColumn(out, (seen == 0).cast("int"))


def tail(array: Column | str, n: Column | int) -> Column:
    """The last n elements: the mask of the response in the mask of the whole."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n == 0, F.slice(col(array), F.lit(1), F.lit(0))).otherwise(F.slice(col(array), -n, n))


# logits as arrays
def log_sum_exp(logits: Column | str) -> Column:
    x = col(logits).cast("array<double>")
    top = F.array_max(x)
    return top + F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))


def entropy(logits: Column | str) -> Column:
    x = col(logits).cast("array<double>")
    lse = log_sum_exp(logits)
    return lse - F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - lse) * v)


def log_prob(logits: Column | str, label: Column | str) -> Column:
    return gather(col(logits).cast("array<double>"), label) - log_sum_exp(logits)


def gather(values: Column | str, label: Column | str) -> Column:
    """The value at a 0-based label."""
    return F.element_at(col(values), (col(label) + 1).cast("int"))


def sum_pi_squared(logits: Column | str) -> Column:
    doubled = F.transform(col(logits).cast("array<double>"), lambda v: 2 * v)
    return F.exp(log_sum_exp(doubled) - 2 * log_sum_exp(logits))


def group_mean_std(df: DataFrame, score: str, by: str | Sequence[str], eps: float = 1e-6) -> DataFrame:
    """by, mean, std, n: the sample deviation with eps as least variance; a single row: 0 and 1."""
    by = [by] if isinstance(by, str) else list(by)
    n = F.count("*")
    return df.groupBy(*by).agg(
        F.when(n <= 1, 0.0).otherwise(F.avg(score)).alias("mean"), F.when(n <= 1, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp(score), F.lit(eps)))).alias("std"), n.alias("n"))


def pearson(x: Column | str, y: Column | str, m: Column | str) -> Column:
    on = col(m) != 0
    return F.corr(F.when(on, col(x)), F.when(on, col(y)))


def token_diff(a: str, b: str, m: str, seq: str = "seq_id") -> list[Column]:
    """Aggregates of a sequence's rows: valid tokens that differ."""
    return [F.sum(F.when((F.col(m) != 0) & ~F.col(a).eqNullSafe(F.col(b)), 1).otherwise(0)).cast("long").alias("n_diff")]


def probability_gap(old: str, rollout: str, m: str) -> list[Column]:
    """Aggregates: valid tokens, and how far the policies' probabilities are apart on them (NaN where there are none)."""
    on = F.col(m) != 0
    gap = F.when(on, F.abs(F.exp(F.col(old)) - F.exp(F.col(rollout))))
    nan = lambda c: F.coalesce(c, F.lit(float("nan")))
    p, q = F.when(on, F.exp(F.col(old))), F.when(on, F.exp(F.col(rollout)))
    return [
        F.max(on.cast("int")).cast("long").alias("valid"), nan(F.max(gap)).alias("gap_max"), nan(F.avg(gap)).alias("gap_mean"), nan(F.stddev_samp(gap)).alias("gap_std"), nan(F.corr(p, q)).alias("pearson")]


def dense_index(df: DataFrame, label: str, out: str = "group_index") -> DataFrame:
    """Groups numbered from 0 in order of their labels. Labels that are all whole numbers keep their values: whole numbers and booleans by
    type, fractions all within 1e-6 of one, texts that all read as one ("0042" is 42 then). Null is a label like others, and no number. Only the
    distinct labels are put in order, in ranges."""
    from tidemill.operators.batch import ROW, numbered

    c, kind = F.col(label), dict(df.dtypes)[label]
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return df.withColumn(out, c.cast("long"))
    if kind in ("float", "double", "string"):
        whole = F.trim(c).rlike(r"^[+-]?\d{1,18}$") if kind == "string" else F.abs(c - F.rint(c)) <= 1e-6
        if df.agg(F.coalesce(F.bool_and(F.coalesce(whole, F.lit(False))), F.lit(False))).first()[0]:
            return df.withColumn(out, F.trim(c).cast("long") if kind == "string" else F.rint(c).cast("long"))
    labels = numbered(df.select(F.col(label).alias("__label")).distinct(), "__label").withColumnRenamed(ROW, out)
    return df.join(labels, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")


def across_workers(df: DataFrame, x: str, m: str | None = None) -> DataFrame:
    """One row over all rows, wherever they are: mean, max, min and sample deviation of x, and its masked mean."""
    mean = masked_mean(x, m) if m else F.avg(x)
    return df.agg(F.avg(x).alias("mean"), F.max(x).alias("max"), F.min(x).alias("min"), F.stddev_samp(x).alias("std"), mean.alias("masked_mean"))
