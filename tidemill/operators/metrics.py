"""Metrics over rollouts, and evaluation by repeated sampling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.masked import EPS, masked_mean, masked_sum, scalar_join
from tidemill.operators.resampling import exact_extremes, extremes, majorities, majority_values, sizes

RULES = ("mean", "sum", "min", "max")


def reduce_metrics(rows: DataFrame) -> DataFrame:
    """name, value: metrics named with "max" by their greatest value, else with "min" by the least, else by the mean. rows: name, value."""
    return rows.groupBy("name").agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.avg("value").alias("avg")).select(
        "name", F.when(F.contains("name", F.lit("max")), F.col("hi")).when(F.contains("name", F.lit("min")), F.col("lo")).otherwise(F.col("avg")).alias("value"))


def by_rule(rows: DataFrame) -> DataFrame:
    """name, value: by the aggregation that each row names (one for a metric, or the query fails). rows: name, agg, value."""
    unlike = F.raise_error(F.concat(F.lit("several aggregations for "), F.col("name"))).cast("double")
    known = F.when(F.col("agg") == "mean", F.col("avg")).when(F.col("agg") == "sum", F.col("sum")).when(F.col("agg") == "min", F.col("lo")).when(F.col("agg") == "max", F.col("hi"))
    wrong = F.raise_error(F.concat(F.lit("no such aggregation: "), F.col("agg"))).cast("double")
    sums = rows.groupBy("name").agg(F.min("agg").alias("agg"), F.max("agg").alias("other"), F.avg("value").alias("avg"), F.sum("value").alias("sum"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return sums.select("name", F.when(F.col("agg") != F.col("other"), unlike).when(F.col("agg").isin(*RULES), known).otherwise(wrong).alias("value"))


def across_ranks(rows: DataFrame) -> DataFrame:
    """name, value: means and sums over steps of the mean over ranks, extremes over all. rows: name, agg, rank, step, value; every rank must have as many steps."""
    counts = rows.groupBy("name", "rank").count().groupBy("name").agg(F.min("count").alias("least"), F.max("count").alias("most"))
    per_step = rows.groupBy("name", "agg", "step").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    uneven = F.raise_error(F.concat(F.lit("ranks have different numbers of values of "), F.col("name"))).cast("double")
    done = per_step.groupBy("name", "agg").agg(F.avg("m").alias("avg"), F.sum("m").alias("sum"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(counts, "name")
    pick = F.when(F.col("agg") == "mean", F.col("avg")).when(F.col("agg") == "sum", F.col("sum")).when(F.col("agg") == "min", F.col("lo")).otherwise(F.col("hi"))
    return done.select("name", F.when(F.col("least") != F.col("most"), uneven).otherwise(pick).alias("value"))


def data_metrics(seqs: DataFrame, tokens: DataFrame, max_response: int, critic: bool = True) -> DataFrame:
    """One row. seqs: score, reward, response_length, prompt_length; tokens: mask, advantage, returns, value. Scores are of sequences with a response."""
    alive = F.col("response_length") > 0
    cols = {}
    for name, c, on in (("score", "score", alive), ("reward", "reward", alive), ("response_length", "response_length", F.lit(True)), ("response_length_non_aborted", "response_length", alive), ("prompt_length", "prompt_length", F.lit(True))):
        v = F.when(on, F.col(c).cast("double"))
        for how, f in (("mean", F.avg), ("max", F.max), ("min", F.min)):
            cols[f"{name}_{how}"] = F.coalesce(f(v), F.lit(float("nan")))
    flag = lambda c, on=F.lit(True): F.coalesce(F.avg(F.when(on, F.when(c, 1.0).otherwise(0.0))), F.lit(float("nan")))
    cols |= {"response_clip_ratio": flag(F.col("response_length") >= max_response), "response_non_aborted_clip_ratio": flag(F.col("response_length") >= max_response, alive), "aborted_ratio": flag(~alive)}
    on = F.col("mask") != 0
    token_cols = {f"{c}_{how}": f(F.when(on, F.col(c))) for c in ("advantage", "returns", *(["value"] if critic else [])) for how, f in (("mean", F.avg), ("max", F.max), ("min", F.min))}
    if critic:
        error = F.when(on, F.col("returns") - F.col("value"))
        token_cols["explained_var"] = 1 - F.var_samp(error) / (F.var_samp(F.when(on, F.col("returns"))) + 1e-5)
    return scalar_join(seqs.agg(*(c.alias(k) for k, c in cols.items())), tokens.agg(*(c.alias(k) for k, c in token_cols.items())))


def timing_metrics(timings: DataFrame, seqs: DataFrame) -> DataFrame:
    """name, seconds, per_token_ms: generation by response tokens, other sections by all (null for sections that process none). timings: name, seconds."""
    tokens = seqs.agg(F.sum("response_length").alias("r"), F.sum(F.col("prompt_length") + F.col("response_length")).alias("a"))
    per = F.when(F.col("name") == "gen", F.col("r")).when(F.col("name").isin("ref", "values", "adv", "update_critic", "update_actor"), F.col("a"))
    return scalar_join(timings, tokens).select("name", "seconds", (F.col("seconds") * 1000 / per).alias("per_token_ms"))


def throughput(seqs: DataFrame, seconds: float, devices: int) -> DataFrame:
    total = F.sum(F.col("prompt_length") + F.col("response_length"))
    return seqs.agg(total.alias("total_tokens"), F.lit(seconds).alias("seconds"), (total / (seconds * devices)).alias("tokens_per_device_second"))


def variance_proxies(tokens: DataFrame, gradient_norm: float | None, weight: str | None = None) -> DataFrame:
    """One row: signal, total power and pure noise of the gradient, by squared norms of the tokens' gradients. tokens: seq_id, mask, advantage, old_lp, sum_pi_squared."""
    w = 1 - 2 * F.exp("old_lp") + F.col("sum_pi_squared")
    aggs = [masked_mean("advantage", "mask").alias("a"), masked_sum(w, "mask").alias("plain")]
    if weight:
        aggs += [masked_mean(weight, "mask").alias("rho"), masked_sum(w * F.col(weight) ** 2, "mask").alias("w")]
    by_seq = tokens.groupBy("seq_id").agg(*aggs)
    rho = F.col("rho") ** 2 if weight else F.lit(1.0)
    power = F.avg(rho * F.col("a") ** 2 * F.greatest("plain", F.lit(0.0)))
    out = by_seq.agg(power.alias("total_power"), F.avg(F.col("a") ** 2).alias("expected_a_squared"), F.avg("w" if weight else "plain").alias("expected_w"), F.count("*").alias("n"))
    signal = F.lit(float(gradient_norm) ** 2 if gradient_norm is not None else 0.0)
    noise = F.when((F.col("n") > 1) & F.lit(gradient_norm is not None), F.greatest(F.lit(0.0), (F.col("total_power") - signal) / (F.col("n") - 1))).otherwise(0.0)
    return out.withColumns({"signal_strength": signal, "pure_noise": noise}).drop("n")


# evaluation
def majority(votes: list, values: list[float]) -> float:
    """The first value with the most frequent vote (of equally frequent ones, the first)."""
    counts: dict = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    best = max(counts, key=counts.get)
    return next(x for v, x in zip(votes, values, strict=True) if v == best)


@lru_cache(maxsize=256)
def draws(size: int, subset: int, times: int = 1000, seed: int = 42) -> np.ndarray:
    """times x subset places below size, with replacement; the same for the same arguments."""
    return np.random.RandomState(seed).choice(size, size=(times, subset), replace=True)


def bootstrap(values: list, subset: int, reducers: Iterable, times: int = 1000, seed: int = 42) -> list[tuple[float, float]]:
    """Mean and population deviation of each reducer over subsets drawn with replacement."""
    if not len(values):
        raise ValueError("nothing to draw from")
    at = draws(len(values), subset, times, seed)
    out = []
    for f in reducers:
        got = np.array([f([values[i] for i in row]) for row in at], float)
        out.append((float(got.mean()), float(got.std())))
    return out


def group_metrics(values: list[float], votes: list | None = None, times: int = 1000, seed: int = 42) -> dict[str, float]:
    """Of one prompt's values: mean@n, and for n > 1 std@n and, for each size, best, worst and (with votes) majority by bootstrap."""
    x, n = np.asarray(values, float), len(values)
    out = {f"mean@{n}": float(x.mean())}
    if n == 1:
        return out
    out[f"std@{n}"] = float(x.std())
    for k in sizes(n):
        at = draws(n, k, times, seed)
        for name, got in (("best", x[at].max(1)), ("worst", x[at].min(1))):
            out[f"{name}@{k}/mean"], out[f"{name}@{k}/std"] = float(got.mean()), float(got.std())
        if votes is not None:
            got = majority_values(x, pd.factorize(pd.Series(list(votes), dtype=object), use_na_sentinel=False)[0], at)
            out[f"maj@{k}/mean"], out[f"maj@{k}/std"] = float(got.mean()), float(got.std())
    return out


def validation_metrics(rows: DataFrame, variables: list[str], vote: str | None = None, times: int = 1000, seed: int = 42, draws: str = "counter") -> DataFrame:
    """data_source, variable, metric, value: of each prompt mean@n, and for n > 1 std@n and, for each subset size, best, worst and (with votes) majority
    over subsets drawn with replacement; then their mean over prompts. rows: data_source, uid, order, the variables (numbers; null ones are
    passed over).

    draws: `counter`, in which best and worst are weighted sums (see resampling); `exact`, their expectations, and majorities by counter; or
    `numpy`, a seeded generator's, prompt by prompt. times 0: means and deviations only."""
    if draws not in ("counter", "exact", "numpy"):
        raise ValueError(f"no such draws: {draws!r}")
    long = rows.select("data_source", "uid", "order", *([F.col(vote).cast("string").alias("vote")] if vote else []), F.explode(F.create_map(*(x for v in variables for x in (F.lit(v), F.col(v).cast("double"))))).alias("variable", "value")).where("value is not null")
    by = ("data_source", "uid", "variable")
    named = lambda name, n: F.concat(F.lit(f"{name}@"), n.cast("string"))
    moments = long.groupBy(*by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    plain = F.array(F.struct(named("mean", F.col("n")).alias("metric"), F.col("mean").alias("value")), F.struct(named("std", F.col("n")).alias("metric"), F.when(F.col("n") > 1, F.col("std")).alias("value")))
    out = moments.select(*by, F.inline(plain)).where("value is not null")
    if times:
        # a prompt's values, in order: as many as it has samples
        item = F.struct("order", "value", *(["vote"] if vote else []))
        grouped = long.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("xs")).where("n > 1")
        if draws == "numpy":
            out = out.unionByName(_numpy_draws(grouped, bool(vote), times, seed))
        else:
            prompts = grouped.select(*by, "n", F.array_sort("xs.value").alias("xs"))
            found = exact_extremes(prompts) if draws == "exact" else extremes(prompts, times, seed)
            out = out.unionByName(_tall(found, by, ("best", "worst")))
            if vote:
                own = grouped.select(*by, "n", F.col("xs.value").alias("xs"), F.col("xs.vote").alias("votes"))
                out = out.unionByName(_tall(majorities(own, times, seed), by, ("maj",)))
    return out.groupBy("data_source", "variable", "metric").agg(F.avg("value").alias("value"))


def _tall(found: DataFrame, by: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """by, metric, value from columns <name>_mean and <name>_std of subset sizes k."""
    rows = [F.struct(F.concat(F.lit(f"{x}@"), F.col("k").cast("string"), F.lit(f"/{of}")).alias("metric"), F.col(f"{x}_{of}").alias("value")) for x in names for of in ("mean", "std")]
    return found.select(*by, F.inline(F.array(*rows)))


def _numpy_draws(grouped: DataFrame, vote: bool, times: int, seed: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row, (xs, votes) in enumerate(zip(pdf["xs"], pdf["votes"], strict=True)):
                got = group_metrics(list(xs), list(votes) if vote else None, times, seed)
                rows += [(row, m, v) for m, v in got.items() if not m.startswith(("mean@", "std@"))]
            out = pdf[["data_source", "uid", "variable"]].iloc[[r[0] for r in rows]].reset_index(drop=True)
            yield out.assign(metric=[r[1] for r in rows], value=[r[2] for r in rows])

    kinds = dict(grouped.dtypes)
    arrays = grouped.select("data_source", "uid", "variable", F.col("xs.value").alias("xs"), (F.col("xs.vote") if vote else F.lit(None).cast("array<string>")).alias("votes"))
    return arrays.mapInPandas(work, f"data_source {kinds['data_source']}, uid {kinds['uid']}, variable string, metric string, value double")


def metric_cube(rows: DataFrame, dims: list[str], value: str, sets: list[list[str]] | None = None) -> DataFrame:
    """dims (null where a set leaves them out), grouping_id, n, mean, std (of all rows, not a sample), least and most of value, for each of several sets of dims (else all
    there are) in one aggregate. grouping_id has a bit for each dim, the first the highest, which is 1 where it is left out, so that a null of the
    rows is told from it. Null values are not counted."""
    every = sets if sets is not None else [[d for k, d in enumerate(dims) if not mask >> k & 1] for mask in range(1 << len(dims))]
    if wrong := [d for s in every for d in s if d not in dims]:
        raise ValueError(f"no such dimensions: {wrong}")
    named = rows.select(*dims, F.col(value).alias("__v"))
    v = F.col("__v")
    got = named.groupingSets([[F.col(d) for d in s] for s in every], *dims).agg(F.grouping_id().alias("grouping_id"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"))
    return got.select(*dims, "grouping_id", "n", "mean", "std", "least", "most")


def validation_names(metrics: DataFrame) -> DataFrame:
    """metrics with `name`: val-core for the core variable's (acc, else reward) mean, majority and best at the greatest n, val-aux for the rest."""
    n = F.regexp_extract("metric", r"@(\d+)", 1).cast("int")
    w = Window.partitionBy("data_source")
    core = F.when(F.max((F.col("variable") == "acc").cast("int")).over(w) == 1, "acc").otherwise("reward")
    is_core = (F.col("variable") == core) & F.col("metric").rlike("^(mean|maj|best)") & (n == F.max(n).over(w)) & ~F.col("metric").endswith("/std")
    return metrics.withColumn("name", F.concat_ws("/", F.when(is_core, "val-core").otherwise("val-aux"), "data_source", "variable", "metric"))


def offline_eval(rows: DataFrame, score: Column) -> DataFrame:
    """data_source, score: the mean over rows of the mean over a row's responses. rows: row_id, data_source, responses; score: of column `response`."""
    long = rows.select("*", F.explode("responses").alias("response"))
    per_row = long.withColumn("__s", score).groupBy("data_source", "row_id").agg(F.avg("__s").alias("s"))
    return per_row.groupBy("data_source").agg(F.avg("s").alias("score"))


def speculative(rows: DataFrame) -> DataFrame:
    """One row: mean acceptance rate and length over rows of accepted, drafted, verified (0 where nothing was drafted or verified)."""
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    length = F.when(F.col("verified") > 0, 1 + F.col("accepted") / F.col("verified")).otherwise(0.0)
    return rows.agg(F.avg(rate("accepted", "drafted")).alias("acceptance_rate"), F.avg(length).alias("acceptance_length"))


def slowest(rows: DataFrame, parts: list[str], details: list[str]) -> DataFrame:
    """One row: least, greatest and mean of each part's time, and the details of the row of greatest total."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    worst = F.max_by(F.struct(*parts, *details), F.struct(total, *details))
    out = rows.agg(*(f(p).alias(f"{p}_{n}") for p in parts for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))), worst.alias("w"))
    return out.select(*(c for c in out.columns if c != "w"), *(F.col(f"w.{c}").alias(f"slowest_{c}") for c in (*parts, *details)))


def rule_of(name: str, explicit: Mapping[str, str] | None = None) -> str:
    """How a metric of this name is put together: by an explicit rule, else by what its name holds, in this order."""
    if explicit and name in explicit:
        return explicit[name]
    low = name.lower()
    for parts, rule in ((("timing_s/",), "sum"), (("mean", "avg"), "avg"), (("max",), "max"), (("min",), "min"), (("sum", "total"), "sum")):
        if any(p in low for p in parts):
            return rule
    return "avg"


def aggregate_steps(rows: DataFrame, explicit: Mapping[str, str] | None = None) -> DataFrame:
    """name, value: metrics of several steps as one, by rule_of. rows: name, value, weight (for rule `weighted_avg`)."""
    low = F.lower("name")
    has = lambda *parts: F.greatest(*(F.contains(low, F.lit(p)) for p in parts), F.lit(False))
    rule = F.when(has("timing_s/"), "sum").when(has("mean", "avg"), "avg").when(has("max"), "max").when(has("min"), "min").when(has("sum", "total"), "sum").otherwise("avg")
    if explicit:
        given = F.create_map(*(F.lit(x) for kv in explicit.items() for x in kv))
        rule = F.coalesce(F.try_element_at(given, F.col("name")), rule)
    sums = rows.groupBy("name").agg(F.sum("value").alias("sum"), F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("weighted_avg"))
    pick = F.col("avg")
    for r in ("sum", "max", "min", "weighted_avg"):
        pick = F.when(rule == r, F.col(r)).otherwise(pick)
    return sums.select("name", pick.alias("value"))


def specials(metrics: DataFrame, devices: int) -> DataFrame:
    """name, value: metrics over steps, with those anew that follow from others: the spread of sequence lengths, the throughput, and the
    share of a step that generation takes (each only if what it needs is there)."""
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    needed = {"hi": "global_seqlen/max", "lo": "global_seqlen/min", "diff": "global_seqlen/minmax_diff", "rate": "perf/throughput", "tokens": "perf/total_num_tokens", "time": "perf/time_per_step", "gen": "timing_s/gen", "step": "timing_s/step"}
    row = metrics.agg(*(one(n).alias(k) for k, n in needed.items()))
    made = {
        needed["diff"]: F.when(F.col("diff").isNotNull(), F.col("hi") - F.col("lo")),
        needed["rate"]: F.when(F.col("rate").isNotNull(), F.col("tokens") / (F.col("time") * devices)),
        "fully_async/trainer/idle_ratio": F.col("gen") / F.col("step"),
    }
    new = row.select(F.explode(F.create_map(*(x for n, c in made.items() for x in (F.lit(n), c)))).alias("name", "value")).where("value is not null")
    return metrics.join(new.select("name"), "name", "left_anti").select("name", "value").unionByName(new)


def merged_validation(*runs: DataFrame | None) -> DataFrame:
    """The rows of several validation runs, to be reduced as one; a run that did not take place is passed over, columns that one lacks are null."""
    given = [r for r in runs if r is not None]
    if not given:
        raise ValueError("there is no validation run")
    out = given[0]
    for r in given[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def component_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key, mean, std (of all rows, not a sample), max, min of each score component that rows have."""
    have = [k for k in keys if k in rows.columns]
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("v")) for k in have))).alias("x")).select("x.*")
    return long.groupBy("key").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("max"), F.min("v").alias("min"))


def response_info(rows: DataFrame, mask: str = "attention_mask", width: Column | int = 0) -> DataFrame:
    """rows with prompt_length and response_length, from an attention mask whose last `width` places are the response; a column: each row's own."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, v: x + v)
    n = F.size(mask) - width
    return rows.withColumns({"prompt_length": total(F.slice(mask, F.lit(1), n)), "response_length": total(F.slice(mask, n + 1, F.lit(width)))})


def spread_stats(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """by, mean, max, min, p50, p95, p99 (linear between values)."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), p.alias("p"))
    return out.select(*by, "mean", "max", "min", *(F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


def staleness_stats(rows: DataFrame) -> DataFrame:
    """One row over samples of min_version and max_version: partial ones (of several versions), their share and greatest span, and how many versions there are."""
    span = F.col("max_version") - F.col("min_version")
    partial = F.when(span > 0, 1).otherwise(0)
    return rows.agg(F.sum(partial).alias("partial"), F.avg(partial.cast("double")).alias("partial_ratio"), F.max(span).alias("max_span"), F.countDistinct("max_version").alias("versions"))


def imbalance(rows: DataFrame, parts: int) -> DataFrame:
    """One row: sums of seqlen over `parts` runs of consecutive rows (row_idx from 0), and over the balanced partition given, if any, in column `part`."""
    n = rows.agg(F.count("*").alias("n"))
    chunk = F.floor(F.col("row_idx") * parts / F.col("n"))
    plain = scalar_join(rows, n).groupBy(chunk.alias("c")).agg(F.sum("seqlen").alias("s")).agg(F.min("s").alias("minmax_min"), F.max("s").alias("minmax_max"), F.avg("s").alias("mean"))
    out = plain.withColumn("minmax_diff", F.col("minmax_max") - F.col("minmax_min"))
    if "part" in rows.columns:
        out = scalar_join(out, rows.groupBy("part").agg(F.sum("seqlen").alias("s")).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max")))
    return out


def dense_parameters(c: Mapping[str, float]) -> tuple[float, float]:
    """Of a decoder by its configuration: parameters that each token meets, and the factor of squared lengths."""
    head = c.get("head_dim", c["hidden_size"] // c["heads"])
    attention = c["hidden_size"] * head * 2 * (c["heads"] + c["kv_heads"])
    return (3 * c["hidden_size"] * c["intermediate_size"] + attention) * c["layers"] + 2 * c["vocab_size"] * c["hidden_size"], head * c["heads"] * c["layers"]


def expert_parameters(c: Mapping[str, float]) -> tuple[float, float]:
    """As dense, each token meeting a router and the few experts it chooses."""
    head = c.get("head_dim", c["hidden_size"] // c["heads"])
    attention = c["hidden_size"] * head * 2 * (c["heads"] + c["kv_heads"])
    experts = c["hidden_size"] * c["experts"] + 3 * c["hidden_size"] * c["expert_size"] * c["chosen"]
    return (experts + attention) * c["layers"] + 2 * c["vocab_size"] * c["hidden_size"], head * c["heads"] * c["layers"]


def latent_parameters(c: Mapping[str, float]) -> tuple[float, float]:
    """Latent attention, dense layers first, then layers of shared and chosen experts."""
    h, q_head, layers = c["hidden_size"], c["nope_dim"] + c["rope_dim"], c["layers"]
    query = h * c["heads"] * q_head if not c.get("q_rank") else h * c["q_rank"] + c["heads"] * q_head * c["q_rank"]
    attention = query + h * (c["kv_rank"] + c["rope_dim"]) + c["heads"] * (q_head - c["rope_dim"] + c["v_dim"]) * c["kv_rank"] + c["heads"] * c["v_dim"] * h
    experts = h * c["experts"] + 3 * h * c["expert_size"] * (c["chosen"] + c["shared"])
    total = experts * (layers - c["dense_layers"]) + 3 * h * c["intermediate_size"] * c["dense_layers"] + attention * layers + 2 * c["vocab_size"] * h
    return total, layers * (q_head + c["v_dim"]) * c["heads"] / 2  # half, since the square's factor is 3 here and 6 elsewhere


ARCHITECTURES: Mapping[str, Callable[[Mapping[str, float]], tuple[float, float]]] = {
    **dict.fromkeys(("qwen2", "llama", "mistral", "qwen3", "minicpm"), dense_parameters), **dict.fromkeys(("qwen2_moe", "qwen3_moe"), expert_parameters), "deepseek_v3": latent_parameters}


def flops(rows: DataFrame, parameters: float, head_dim: int, heads: int, layers: int, seconds: float) -> DataFrame:
    """One row: teraflops a second of training a dense transformer on sequences of `seqlen`."""
    work = 6 * parameters * F.sum("seqlen") + 6.0 * F.sum(F.col("seqlen") * F.col("seqlen")) * head_dim * heads * layers
    return rows.agg((work / seconds / 1e12).alias("tflops"))


def flops_of(rows: DataFrame, kind: str, config: Mapping[str, float], seconds: float) -> DataFrame:
    """One row: teraflops a second by a model's kind and configuration; 0 for a kind that is not known."""
    if kind not in ARCHITECTURES:
        return rows.agg(F.max(F.lit(0.0)).alias("tflops"))
    parameters, square = ARCHITECTURES[kind](config)
    work = F.lit(6.0 * parameters) * F.sum("seqlen") + F.lit(6.0 * square) * F.sum(F.col("seqlen").cast("double") * F.col("seqlen"))
    return rows.agg((work / seconds / 1e12).alias("tflops"))


def sanitised(key: Column) -> Column:
    """A metric's name as a tracking server takes it."""
    return F.regexp_replace(F.regexp_replace(F.replace(key, F.lit("@"), F.lit("_at_")), "/+", "/"), r"[^/\w.\- :]", "_")


def flattened(config: Mapping, prefix: str = "") -> dict[str, object]:
    """A nested mapping with its keys joined by slashes."""
    out: dict[str, object] = {}
    for k, v in config.items():
        key = f"{prefix}/{k}" if prefix else str(k)
        out |= flattened(v, key) if isinstance(v, Mapping) else {key: v}
    return out


def met(lines: Iterable[str], metric: str, target: float) -> bool:
    """Whether the best value that log lines give for a metric is over the target."""
    found = [float(m) for line in lines for m in re.findall(rf"{re.escape(metric)}[:=]\s*(-?\d+(?:\.\d+)?(?:e-?\d+)?)", line)]
    return bool(found) and max(found) > target


