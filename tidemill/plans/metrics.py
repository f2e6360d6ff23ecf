"""Queries of metrics and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import advantage as A
from tidemill.operators import metrics as M
from tidemill.plans.advantages import FORMULAS, r6, rounded
from tidemill.plans.views import VIEWS, scored, table, tokens

QUERIES, SQL = {}, {}
E8 = "CAST(1e-8 AS DOUBLE)"


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """name, agg, rank, step, value, weight: from all events, each on 4 ranks; a metric for each of 4 rules."""
    kind = F.element_at(F.array(*map(F.lit, ("mean", "sum", "min", "max"))), (F.col("event_id") % 4 + 1).cast("int"))
    ranks = F.explode(F.sequence(F.lit(0), F.lit(3)))
    e = table(spark, d, "events").select("event_id", F.coalesce("value", F.lit(0.0)).alias("v"), kind.alias("agg"), ranks.alias("rank"))
    return e.select(F.concat_ws("/", F.lit("m"), "agg").alias("name"), "agg", "rank", F.col("event_id").alias("step"), (F.col("v") + F.col("rank")).alias("value"), (F.col("event_id") % 7 + 1).alias("weight"))


ROWS = "WITH rows AS (SELECT 'm/' || k AS name, k AS agg, r AS rank, event_id AS step, coalesce(value, 0) + r AS value, event_id % 7 + 1 AS weight FROM (SELECT *, ['mean', 'sum', 'min', 'max'][event_id % 4 + 1] AS k FROM events), (SELECT unnest(range(4)) AS r))"
QUERIES["metric_reduce"] = lambda spark, d: rounded(M.reduce_metrics(metric_rows(spark, d)), "name", value="value")
SQL["metric_reduce"] = f"{ROWS} SELECT name, {r6('''CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END''', 'value')} FROM rows GROUP BY name"
QUERIES["metric_by_rule"] = lambda spark, d: rounded(M.by_rule(metric_rows(spark, d)), "name", value="value")
SQL["metric_by_rule"] = f"{ROWS} SELECT name, {r6('''CASE any_value(agg) WHEN 'mean' THEN avg(value) WHEN 'sum' THEN sum(value) WHEN 'min' THEN min(value) ELSE max(value) END''', 'value')} FROM rows GROUP BY name"
QUERIES["metric_across_ranks"] = lambda spark, d: rounded(M.across_ranks(metric_rows(spark, d)), "name", value="value")
SQL["metric_across_ranks"] = f"{ROWS}, s AS (SELECT name, agg, step, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM rows GROUP BY ALL) SELECT name, {r6('''CASE any_value(agg) WHEN 'mean' THEN avg(m) WHEN 'sum' THEN sum(m) WHEN 'min' THEN min(lo) ELSE max(hi) END''', 'value')} FROM s GROUP BY name"
QUERIES["metric_steps"] = lambda spark, d: rounded(M.aggregate_steps(metric_rows(spark, d), {"m/mean": "weighted_avg"}), "name", value="value")
SQL["metric_steps"] = f"{ROWS} SELECT name, {r6('''CASE any_value(agg) WHEN 'mean' THEN sum(value * weight) / sum(weight) WHEN 'sum' THEN sum(value) WHEN 'min' THEN min(value) ELSE max(value) END''', 'value')} FROM rows GROUP BY name"


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("seq_id", "uid", "data_source", "score", F.round(F.col("score") / 2, 6).alias("reward"), F.col("n_tokens").alias("response_length"), (F.col("seq_id") % 13 + 1).alias("prompt_length"))


SEQS = f"{VIEWS}, sq AS (SELECT seq_id, uid, data_source, score, round(score / 2, 6) AS reward, n_tokens AS response_length, seq_id % 13 + 1 AS prompt_length FROM sc)"
_STATS = {}
for _n, _c, _on in (("score", "score", "response_length > 0"), ("reward", "reward", "response_length > 0"), ("response_length", "response_length", "true"), ("response_length_non_aborted", "response_length", "response_length > 0"), ("prompt_length", "prompt_length", "true")):
    for _how, _f in (("mean", "avg"), ("max", "max"), ("min", "min")):
        _STATS[f"{_n}_{_how}"] = f"{_f}(CAST({_c} AS DOUBLE)) FILTER (WHERE {_on})"
_STATS |= {"response_clip_ratio": "avg(CAST(response_length >= 7 AS INT))", "response_non_aborted_clip_ratio": "avg(CAST(response_length >= 7 AS INT)) FILTER (WHERE response_length > 0)", "aborted_ratio": "avg(CAST(response_length = 0 AS INT))"}
_TOKENS = {f"{c}_{h}": f"{f}({c}) FILTER (WHERE mask <> 0)" for c in ("advantage", "returns", "value") for h, f in (("mean", "avg"), ("max", "max"), ("min", "min"))}
_TOKENS["explained_var"] = "1 - var_samp(returns - value) FILTER (WHERE mask <> 0) / (var_samp(returns) FILTER (WHERE mask <> 0) + CAST(0.00001 AS DOUBLE))"


def metric_data(spark: SparkSession, d: str) -> DataFrame:
    t = A.spread(tokens(spark, d), A.grpo(scored(spark, d))).withColumn("returns", F.col("value") * F.col("reward") + F.col("value"))
    return rounded(M.data_metrics(seqs(spark, d), t, 7), **{k: k for k in (*_STATS, *_TOKENS)})


QUERIES["metric_data"] = metric_data
SQL["metric_data"] = f"""{SEQS}, t AS (SELECT t.mask, t.value, a.adv * t.mask AS advantage, value * reward + value AS returns FROM tok t JOIN (SELECT seq_id, {FORMULAS['grpo']} AS adv FROM sc) a USING (seq_id)),
a AS (SELECT {", ".join(r6(v, k) for k, v in _STATS.items())} FROM sq), b AS (SELECT {", ".join(r6(v, k) for k, v in _TOKENS.items())} FROM t) SELECT * FROM a, b"""


def metric_timing(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "region").select(F.element_at(F.array(*map(F.lit, ("gen", "ref", "adv", "update_actor", "save"))), (F.col("r_regionkey") + 1)).alias("name"), (F.col("r_regionkey") * 1.5 + 1).alias("seconds"))
    return rounded(M.timing_metrics(t, seqs(spark, d)), "name", seconds="seconds", per_token_ms="per_token_ms")


QUERIES["metric_timing"] = metric_timing
SQL["metric_timing"] = f"""{SEQS}, k AS (SELECT sum(response_length) AS r, sum(prompt_length + response_length) AS a FROM sq), t AS (SELECT ['gen', 'ref', 'adv', 'update_actor', 'save'][r_regionkey + 1] AS name, r_regionkey * CAST(1.5 AS DOUBLE) + 1 AS seconds FROM region)
SELECT name, {r6('seconds', 'seconds')}, {r6("seconds * 1000 / CASE WHEN name = 'gen' THEN r WHEN name <> 'save' THEN a END", 'per_token_ms')} FROM t, k"""
QUERIES["metric_throughput"] = lambda spark, d: rounded(M.throughput(seqs(spark, d), 2.0, 2), total_tokens="total_tokens", rate="tokens_per_device_second")
SQL["metric_throughput"] = f"{SEQS} SELECT {r6('sum(prompt_length + response_length)', 'total_tokens')}, {r6('sum(prompt_length + response_length) / CAST(4 AS DOUBLE)', 'rate')} FROM sq"


def metric_variance(spark: SparkSession, d: str) -> DataFrame:
    t = A.spread(tokens(spark, d), A.grpo(scored(spark, d))).withColumns({"sum_pi_squared": F.exp(2 * F.col("old_lp")) + 0.01, "rho": F.exp(F.col("old_lp") - F.col("rollout_lp"))})
    return rounded(M.variance_proxies(t, 0.05, "rho"), **{k: k for k in ("signal_strength", "total_power", "pure_noise", "expected_a_squared", "expected_w")})


QUERIES["metric_variance"] = metric_variance
_W = "(1 - 2 * exp(old_lp) + exp(2 * old_lp) + CAST(0.01 AS DOUBLE))"
SQL["metric_variance"] = f"""{VIEWS}, q AS (SELECT t.seq_id, sum(a.adv * t.mask) / (sum(mask) + {E8}) AS a, sum(exp(old_lp - rollout_lp) * mask) / (sum(mask) + {E8}) AS rho, sum({_W} * mask) AS w0, sum({_W} * exp(2 * (old_lp - rollout_lp)) * mask) AS w1 FROM tok t JOIN (SELECT seq_id, {FORMULAS['grpo']} AS adv FROM sc) a USING (seq_id) GROUP BY t.seq_id),
p AS (SELECT avg(rho * rho * a * a * greatest(w0, 0)) AS power, avg(a * a) AS a2, avg(w1) AS w, count(*) AS n FROM q)
SELECT {r6('0.0025', 'signal_strength')}, {r6('power', 'total_power')}, {r6('greatest(0, (power - CAST(0.0025 AS DOUBLE)) / (n - 1))', 'pure_noise')}, {r6('a2', 'expected_a_squared')}, {r6('w', 'expected_w')} FROM p"""


def eval_validation(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).select("data_source", "uid", F.col("seq_id").alias("order"), F.col("score").alias("reward"), (F.col("length") >= 3).cast("double").alias("acc"), F.col("length").alias("pred"))
    return rounded(M.validation_names(M.validation_metrics(s, ["reward", "acc"], "pred", times=200)), "data_source", "variable", "metric", "name", value="value")


QUERIES["eval_validation"] = eval_validation

# resampled metrics: a prompt's values xs in ascending order, os and vs (values and votes) in order of its samples
_PROMPTS = f"""{VIEWS}, s AS (SELECT data_source, uid, seq_id, length AS pred, unnest(['reward', 'acc']) AS variable, unnest([score, CASE WHEN length >= 3 THEN 1.0 ELSE 0.0 END]::DOUBLE[]) AS v FROM sc),
g AS MATERIALIZED (SELECT data_source, uid, variable, count(*) AS n, list(v ORDER BY v) AS xs, list(v ORDER BY seq_id) AS os, list(pred ORDER BY seq_id) AS vs, avg(v) AS m, stddev_pop(v) AS sd FROM s GROUP BY data_source, uid, variable),
k AS (SELECT n, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], lambda p: p < n), n)) AS k FROM (SELECT DISTINCT n FROM g WHERE n > 1)),
plain AS (SELECT data_source, uid, variable, 'mean@' || n AS metric, m AS v FROM g UNION ALL SELECT data_source, uid, variable, 'std@' || n, sd FROM g WHERE n > 1)"""
_NAMED = f"""a AS (SELECT data_source, variable, metric, avg(v) AS v FROM l GROUP BY ALL),
x AS (SELECT *, CAST(regexp_extract(metric, '@([0-9]+)', 1) AS INTEGER) AS n, max(CAST(regexp_extract(metric, '@([0-9]+)', 1) AS INTEGER)) OVER (PARTITION BY data_source) AS top FROM a)
SELECT data_source, variable, metric, CASE WHEN variable = 'acc' AND regexp_matches(metric, '^(mean|maj|best)') AND n = top AND NOT metric LIKE '%/std' THEN 'val-core' ELSE 'val-aux' END || '/' || data_source || '/' || variable || '/' || metric AS name, {r6('v', 'value')} FROM x"""
SQL["eval_validation"] = f"""{_PROMPTS},
u AS (SELECT b, j, CAST('0x' || substr(md5('42:' || b || ':' || j), 1, 8) AS BIGINT) AS u FROM range(200) t(b), range(1024) r(j) WHERE j < (SELECT max(n) FROM g)),
d AS MATERIALIZED (SELECT n, k, b, j, (u * n) >> 32 AS i FROM k JOIN u ON j < k),
e AS MATERIALIZED (SELECT n, k, b, max(i) AS hi, min(i) AS lo FROM d GROUP BY n, k, b),
ex AS (SELECT data_source, uid, variable, k, avg(xs[hi + 1]) AS bm, stddev_pop(xs[hi + 1]) AS bs, avg(xs[lo + 1]) AS wm, stddev_pop(xs[lo + 1]) AS ws FROM g JOIN e USING (n) GROUP BY ALL),
c AS (SELECT data_source, uid, variable, k, b, vs[i + 1] AS vote, count(*) AS c, min(j) AS first, arg_min(os[i + 1], j) AS v FROM g JOIN d USING (n) GROUP BY ALL),
mj AS (SELECT data_source, uid, variable, k, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY data_source, uid, variable, k, b ORDER BY c DESC, first) = 1) GROUP BY ALL),
l AS (FROM plain UNION ALL SELECT data_source, uid, variable, 'best@' || k || '/mean', bm FROM ex UNION ALL SELECT data_source, uid, variable, 'best@' || k || '/std', bs FROM ex UNION ALL SELECT data_source, uid, variable, 'worst@' || k || '/mean', wm FROM ex UNION ALL SELECT data_source, uid, variable, 'worst@' || k || '/std', ws FROM ex UNION ALL SELECT data_source, uid, variable, 'maj@' || k || '/mean', m FROM mj UNION ALL SELECT data_source, uid, variable, 'maj@' || k || '/std', s FROM mj),
{_NAMED}"""


def eval_validation_exact(spark: SparkSession, d: str) -> DataFrame:
    """Best and worst as their expectations over all draws, by order statistics."""
    s = scored(spark, d).select("data_source", "uid", F.col("seq_id").alias("order"), F.col("score").alias("reward"), (F.col("length") >= 3).cast("double").alias("acc"))
    return rounded(M.validation_names(M.validation_metrics(s, ["reward", "acc"], draws="exact")), "data_source", "variable", "metric", "name", value="value")


QUERIES["eval_validation_exact"] = eval_validation_exact
SQL["eval_validation_exact"] = f"""{_PROMPTS},
o AS (SELECT data_source, uid, variable, k, unnest(xs) AS x, unnest(range(1, n + 1)) AS i, n FROM g JOIN k USING (n)),
w AS (SELECT *, pow(i / n, k) - pow((i - 1) / n, k) AS b, pow((n - i + 1) / n, k) - pow((n - i) / n, k) AS w FROM o),
f AS (SELECT data_source, uid, variable, k, sum(x * b) AS bm, sum(x * w) AS wm FROM w GROUP BY ALL),
h AS (SELECT data_source, uid, variable, k, any_value(bm) AS bm, any_value(wm) AS wm, sqrt(greatest(0, sum(b * (x - bm) * (x - bm)))) AS bs, sqrt(greatest(0, sum(w * (x - wm) * (x - wm)))) AS ws FROM w JOIN f USING (data_source, uid, variable, k) GROUP BY ALL),
l AS (FROM plain UNION ALL SELECT data_source, uid, variable, 'best@' || k || '/mean', bm FROM h UNION ALL SELECT data_source, uid, variable, 'best@' || k || '/std', bs FROM h UNION ALL SELECT data_source, uid, variable, 'worst@' || k || '/mean', wm FROM h UNION ALL SELECT data_source, uid, variable, 'worst@' || k || '/std', ws FROM h),
{_NAMED}"""


def eval_validation_mean(spark: SparkSession, d: str) -> DataFrame:
    """The part of the validation metrics that draws nothing: means and deviations."""
    s = scored(spark, d).select("data_source", "uid", F.col("seq_id").alias("order"), F.col("score").alias("reward"))
    return rounded(M.validation_metrics(s, ["reward"], times=0), "data_source", "variable", "metric", value="value")


QUERIES["eval_validation_mean"] = eval_validation_mean
SQL["eval_validation_mean"] = f"""{VIEWS}, g AS (SELECT data_source, uid, count(*) AS n, avg(score) AS m, stddev_pop(score) AS s FROM sc GROUP BY data_source, uid),
l AS (SELECT data_source, 'mean@' || n AS metric, m AS v FROM g UNION ALL SELECT data_source, 'std@' || n AS metric, s AS v FROM g WHERE n > 1)
SELECT data_source, 'reward' AS variable, metric, {r6('avg(v)', 'value')} FROM l GROUP BY data_source, metric"""


def eval_majority(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent length of each prompt's sequences (of equally frequent ones, the first met), and the first score with it."""
    from pyspark.sql import Window

    s = scored(spark, d)
    w = Window.partitionBy("uid", "length")
    c = s.select("uid", "seq_id", "length", "score", F.count("*").over(w).alias("n"), F.min("seq_id").over(w).alias("first"))
    best = F.row_number().over(Window.partitionBy("uid").orderBy(F.col("n").desc(), "first", "seq_id"))
    return rounded(c.withColumn("rk", best).where("rk = 1"), "uid", "length", score="score")


QUERIES["eval_majority"] = eval_majority
SQL["eval_majority"] = f"""{VIEWS}, c AS (SELECT *, count(*) OVER (PARTITION BY uid, length) AS n, min(seq_id) OVER (PARTITION BY uid, length) AS f FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, f, seq_id) AS rk FROM c) SELECT uid, length, {r6('score', 'score')} FROM r WHERE rk = 1"""


def metric_speculative(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("drafted"), F.sum(F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), 1).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)).alias("verified"))
    return rounded(M.speculative(li), acceptance_rate="acceptance_rate", acceptance_length="acceptance_length")


QUERIES["metric_speculative"] = metric_speculative
SQL["metric_speculative"] = f"""WITH q AS (SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'O') AS dr, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') AS ac, count(*) FILTER (WHERE l_returnflag = 'N') AS ve FROM lineitem GROUP BY 1)
SELECT {r6('avg(CASE WHEN dr > 0 THEN ac / CAST(dr AS DOUBLE) ELSE 0 END)', 'acceptance_rate')}, {r6('avg(CASE WHEN ve > 0 THEN 1 + ac / CAST(ve AS DOUBLE) ELSE 0 END)', 'acceptance_length')} FROM q"""
QUERIES["metric_spread"] = lambda spark, d: rounded(M.spread_stats(seqs(spark, d), "response_length", ["data_source"]), "data_source", **{k: k for k in ("mean", "max", "min", "p50", "p95", "p99")})
SQL["metric_spread"] = f"{SEQS} SELECT data_source, {r6('avg(response_length)', 'mean')}, {r6('max(response_length)', 'max')}, {r6('min(response_length)', 'min')}, {r6('quantile_cont(response_length, 0.5)', 'p50')}, {r6('quantile_cont(response_length, 0.95)', 'p95')}, {r6('quantile_cont(response_length, 0.99)', 'p99')} FROM sq GROUP BY data_source"


def metric_staleness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_id") % 5).alias("min_version"), (F.col("event_id") % 5 + F.col("user_id") % 3).alias("max_version"))
    return rounded(M.staleness_stats(e), F.col("partial").cast("long").alias("partial"), F.col("max_span").cast("long").alias("max_span"), F.col("versions").cast("long").alias("versions"), partial_ratio="partial_ratio")


QUERIES["metric_staleness"] = metric_staleness
SQL["metric_staleness"] = f"SELECT CAST(count(*) FILTER (WHERE user_id % 3 > 0) AS BIGINT) AS partial, CAST(max(user_id % 3) AS BIGINT) AS max_span, count(DISTINCT event_id % 5 + user_id % 3) AS versions, {r6('avg(CAST(user_id % 3 > 0 AS INT))', 'partial_ratio')} FROM events"
QUERIES["metric_flops"] = lambda spark, d: rounded(M.flops(seqs(spark, d).withColumn("seqlen", F.col("response_length") + F.col("prompt_length")), 5e8, 64, 14, 24, 3.0), tflops="tflops")
SQL["metric_flops"] = f"{SEQS} SELECT {r6('(CAST(6 * 5e8 AS DOUBLE) * sum(response_length + prompt_length) + CAST(6.0 * 64 * 14 * 24 AS DOUBLE) * sum(pow(response_length + prompt_length, 2))) / 3 / 1e12', 'tflops')} FROM sq"


def eval_offline(spark: SparkSession, d: str) -> DataFrame:
    """Responses of an order: its line items, written as an answer; scored by the strict answer rule."""
    from tidemill.functions.scoring import gsm8k

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("data_source"), F.lit("10").alias("truth"))
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.collect_list(F.concat(F.lit("so it is #### "), F.col("l_quantity").cast("int").cast("string"))).alias("responses"))
    return rounded(M.offline_eval(o.join(r, "row_id"), gsm8k(F.col("response"), F.col("truth"))), "data_source", score="score")


QUERIES["eval_offline"] = eval_offline
SQL["eval_offline"] = f"""WITH q AS (SELECT o_orderpriority AS data_source, o_orderkey, avg(CASE WHEN CAST(l_quantity AS INT) = 10 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT data_source, {r6('avg(s)', 'score')} FROM q GROUP BY data_source"""
