"""Queries of the advantage estimators over the derived rollout tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.draws import word_sql
from tidemill.functions.masked import group_mean_std, masked_mean, masked_moments, masked_sum, whiten
from tidemill.operators import advantage as A
from tidemill.plans.views import VIEWS, grouped_tokens, scored, tokens

QUERIES, SQL = {}, {}


def rounded(df: DataFrame, *keys: str, **values) -> DataFrame:
    """Keys, and doubles to 6 places, -0 as 0. A trifle is added first: figures of two decimals make exact ties, which would round by the noise of a sum's order."""
    return df.select(*keys, *((F.round((F.col(c) if isinstance(c, str) else c) + 1.3e-9, 6) + 0.0).alias(k) for k, c in values.items()))


def r6(sql: str, name: str) -> str:
    return f"round(CAST({sql} AS DOUBLE) + CAST(1.3e-9 AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {name}"


GROUP = "OVER (PARTITION BY uid)"
MEAN = f"(CASE WHEN count(*) {GROUP} = 1 THEN 0 ELSE avg(score) {GROUP} END)"
STD = f"(CASE WHEN count(*) {GROUP} = 1 THEN 1 ELSE stddev_samp(score) {GROUP} END)"
FORMULAS = {
    "grpo": f"(score - {MEAN}) / ({STD} + CAST(0.000001 AS DOUBLE))",
    "grpo_vectorized": f"(score - {MEAN}) / ({STD} + CAST(0.000001 AS DOUBLE))",
    "reinforce_plus_plus_baseline": f"score - {MEAN}",
    "rloo": f"CASE WHEN count(*) {GROUP} > 1 THEN (score - {MEAN}) * count(*) {GROUP} / (count(*) {GROUP} - 1) ELSE score END",
    "rloo_vectorized": f"CASE WHEN count(*) {GROUP} > 1 THEN (count(*) {GROUP} * score - sum(score) {GROUP}) / (count(*) {GROUP} - 1) ELSE 0 END",
    "opo": f"score - CASE WHEN count(*) {GROUP} = 1 THEN 0 ELSE sum(length * score) {GROUP} / nullif(CAST(sum(length) {GROUP} AS DOUBLE), 0) END",
    "gpg": f"(SELECT count(*) / greatest(CAST(count(*) FILTER (WHERE score <> 0) AS DOUBLE), 1) FROM sc) * (score - {MEAN})",
}
for _name, _sql in FORMULAS.items():
    QUERIES[f"adv_{_name}"] = lambda spark, d, n=_name: rounded(A.SEQUENCE[n](scored(spark, d)), "seq_id", "uid", advantage="advantage")
    SQL[f"adv_{_name}"] = f"{VIEWS} SELECT seq_id, uid, {r6(_sql, 'advantage')} FROM sc"


def adv_grpo_no_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.grpo(scored(spark, d), norm_by_std=False), "seq_id", "uid", advantage="advantage")


QUERIES["adv_grpo_no_std"] = adv_grpo_no_std
SQL["adv_grpo_no_std"] = f"{VIEWS} SELECT seq_id, uid, {r6(f'score - {MEAN}', 'advantage')} FROM sc"


def adv_grpo_tokens(spark: SparkSession, d: str) -> DataFrame:
    out = A.spread(tokens(spark, d), A.grpo(scored(spark, d)))
    return rounded(out, "seq_id", "pos", advantage="advantage")


QUERIES["adv_grpo_tokens"] = adv_grpo_tokens
SQL["adv_grpo_tokens"] = f"{VIEWS} SELECT t.seq_id, t.pos, {r6('a.advantage * t.mask', 'advantage')} FROM tok t JOIN (SELECT seq_id, {FORMULAS['grpo']} AS advantage FROM sc) a USING (seq_id)"


def adv_grpo_passk(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    several = s.groupBy("uid").count().where("count > 1").select("uid")
    return rounded(A.grpo_passk(s.join(several, "uid", "left_semi")), "seq_id", "uid", advantage="advantage")


QUERIES["adv_grpo_passk"] = adv_grpo_passk
SQL["adv_grpo_passk"] = f"""{VIEWS}, g AS (SELECT *, count(*) {GROUP} AS n, stddev_samp(score) {GROUP} AS sd, row_number() OVER (PARTITION BY uid ORDER BY score DESC, seq_id) AS rk,
  nth_value(score, 2) OVER (PARTITION BY uid ORDER BY score DESC, seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM sc)
SELECT seq_id, uid, {r6("CASE WHEN rk = 1 THEN score - second ELSE 0 END / (sd + CAST(0.000001 AS DOUBLE))", "advantage")} FROM g WHERE n > 1"""


def adv_gdpo(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).withColumn("size_score", F.col("length") / 10)
    return rounded(A.gdpo(s, ["score", "size_score"], {"size_score": 0.5}), "seq_id", "uid", advantage="advantage")


QUERIES["adv_gdpo"] = adv_gdpo
_SIZE = f"(length / CAST(10 AS DOUBLE) - CASE WHEN count(*) {GROUP} = 1 THEN 0 ELSE avg(length / CAST(10 AS DOUBLE)) {GROUP} END) / (CASE WHEN count(*) {GROUP} = 1 THEN 1 ELSE stddev_samp(length / CAST(10 AS DOUBLE)) {GROUP} END + CAST(0.000001 AS DOUBLE))"
SQL["adv_gdpo"] = f"{VIEWS} SELECT seq_id, uid, {r6(f'{FORMULAS["grpo"]} + CAST(0.5 AS DOUBLE) * {_SIZE}', 'advantage')} FROM sc"


def adv_gae(spark: SparkSession, d: str) -> DataFrame:
    out = A.gae(tokens(spark, d), gamma=0.9, lam=0.8).where("mask = 1")
    return rounded(out, "seq_id", "pos", advantage="advantage", returns="returns")


QUERIES["adv_gae"] = adv_gae
SQL["adv_gae"] = f"""{VIEWS}, v AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS k, coalesce(lead(value) OVER (PARTITION BY seq_id ORDER BY pos), 0) AS nv FROM tok WHERE mask = 1),
dl AS (SELECT *, reward + CAST(0.9 AS DOUBLE) * nv - value AS delta FROM v),
a AS (SELECT x.seq_id, x.pos, any_value(x.value) AS value, sum(pow(CAST(0.72 AS DOUBLE), y.k - x.k) * y.delta) AS adv FROM dl x JOIN dl y ON x.seq_id = y.seq_id AND y.k >= x.k GROUP BY x.seq_id, x.pos),
st AS (SELECT count(*) AS n, sum(adv) / (count(*) + CAST(1e-8 AS DOUBLE)) AS mu FROM a),
vr AS (SELECT sum((adv - mu) * (adv - mu)) / (max(n) + CAST(1e-8 AS DOUBLE)) * max(n) / (max(n) - 1) AS va, max(mu) AS mu FROM a, st)
SELECT seq_id, pos, {r6('(adv - mu) / sqrt(va + CAST(1e-8 AS DOUBLE))', 'advantage')}, {r6('adv + value', 'returns')} FROM a, vr"""


def adv_reinforce_plus_plus(spark: SparkSession, d: str) -> DataFrame:
    out = A.reinforce_plus_plus(tokens(spark, d), gamma=0.95)
    return rounded(out, "seq_id", "pos", advantage="advantage", returns="returns")


QUERIES["adv_reinforce_plus_plus"] = adv_reinforce_plus_plus
_WHITE = """st AS (SELECT sum(mask) AS n, sum(g * mask) / (sum(mask) + CAST(1e-8 AS DOUBLE)) AS mu FROM a),
vr AS (SELECT sum((g - mu) * (g - mu) * mask) / (max(n) + CAST(1e-8 AS DOUBLE)) * max(n) / (max(n) - 1) AS va, max(mu) AS mu FROM a, st)"""
SQL["adv_reinforce_plus_plus"] = f"""{VIEWS}, z AS (SELECT *, sum(1 - mask) OVER (PARTITION BY seq_id ORDER BY pos) AS zc FROM tok),
a AS (SELECT x.seq_id, x.pos, any_value(x.mask) AS mask, sum(pow(CAST(0.95 AS DOUBLE), y.pos - x.pos) * y.reward) AS g FROM z x JOIN z y ON x.seq_id = y.seq_id AND y.pos >= x.pos AND y.zc = x.zc GROUP BY x.seq_id, x.pos), {_WHITE}
SELECT seq_id, pos, {r6('(g - mu) / sqrt(va + CAST(1e-8 AS DOUBLE)) * mask', 'advantage')}, {r6('g', 'returns')} FROM a, vr"""


def adv_remax(spark: SparkSession, d: str) -> DataFrame:
    base = scored(spark, d).select("seq_id", (F.col("score") / 2).alias("baseline"))
    return rounded(A.remax(tokens(spark, d), base), "seq_id", "pos", advantage="advantage", returns="returns")


QUERIES["adv_remax"] = adv_remax
_TOGO = "sum(reward * mask) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
SQL["adv_remax"] = f"""{VIEWS}, a AS (SELECT *, {_TOGO} AS g FROM tok)
SELECT a.seq_id, a.pos, {r6('g - sc.score / 2 * mask', 'advantage')}, {r6('g', 'returns')} FROM a JOIN sc USING (seq_id)"""


def _otb(spark: SparkSession, d: str, compact: bool) -> DataFrame:
    t = grouped_tokens(spark, d).withColumn("sum_pi_squared", F.exp(2 * F.col("old_lp")) + 0.01)
    return rounded(A.optimal_token_baseline(t, compact=compact), "seq_id", "pos", advantage="advantage", returns="returns")


def _otb_sql(compact: bool) -> str:
    place = "sum(mask) OVER (PARTITION BY seq_id ORDER BY pos) - 1" if compact else "pos"
    return f"""{VIEWS}, a AS (SELECT *, {_TOGO} AS g, sum((1 - 2 * exp(old_lp) + exp(2 * old_lp) + CAST(0.01 AS DOUBLE)) * mask) OVER (PARTITION BY seq_id ORDER BY pos) AS w, {place} AS place FROM tok),
ln AS (SELECT uid, seq_id, sum(mask) AS len FROM tok GROUP BY uid, seq_id {"HAVING sum(mask) > 0" if compact else ""}),
lr AS (SELECT *, max(len) {GROUP} AS longest, count(*) {GROUP} AS n, nth_value(len, 2) OVER (PARTITION BY uid ORDER BY len DESC, seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM ln),
b AS (SELECT uid, place, sum(g * w * mask) / (sum(w * mask) + CAST(1e-8 AS DOUBLE)) AS base FROM a GROUP BY uid, place)
SELECT a.seq_id, a.pos, {r6("CASE WHEN mask = 0 THEN 0 WHEN lr.n < 2 OR (lr.len = lr.longest AND lr.second < lr.longest AND a.place >= lr.second) THEN g ELSE g - coalesce(base, 0) END", "advantage")}, {r6('g', 'returns')}
FROM a LEFT JOIN lr ON a.seq_id = lr.seq_id LEFT JOIN b ON a.uid = b.uid AND a.place = b.place"""


QUERIES["adv_optimal_token_baseline"] = lambda spark, d: _otb(spark, d, False)
QUERIES["adv_tir_optimal_token_baseline"] = lambda spark, d: _otb(spark, d, True)
SQL["adv_optimal_token_baseline"], SQL["adv_tir_optimal_token_baseline"] = _otb_sql(False), _otb_sql(True)


def adv_multi_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Sessions: orders of a customer with equal last digit; index: the order's number."""
    s = scored(spark, d).withColumn("batch_key", F.concat_ws("_", "uid", F.col("seq_id") % 10, "seq_id"))
    return rounded(A.multi_trajectory(s), "seq_id", "uid", advantage="advantage")


QUERIES["adv_multi_trajectory"] = adv_multi_trajectory
SQL["adv_multi_trajectory"] = f"""{VIEWS}, k AS (SELECT *, seq_id % 10 AS session FROM sc),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, session ORDER BY seq_id DESC) AS rk FROM k) WHERE rk = 1),
a AS (SELECT uid, session, CASE WHEN length > 0 THEN {FORMULAS['grpo']} ELSE 0 END AS adv FROM f)
SELECT k.seq_id, k.uid, {r6('a.adv', 'advantage')} FROM k JOIN a ON k.uid = a.uid AND k.session = a.session"""


def adv_kl_reward(spark: SparkSession, d: str) -> DataFrame:
    """Per sequence: rewards less the KL penalty, and its masked mean."""
    out = A.kl_rewards(tokens(spark, d), F.col("old_lp") - F.col("ref_lp"), 0.1)
    return rounded(out.groupBy("seq_id").agg(F.sum("token_reward").alias("r"), masked_mean("kl", "mask").alias("k")), "seq_id", reward="r", kl="k")


QUERIES["adv_kl_reward"] = adv_kl_reward
SQL["adv_kl_reward"] = f"{VIEWS} SELECT seq_id, {r6('sum(reward - CAST(0.1 AS DOUBLE) * (old_lp - ref_lp) * mask)', 'reward')}, {r6('sum((old_lp - ref_lp) * mask) / (sum(mask) + CAST(1e-8 AS DOUBLE))', 'kl')} FROM tok GROUP BY seq_id"


def adv_baseline_join(spark: SparkSession, d: str) -> DataFrame:
    """Each prompt's last order gives the baseline of all its orders."""
    s = scored(spark, d)
    return rounded(A.last_of_session_baseline(s, s.select("uid", F.col("seq_id").alias("index"), "score")), "seq_id", "uid", baseline="baseline")


QUERIES["adv_baseline_join"] = adv_baseline_join
SQL["adv_baseline_join"] = f"{VIEWS} SELECT seq_id, uid, {r6('first_value(score) OVER (PARTITION BY uid ORDER BY seq_id DESC)', 'baseline')} FROM sc"

# rows are intervals of whole numbers in order of seq_id, draws are places in them
SQL["adv_resample"] = f"""{VIEWS}, w AS (SELECT seq_id, uid, score * score + CAST(1e-8 AS DOUBLE) AS w FROM sc), t AS (SELECT sum(w) AS t FROM w),
i AS (SELECT seq_id, uid, CAST(sum(CAST(ceil(w / t * CAST(17592186044416 AS DOUBLE)) AS BIGINT)) OVER (ORDER BY seq_id) AS BIGINT) AS e, CAST(ceil(w / t * CAST(17592186044416 AS DOUBLE)) AS BIGINT) AS n FROM w, t),
s AS (SELECT seq_id, uid, e - n AS b FROM i), z AS (SELECT max(e) AS size, count(*) AS n FROM i),
d AS (SELECT draw, {word_sql('draw', 0)} % size AS p FROM z, (SELECT seq_id - 1 AS draw FROM (SELECT row_number() OVER () AS seq_id FROM sc)) r)
SELECT seq_id, uid, CAST(draw AS BIGINT) AS draw FROM d ASOF JOIN s ON d.p >= s.b"""
QUERIES["adv_resample"] = lambda spark, d: A.resample(scored(spark, d)).select("seq_id", "uid", F.col("draw").cast("long").alias("draw"))


# masked statistics
def stat_masked(spark: SparkSession, d: str) -> DataFrame:
    t = grouped_tokens(spark, d)
    return rounded(t.groupBy("uid").agg(masked_sum("reward", "mask").alias("s"), masked_mean("reward", "mask").alias("m")), "uid", masked_sum="s", masked_mean="m")


def stat_masked_var(spark: SparkSession, d: str) -> DataFrame:
    return rounded(masked_moments(tokens(spark, d), "value", "mask"), F.col("n").cast("long").alias("n"), mean="mean", var="var")


def stat_whiten(spark: SparkSession, d: str) -> DataFrame:
    out = whiten(whiten(tokens(spark, d), "value", "mask", "w"), "value", "mask", "kept", shift_mean=False)
    return rounded(out, "seq_id", "pos", whitened="w", scaled="kept")


def stat_group_mean_std(spark: SparkSession, d: str) -> DataFrame:
    return rounded(group_mean_std(scored(spark, d), "score", "uid", 1e-6), "uid", F.col("n").cast("long").alias("n"), mean="mean", std="std")


QUERIES |= {"stat_masked": stat_masked, "stat_masked_var": stat_masked_var, "stat_whiten": stat_whiten, "stat_group_mean_std": stat_group_mean_std}
_A = "a AS (SELECT seq_id, pos, mask, value AS g FROM tok)"
SQL |= {
    "stat_masked": f"{VIEWS} SELECT uid, {r6('sum(reward * mask)', 'masked_sum')}, {r6('sum(reward * mask) / (sum(mask) + CAST(1e-8 AS DOUBLE))', 'masked_mean')} FROM tok GROUP BY uid",
    "stat_masked_var": f"{VIEWS}, {_A}, {_WHITE} SELECT CAST(n AS BIGINT) AS n, {r6('vr.mu', 'mean')}, {r6('va', 'var')} FROM st, vr",
    "stat_whiten": f"{VIEWS}, {_A}, {_WHITE} SELECT seq_id, pos, {r6('(g - mu) / sqrt(va + CAST(1e-8 AS DOUBLE))', 'whitened')}, {r6('(g - mu) / sqrt(va + CAST(1e-8 AS DOUBLE)) + mu', 'scaled')} FROM a, vr",
    "stat_group_mean_std": f"{VIEWS} SELECT uid, count(*) AS n, {r6('CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END', 'mean')}, {r6('CASE WHEN count(*) = 1 THEN 1 ELSE sqrt(greatest(var_samp(score), CAST(0.000001 AS DOUBLE))) END', 'std')} FROM sc GROUP BY uid",
}
