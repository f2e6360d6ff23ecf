"""Queries of off-policy correction, and their SQL."""

from __future__ import annotations

from tidemill.operators import offpolicy as O
from tidemill.plans.advantages import r6, rounded
from tidemill.plans.views import VIEWS, tokens

QUERIES, SQL = {}, {}
E8 = "CAST(1e-8 AS DOUBLE)"
X = f"{VIEWS}, x AS (SELECT *, old_lp - rollout_lp AS d FROM tok)"


def n(v: float) -> str:
    return f"CAST({v} AS DOUBLE)"


def mean(c: str) -> str:
    return f"sum({c} * mask) / (sum(mask) + {E8})"


def frac(c: str) -> str:
    return mean(f"(CASE WHEN {c} THEN {n(1)} ELSE 0 END)")


RAW = {"token": "exp(d) * mask", "sequence": "exp(least(greatest(sum(d * mask) OVER (PARTITION BY seq_id), -20), 20)) * mask"}
for _level, _raw in RAW.items():
    for _name, _spec, _weight in (("", 1.2, f"least(rw, {n(1.2)})"), ("_two_sided", "0.8_1.25", f"CASE WHEN rw >= {n(0.8)} AND rw <= {n(1.25)} THEN rw ELSE 0 END")):
        QUERIES[f"is_weights_{_level}{_name}"] = lambda spark, d, level=_level, spec=_spec: rounded(O.importance_weights(tokens(spark, d), level, spec), "seq_id", "pos", weight="weight")
        SQL[f"is_weights_{_level}{_name}"] = f"{X}, w AS (SELECT *, {_raw} AS rw FROM x) SELECT seq_id, pos, {r6(_weight, 'weight')} FROM w"
QUERIES["is_weights_normalised"] = lambda spark, d: rounded(O.importance_weights(tokens(spark, d), "token", 1.2, normalise=True), "seq_id", "pos", weight="weight")
SQL["is_weights_normalised"] = f"{X}, w AS (SELECT *, least(exp(d) * mask, {n(1.2)}) AS w FROM x), m AS (SELECT {mean('w')} AS m FROM w) SELECT seq_id, pos, {r6('w / m', 'weight')} FROM w, m"

_SEQ_METRICS = {"seq_mean": "avg(w)", "seq_std": "stddev_samp(w)", "seq_max": "max(w)", "seq_min": "min(w)", "seq_max_deviation": "max(abs(w - 1))", "seq_fraction_high": f"avg(CASE WHEN w > {n(1.2)} THEN {n(1)} ELSE 0 END)", "seq_fraction_low": f"avg(CASE WHEN w < 1 / {n(1.2)} THEN {n(1)} ELSE 0 END)"}
_TOKEN_METRICS = {"mean": mean("w"), "max": "max(w) FILTER (WHERE mask <> 0)", "min": "min(w) FILTER (WHERE mask <> 0)", "fraction_high": frac(f"rw > {n(1.2)}"), "fraction_low": frac(f"rw < 1 / {n(1.2)}"), "std": f"sqrt(greatest({mean('w * w')} - pow({mean('w')}, 2), 0))", "eff_sample_size": f"pow({mean('w')} + {E8}, 2) / ({mean('w * w')})"}
_NAMES = [*_TOKEN_METRICS, *_SEQ_METRICS]
QUERIES["is_metrics_token"] = lambda spark, d: rounded(O.weight_metrics(O.importance_weights(tokens(spark, d), "token", 1.2), "token", 1.2), **{k: k for k in _NAMES})
SQL["is_metrics_token"] = f"""{X}, w AS (SELECT *, exp(d) * mask AS rw, least(exp(d) * mask, {n(1.2)}) AS w FROM x), q AS (SELECT seq_id, {mean('w')} AS w FROM w GROUP BY seq_id),
a AS (SELECT {", ".join(r6(v, k) for k, v in _TOKEN_METRICS.items())} FROM w), b AS (SELECT {", ".join(r6(v, k) for k, v in _SEQ_METRICS.items())} FROM q) SELECT * FROM a, b"""
_OF_SEQ = {k: v for k, v in _TOKEN_METRICS.items() if k in ("mean", "std", "eff_sample_size")}
_ALSO = {"max": "exp(least(max(s), 20))", "min": "exp(min(s))", "fraction_high": f"avg(CASE WHEN s > ln({n(1.2)}) THEN {n(1)} ELSE 0 END)", "fraction_low": f"avg(CASE WHEN s < ln(1 / {n(1.2)}) THEN {n(1)} ELSE 0 END)"}
QUERIES["is_metrics_sequence"] = lambda spark, d: rounded(O.weight_metrics(O.importance_weights(tokens(spark, d), "sequence", 1.2), "sequence", 1.2), **{k: k for k in _NAMES})
SQL["is_metrics_sequence"] = f"""{X}, w AS (SELECT *, least({RAW['sequence']}, {n(1.2)}) AS w FROM x), q AS (SELECT seq_id, {mean('w')} AS w, sum(d * mask) AS s FROM w GROUP BY seq_id),
a AS (SELECT {", ".join(r6(v, k) for k, v in _OF_SEQ.items())} FROM w), b AS (SELECT {", ".join(r6(v, k) for k, v in (_SEQ_METRICS | _ALSO).items())} FROM q) SELECT * FROM a, b"""

K = {"1": "-d", "2": "d * d / 2", "3": "exp(d) - 1 - d"}
THRESHOLDS = {"1": "0.8_1.25", "2": "0.02", "3": "0.02"}


def statistic(option: str) -> str:
    k = K[option[-1]]
    if option.startswith("token"):
        return k
    w = "OVER (PARTITION BY seq_id)"
    if "max" in option:
        return f"coalesce(max(CASE WHEN mask <> 0 THEN {k} END) {w}, 0)"
    return f"sum(({k}) * mask) {w}" + (f" / (sum(mask) {w} + {E8})" if "mean" in option else "")


def kept(option: str, x: str) -> str:
    return f"({x} >= ln({n(0.8)}) AND {x} <= ln({n(1.25)}))" if option.endswith("1") else f"{x} <= {n(0.02)}"


for _o in O.OPTIONS:
    QUERIES[f"reject_{_o}"] = lambda spark, d, o=_o: O.reject(tokens(spark, d), o, THRESHOLDS[o[-1]]).selectExpr("seq_id", "pos", "cast(kept_mask as bigint) AS kept")
    SQL[f"reject_{_o}"] = f"{X}, y AS (SELECT *, {statistic(_o)} AS s FROM x) SELECT seq_id, pos, CAST(CASE WHEN {kept(_o, 's')} THEN mask ELSE 0 END AS BIGINT) AS kept FROM y"
_BOTH = "token_k1,seq_mean_k3"
QUERIES["reject_metrics"] = lambda spark, d: rounded(O.rejection_metrics(tokens(spark, d), _BOTH, "0.8_1.25,0.02"), "option", masked_fraction="masked_fraction", seq_masked_fraction="seq_masked_fraction", mean="mean", max="max", min="min")
_CASES = {"token_k1": ("s1", kept("token_k1", "s1")), "seq_mean_k3": ("s3", kept("seq_mean_k3", "s3")), "all": ("CAST(NULL AS DOUBLE)", f"{kept('token_k1', 's1')} AND {kept('seq_mean_k3', 's3')}")}
SQL["reject_metrics"] = f"""{X}, y AS (SELECT *, {statistic('token_k1')} AS s1, {statistic('seq_mean_k3')} AS s3 FROM x),
z AS ({" UNION ALL ".join(f"SELECT '{o}' AS option, seq_id, {s} AS s, CASE WHEN {k} THEN 0 ELSE 1 END AS gone FROM y WHERE mask <> 0" for o, (s, k) in _CASES.items())}),
q AS (SELECT option, seq_id, max(gone) AS hit FROM z GROUP BY option, seq_id), f AS (SELECT option, avg(CAST(hit AS DOUBLE)) AS f FROM q GROUP BY option)
SELECT z.option, {r6(f'sum(gone) / (count(*) + {E8})', 'masked_fraction')}, {r6('any_value(f.f)', 'seq_masked_fraction')}, {r6(f'sum(s) / (count(*) + {E8})', 'mean')}, {r6('max(s)', 'max')}, {r6('min(s)', 'min')} FROM z JOIN f USING (option) GROUP BY z.option"""

_T, _G = "t", "(r - t)"
_METRICS = {
    "training_ppl": "avg(exp(-t))", "training_log_ppl": "avg(-t)", "kl": f"sum(kl) / (sum(k) + {E8})", "k3_kl": f"sum(k3) / (sum(k) + {E8})", "rollout_ppl": "avg(exp(-r))", "rollout_log_ppl": "avg(-r)",
    "log_ppl_diff": f"avg({_G})", "log_ppl_abs_diff": f"avg(abs({_G}))", "log_ppl_diff_max": f"max({_G})", "log_ppl_diff_min": f"min({_G})", "ppl_ratio": f"avg(exp({_G}))",
    "chi2_token": f"sum(sq) / (sum(k) + {E8}) - 1", "chi2_seq": "avg(exp(2 * least(greatest(s, -20), 20))) - 1"}
QUERIES["offpolicy_metrics"] = lambda spark, d: rounded(O.off_policy_metrics(tokens(spark, d)), **{k: k for k in _METRICS})
SQL["offpolicy_metrics"] = f"""{X}, q AS (SELECT seq_id, sum(mask) AS k, {mean('old_lp')} AS t, {mean('rollout_lp')} AS r, sum(-d * mask) AS kl, sum((exp(d) - d - 1) * mask) AS k3, sum(exp(2 * d) * mask) AS sq, sum(d * mask) AS s FROM x GROUP BY seq_id)
SELECT {", ".join(r6(v, k) for k, v in _METRICS.items())} FROM q"""


def is_driver(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of one correction, by weights of tokens and two rejections."""
    return rounded(O.corrected(tokens(spark, d), "token", 1.2, _BOTH, "0.8_1.25,0.02")[1], "name", value="value")


QUERIES["is_driver"] = is_driver
_TALL = lambda sql, name: f"SELECT {name} AS name, value FROM (UNPIVOT ({sql}) ON COLUMNS(* EXCLUDE (option)) INTO NAME k VALUE value)"
_PRE = "'rollout_corr/' || "
SQL["is_driver"] = " UNION ALL ".join([
    _TALL(f"SELECT *, 0 AS option FROM ({SQL['offpolicy_metrics']})", f"{_PRE}k"),
    _TALL(f"SELECT *, 0 AS option FROM ({SQL['is_metrics_token']})", f"{_PRE}'rollout_is_' || CASE WHEN k LIKE 'fraction%' THEN 'ratio_' ELSE '' END || k"),
    _TALL(SQL["reject_metrics"], f"{_PRE}'rollout_rs_' || CASE WHEN option = 'all' THEN '' ELSE option || '_' END || k"),
])
