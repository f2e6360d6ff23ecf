"""Queries of the losses, over tokens with their grpo advantage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.draws import word_sql
from tidemill.functions import losses as L
from tidemill.functions import masked as M
from tidemill.operators import advantage as A
from tidemill.plans.advantages import FORMULAS, r6, rounded
from tidemill.plans.views import VIEWS, scored, table, tokens

QUERIES, SQL = {}, {}


def rows(spark: SparkSession, d: str) -> DataFrame:
    return A.spread(tokens(spark, d), A.grpo(scored(spark, d)))


ROWS = f"{VIEWS}, x AS (SELECT t.*, a.adv * t.mask AS a, new_lp - old_lp AS d, least(greatest(new_lp - old_lp, -20), 20) AS dc FROM tok t JOIN (SELECT seq_id, {FORMULAS['grpo']} AS adv FROM sc) a USING (seq_id))"
E8 = "CAST(1e-8 AS DOUBLE)"
TOKEN_MEAN = "sum(loss * mask) / sum(mask)"


def n(v: float) -> str:
    return f"CAST({v} AS DOUBLE)"


def mean(c: str) -> str:
    return f"sum({c} * mask) / (sum(mask) + {E8})"


def frac(c: str) -> str:
    return mean(f"(CASE WHEN {c} THEN {n(1)} ELSE 0 END)")


for _mode in L.MODES:

    def _q(spark, d, mode=_mode):
        return rounded(L.agg_loss(rows(spark, d).withColumn("loss", F.col("reward") * 10), mode=mode), loss="loss")

    QUERIES[f"agg_loss_{_mode.replace('-', '_')}"] = _q
_SEQ = f"{ROWS}, q AS (SELECT seq_id, sum(reward * 10 * mask) AS s, sum(reward * 10 * mask) / (sum(mask) + {E8}) AS m, sum(mask) AS k, count(*) AS w FROM x GROUP BY seq_id)"
SQL["agg_loss_token_mean"] = f"{ROWS} SELECT {r6('sum(reward * 10 * mask) / sum(mask)', 'loss')} FROM x"
SQL["agg_loss_seq_mean_token_sum"] = f"{_SEQ} SELECT {r6('avg(s)', 'loss')} FROM q WHERE k > 0"
SQL["agg_loss_seq_mean_token_sum_norm"] = f"{_SEQ} SELECT {r6('avg(s) FILTER (WHERE k > 0) / max(w)', 'loss')} FROM q"
SQL["agg_loss_seq_mean_token_mean"] = f"{_SEQ} SELECT {r6('avg(m)', 'loss')} FROM q WHERE k > 0"

R, CLIPPED = "exp(dc)", f"least(greatest(exp(dc), {n(0.8)}), {n(1.2)})"
UPPER = f"greatest(-a * {R}, -a * {CLIPPED})"
BINARY_KL = f"(exp(old_lp) * (old_lp - new_lp) + (1 - exp(old_lp)) * ln((1 - exp(old_lp) + {E8}) / (1 - exp(new_lp) + {E8})))"
#: Per token: the loss, whether it counts as clipped, and as clipped below.
TOKEN_LOSSES = {
    "vanilla": (f"CASE WHEN a < 0 THEN least(-a * 3, {UPPER}) ELSE {UPPER} END", f"-a * {CLIPPED} > -a * {R}", f"{UPPER} > -a * 3 AND a < 0"),
    "dppo_tv": ("CASE WHEN {v} THEN -a * least(exp(dc), 20) * new_lp ELSE 0 END", "NOT ({v})", "exp(dc) > 20 AND ({v})"),
    "dppo_kl": ("CASE WHEN {v} THEN -a * least(exp(dc), 20) * new_lp ELSE 0 END", "NOT ({v})", "exp(dc) > 20 AND ({v})"),
    "cispo": (f"-{CLIPPED} * a * new_lp", f"{R} < {n(0.8)} OR {R} > {n(1.2)}", "false"),
}
VALID = {
    "dppo_tv": f"CASE WHEN a > 0 THEN exp(new_lp) - exp(old_lp) <= {n(0.2)} ELSE exp(new_lp) - exp(old_lp) >= {n(-0.2)} END",
    "dppo_kl": f"CASE WHEN a > 0 THEN {BINARY_KL} <= {n(0.2)} OR exp(new_lp) <= exp(old_lp) ELSE {BINARY_KL} <= {n(0.2)} OR exp(new_lp) >= exp(old_lp) END",
}


def loss_query(name: str, columns: tuple[str, ...], **options):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return rounded(L.policy_loss(name, rows(spark, d), **options), **{c: c for c in columns})

    return query


ALL = ("loss", "clipfrac", "kl", "clipfrac_lower")
for _name, _parts in TOKEN_LOSSES.items():
    _loss, _clip, _low = (p.replace("{v}", VALID.get(_name, "")) for p in _parts)
    QUERIES[f"loss_{_name}"] = loss_query(_name, ALL)
    SQL[f"loss_{_name}"] = f"{ROWS}, y AS (SELECT *, {_loss} AS loss FROM x) SELECT {r6(TOKEN_MEAN, 'loss')}, {r6(frac(_clip), 'clipfrac')}, {r6(mean('-dc'), 'kl')}, {r6(frac(_low), 'clipfrac_lower')} FROM y"
for _name in ("gspo", "sapo", "geo_mean"):
    QUERIES[f"loss_{_name}"] = loss_query(_name, ALL)
_BY_SEQ = f"q AS (SELECT seq_id, sum(loss * mask) / (sum(mask) + {E8}) AS m FROM y GROUP BY seq_id HAVING sum(mask) > 0)"
SQL["loss_gspo"] = f"""{ROWS}, s AS (SELECT *, exp(least(sum(d * mask) OVER (PARTITION BY seq_id) / greatest(sum(mask) OVER (PARTITION BY seq_id), 1), 10)) AS r FROM x),
y AS (SELECT *, greatest(-a * r, -a * least(greatest(r, {n(0.8)}), {n(1.2)})) AS loss FROM s), {_BY_SEQ}
SELECT (SELECT {r6('avg(m)', 'loss').rsplit(' AS ', 1)[0]} FROM q) AS loss, {r6(frac(f'-a * least(greatest(r, {n(0.8)}), {n(1.2)}) > -a * r'), 'clipfrac')}, {r6(mean('-d'), 'kl')}, CAST(0 AS DOUBLE) AS clipfrac_lower FROM y"""
_TAU = f"(CASE WHEN a > 0 THEN {n(1)} ELSE {n(1.05)} END)"
SQL["loss_sapo"] = f"""{ROWS}, y AS (SELECT *, -a * 4 / {_TAU} / (1 + exp(-{_TAU} * (exp(dc) - 1))) AS loss FROM x), {_BY_SEQ}
SELECT (SELECT {r6('avg(m)', 'loss').rsplit(' AS ', 1)[0]} FROM q) AS loss, CAST(0 AS DOUBLE) AS clipfrac, {r6(mean('-dc'), 'kl')}, CAST(0 AS DOUBLE) AS clipfrac_lower FROM y"""
_BENT = f"(sign(a) * least(sign(a) * d, sign(a) * least(greatest(d, {n(-0.2)}), {n(0.2)})))"
SQL["loss_geo_mean"] = f"""{ROWS}, q AS (SELECT seq_id, -sum(a * mask) / (sum(mask) + {E8}) * exp(sum({_BENT} * mask) / (sum(mask) + {E8})) AS l FROM x GROUP BY seq_id)
SELECT (SELECT {r6('avg(l)', 'loss').rsplit(' AS ', 1)[0]} FROM q) AS loss, {r6(frac(f'(d < {n(-0.2)} OR d > {n(0.2)}) AND a > 0'), 'clipfrac')}, {r6(mean('-d'), 'kl')}, {r6(frac(f'(d < {n(-0.2)} OR d > {n(0.2)}) AND a < 0'), 'clipfrac_lower')} FROM x"""
QUERIES["loss_gpg"] = loss_query("gpg", ("loss",))
SQL["loss_gpg"] = f"{ROWS}, y AS (SELECT *, -new_lp * a AS loss FROM x) SELECT {r6(TOKEN_MEAN, 'loss')} FROM y"
QUERIES["loss_reinforce"] = loss_query("reinforce", ("loss", "kl"), weight="value")
SQL["loss_reinforce"] = f"{ROWS}, y AS (SELECT *, -new_lp * a * value AS loss FROM x) SELECT {r6(TOKEN_MEAN, 'loss')}, {r6(mean('-d'), 'kl')} FROM y"
QUERIES["loss_kl_cov"] = loss_query("kl_cov", ("loss", "kl"), ratio=0.01)
SQL["loss_kl_cov"] = f"""{ROWS}, m AS (SELECT {mean('a')} AS ma, {mean('new_lp')} AS ml, sum(mask) AS k FROM x),
c AS (SELECT x.*, (a - ma) * (new_lp - ml) AS cov, k FROM x, m), t AS (SELECT *, CASE WHEN mask > 0 THEN row_number() OVER (PARTITION BY mask ORDER BY cov DESC, seq_id, pos) END AS rk FROM c),
y AS (SELECT *, -a * exp(d) + CASE WHEN rk <= greatest(1, CAST(floor(k * {n(0.01)}) AS BIGINT)) THEN abs(d) ELSE 0 END AS loss FROM t) SELECT {r6(TOKEN_MEAN, 'loss')}, {r6(mean('abs(d)'), 'kl')} FROM y"""
QUERIES["loss_clip_cov"] = loss_query("clip_cov", ("loss", "clipfrac", "kl"), ratio=0.01, least=0.01, most=5.0)
_CUT = f"-a * least(greatest(exp(d), {n(0.8)}), {n(1.2)})"
SQL["loss_clip_cov"] = f"""{ROWS}, m AS (SELECT {mean('a')} AS ma, {mean('new_lp')} AS ml, sum(mask) AS k FROM x),
c AS (SELECT x.*, (a - ma) * (new_lp - ml) AS cov, k, -a * exp(d) AS plain, {_CUT} AS cut, {word_sql('seq_id', 'pos', 0)} AS id FROM x, m),
t AS (SELECT *, mask > 0 AND NOT cut > plain AND cov > {n(0.01)} AND cov < 5 AS able FROM c),
r AS (SELECT *, able AND row_number() OVER (PARTITION BY able ORDER BY CAST(id AS DOUBLE), seq_id, pos) <= greatest(1, CAST(floor(k * {n(0.01)}) AS BIGINT)) AS hit FROM t),
y AS (SELECT *, CASE WHEN hit THEN 0 ELSE greatest(plain, cut) END AS loss FROM r) SELECT {r6(TOKEN_MEAN, 'loss')}, {r6(frac('hit'), 'clipfrac')}, {r6(mean('-d'), 'kl')} FROM y"""


def loss_value(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).withColumns({"predicted": F.col("value") + 2 * F.col("reward"), "returns": F.col("value") * F.col("value")})
    return rounded(L.value_loss(t, "predicted", "value", "returns", cut=0.05), loss="loss", clipfrac="clipfrac", mean="mean")


QUERIES["loss_value"] = loss_value
_HELD = f"pow(least(greatest(value + 2 * reward, value - {n(0.05)}), value + {n(0.05)}) - value * value, 2)"
_FREE = "pow(value + 2 * reward - value * value, 2)"
SQL["loss_value"] = f"{VIEWS} SELECT {r6(f'sum(greatest({_FREE}, {_HELD}) * mask) / sum(mask) / 2', 'loss')}, {r6(frac(f'{_HELD} > {_FREE}'), 'clipfrac')}, {r6(mean('(value + 2 * reward)'), 'mean')} FROM tok"


def loss_kl_penalty(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    kinds = {k: L.kl_penalty(F.col("new_lp"), F.col("ref_lp"), kind) for k, kind in (("k1", "kl"), ("abs_kl", "abs"), ("k2", "mse"), ("k3", "low_var_kl+"))}
    return rounded(t.groupBy("seq_id").agg(*(M.masked_mean(c, "mask").alias(k) for k, c in kinds.items())), "seq_id", **{k: k for k in kinds})


QUERIES["loss_kl_penalty"] = loss_kl_penalty
_D = "(new_lp - ref_lp)"
SQL["loss_kl_penalty"] = f"""{VIEWS} SELECT seq_id, {r6(mean(_D), 'k1')}, {r6(mean(f'abs({_D})'), 'abs_kl')}, {r6(mean(f'({_D} * {_D} / 2)'), 'k2')},
{r6(mean(f'least(greatest(exp(least(greatest(-{_D}, -20), 20)) - least(greatest(-{_D}, -20), 20) - 1, -10), 10)'), 'k3')} FROM tok GROUP BY seq_id"""


def loss_sft(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.sft_loss(tokens(spark, d)), loss="loss")


QUERIES["loss_sft"] = loss_sft
SQL["loss_sft"] = f"{VIEWS}, y AS (SELECT *, coalesce(lead(mask) OVER (PARTITION BY seq_id ORDER BY pos), 0) AS m FROM tok) SELECT {r6('-sum(new_lp * m) / sum(m)', 'loss')} FROM y"


def loss_total(spark: SparkSession, d: str) -> DataFrame:
    """The whole of a step: clipped policy loss, less entropy (here minus the log probability), plus KL."""
    r = rows(spark, d)
    policy = L.policy_loss("vanilla", r).select(F.col("loss").alias("policy"))
    rest = r.agg(M.masked_mean(-F.col("new_lp"), "mask").alias("entropy"), M.masked_mean(L.kl_penalty(F.col("new_lp"), F.col("ref_lp"), "k2"), "mask").alias("kl"))
    out = M.scalar_join(policy, rest)
    return rounded(out, policy="policy", entropy="entropy", kl="kl", total=L.total_loss(F.col("policy"), F.col("entropy"), F.col("kl"), 0.01, 0.1))


QUERIES["loss_total"] = loss_total
_TOTAL = {"policy": TOKEN_MEAN, "entropy": mean("-new_lp"), "kl": mean(f"({_D} * {_D} / 2)")}
SQL["loss_total"] = f"""{ROWS}, y AS (SELECT *, {TOKEN_LOSSES['vanilla'][0]} AS loss FROM x) SELECT {", ".join(r6(v, k) for k, v in _TOTAL.items())},
{r6(f"{_TOTAL['policy']} - {n(0.01)} * {_TOTAL['entropy']} + {n(0.1)} * {_TOTAL['kl']}", 'total')} FROM y"""


# logits: the embeddings' components
def logits_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return rounded(e, "vec_id", lse=M.log_sum_exp("embedding"), entropy=M.entropy("embedding"), log_prob=M.log_prob("embedding", F.col("label")), sum_pi_squared=M.sum_pi_squared("embedding"))


QUERIES["logits_stats"] = logits_stats
_S = "list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE))))"
SQL["logits_stats"] = f"""SELECT vec_id, {r6(f'ln({_S})', 'lse')}, {r6(f'ln({_S}) - list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE)) * CAST(v AS DOUBLE))) / {_S}', 'entropy')},
{r6(f'CAST(embedding[label + 1] AS DOUBLE) - ln({_S})', 'log_prob')}, {r6(f'list_sum(list_transform(embedding, lambda v: exp(2 * CAST(v AS DOUBLE)))) / ({_S} * {_S})', 'sum_pi_squared')} FROM embeddings"""


def distill_topk(spark: SparkSession, d: str) -> DataFrame:
    """Teacher: the first 8 components as logits; student: the next 8."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("p"), F.transform(F.slice("embedding", 9, 8), lambda v: v.cast("double")).alias("q"))
    norm = lambda c: F.transform(c, lambda v: v - M.log_sum_exp(c))
    e = e.select("vec_id", norm("p").alias("p"), norm("q").alias("q"))
    return rounded(e, "vec_id", **L.forward_kl_topk("p", "q"))


QUERIES["distill_topk"] = distill_topk
SQL["distill_topk"] = f"""WITH u AS (SELECT vec_id, unnest(range(1, 9)) AS i, embedding FROM embeddings),
v AS (SELECT vec_id, CAST(embedding[i] AS DOUBLE) AS p, CAST(embedding[i + 8] AS DOUBLE) AS q FROM u),
w AS (SELECT vec_id, p - ln(sum(exp(p)) OVER (PARTITION BY vec_id)) AS p, q - ln(sum(exp(q)) OVER (PARTITION BY vec_id)) AS q FROM v)
SELECT vec_id, {r6('greatest(sum(exp(p) * (p - q)), 0)', 'loss')}, {r6('sum(exp(p))', 'teacher_mass')}, {r6('sum(exp(q))', 'student_mass')} FROM w GROUP BY vec_id"""
