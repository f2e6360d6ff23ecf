"""Queries of operators that the other families do not reach: statistics, corrections, sources, chats, scores, sharing out."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import extensions as X
from tidemill.functions import losses as P
from tidemill.functions import masked as K
from tidemill.functions import scoring as S
from tidemill.functions import text as T
from tidemill.functions.draws import word_sql
from tidemill.operators import advantage as A
from tidemill.operators import balance as L
from tidemill.operators import dispatch as D
from tidemill.operators import metrics as M
from tidemill.operators import offpolicy as O
from tidemill.operators.batch import ROW, Batch, for_generation, generation_view, numbered, varied_groups
from tidemill.plans.advantages import r6, rounded
from tidemill.plans.tables import _LEN, COLS, B, batch, lengths, same, stream
from tidemill.plans.views import VIEWS, scored, sequences, table, tokens
from tidemill.session import shared_folder
from tidemill.sources import tables as R
from tidemill.streaming import events as E
from tidemill.streaming import samples as Q

QUERIES, SQL = {}, {}
E8 = "CAST(1e-8 AS DOUBLE)"


def put(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


# statistics
@put("stat_dense_index", f"{VIEWS} SELECT seq_id, dense_rank() OVER (ORDER BY data_source) - 1 AS i, uid AS j FROM seq")
def dense_index(s: SparkSession, d: str) -> DataFrame:
    return K.dense_index(K.dense_index(sequences(s, d), "data_source", "i"), "uid", "j").select("seq_id", "i", "j")


@put("stat_index_kinds", f"{VIEWS} SELECT seq_id, seq_id AS text, seq_id * 2 AS near, dense_rank() OVER (ORDER BY seq_id / 4.0) - 1 AS fraction, dense_rank() OVER (ORDER BY CASE WHEN seq_id % 9 = 0 THEN NULL ELSE CAST(seq_id % 9 AS VARCHAR) END NULLS FIRST) - 1 AS holes FROM seq")
def index_kinds(s: SparkSession, d: str) -> DataFrame:
    """Labels that are whole numbers as text, or nearly, keep their values; fractions, and texts with a null among them, are numbered."""
    k = F.col("seq_id")
    rows = sequences(s, d).select("seq_id", F.lpad(k.cast("string"), 9, "0").alias("a"), (k * 2 + 1e-7).alias("b"), (k / 4).alias("c"), F.when(k % 9 > 0, (k % 9).cast("string")).alias("d"))
    for label, out in (("a", "text"), ("b", "near"), ("c", "fraction"), ("d", "holes")):
        rows = K.dense_index(rows, label, out)
    return rows.select("seq_id", "text", "near", "fraction", "holes")


@put("stat_pearson", f"{VIEWS} SELECT uid % 50 AS part, {r6('corr(old_lp, rollout_lp + new_lp) FILTER (WHERE mask <> 0)', 'r')} FROM tok GROUP BY 1")
def pearson(s: SparkSession, d: str) -> DataFrame:
    t = tokens(s, d).join(sequences(s, d), "seq_id").groupBy((F.col("uid") % 50).alias("part"))
    return rounded(t.agg(K.pearson("old_lp", F.col("rollout_lp") + F.col("new_lp"), "mask").alias("r")), "part", r="r")


@put("stat_token_diff", f"{VIEWS} SELECT seq_id, CAST(count(*) FILTER (WHERE mask <> 0 AND pos % 2 <> 1) AS BIGINT) AS n_diff FROM tok GROUP BY seq_id")
def token_diff(s: SparkSession, d: str) -> DataFrame:
    t = tokens(s, d).withColumns({"a": F.col("mask").cast("long"), "b": F.col("pos") % 2})
    return t.groupBy("seq_id").agg(*K.token_diff("a", "b", "mask"))


_GAP = "abs(exp(old_lp) - exp(rollout_lp))"


@put("stat_probability_gap", f"{VIEWS} SELECT data_source, CAST(max(CASE WHEN mask <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS valid, {r6(f'max({_GAP}) FILTER (WHERE mask <> 0)', 'gap_max')}, {r6(f'avg({_GAP}) FILTER (WHERE mask <> 0)', 'gap_mean')}, {r6(f'stddev_samp({_GAP}) FILTER (WHERE mask <> 0)', 'gap_std')}, {r6('corr(exp(old_lp), exp(rollout_lp)) FILTER (WHERE mask <> 0)', 'pearson')} FROM tok GROUP BY data_source")
def probability_gap(s: SparkSession, d: str) -> DataFrame:
    t = tokens(s, d).join(sequences(s, d), "seq_id").groupBy("data_source").agg(*K.probability_gap("old_lp", "rollout_lp", "mask"))
    return rounded(t, "data_source", "valid", **{k: k for k in ("gap_max", "gap_mean", "gap_std", "pearson")})


@put("stat_across_workers", f"{VIEWS} SELECT {r6('avg(reward)', 'mean')}, {r6('max(reward)', 'max')}, {r6('min(reward)', 'min')}, {r6('stddev_samp(reward)', 'std')}, {r6(f'sum(reward * mask) / (sum(mask) + {E8})', 'masked_mean')} FROM tok")
def across_workers(s: SparkSession, d: str) -> DataFrame:
    return rounded(K.across_workers(tokens(s, d), "reward", "mask"), **{k: k for k in ("mean", "max", "min", "std", "masked_mean")})


@put("stat_tail", "SELECT vec_id, CAST(8 AS BIGINT) AS n, " + r6("list_sum(list_transform(embedding[len(embedding) - 7 : len(embedding)], lambda v: CAST(v AS DOUBLE)))", "total") + " FROM embeddings")
def tail(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").withColumn("t", K.tail("embedding", 8))
    return rounded(e, "vec_id", F.size("t").cast("long").alias("n"), total=F.aggregate(F.col("t").cast("array<double>"), F.lit(0.0), lambda a, v: a + v))


# advantages
_RAW = """v AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS k, coalesce(lead(value) OVER (PARTITION BY seq_id ORDER BY pos), 0) AS nv FROM tok WHERE mask = 1),
dl AS (SELECT *, reward + CAST(0.9 AS DOUBLE) * nv - value AS delta FROM v),
a AS (SELECT x.seq_id, x.k, sum(pow(CAST(0.72 AS DOUBLE), y.k - x.k) * y.delta) AS adv FROM dl x JOIN dl y ON x.seq_id = y.seq_id AND y.k >= x.k GROUP BY x.seq_id, x.k),
p AS (SELECT seq_id, pos, value, mask, coalesce(sum(mask) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS k FROM tok),
g AS (SELECT p.seq_id, p.pos, p.value, p.mask, coalesce(a.adv, 0) AS adv FROM p LEFT JOIN a ON p.seq_id = a.seq_id AND p.k = a.k)"""


@put("adv_gae_masked", f"{VIEWS}, {_RAW} SELECT seq_id, pos, {r6('adv', 'advantage')}, {r6('adv + value', 'returns')} FROM g")
def gae_masked(s: SparkSession, d: str) -> DataFrame:
    """All tokens: those without mask have what comes after them."""
    return rounded(A.gae(tokens(s, d), gamma=0.9, lam=0.8, whitened=False), "seq_id", "pos", advantage="advantage", returns="returns")


_ONCE = f"{VIEWS}, {_RAW}".replace("tok AS (", "tok AS MATERIALIZED (").replace("dl AS (", "dl AS MATERIALIZED (").replace("g AS (SELECT p.", "g AS MATERIALIZED (SELECT p.")


@put("adv_gae_whitened", f"""{_ONCE}, st AS (SELECT sum(mask) AS n, sum(adv * mask) / (sum(mask) + {E8}) AS mu FROM g),
vr AS (SELECT sum((adv - mu) * (adv - mu) * mask) / (max(n) + {E8}) * max(n) / (max(n) - 1) AS va, max(mu) AS mu FROM g, st) SELECT seq_id, pos, {r6(f'(adv - mu) / sqrt(va + {E8})', 'advantage')}, {r6('adv + value', 'returns')} FROM g, vr""")
def gae_whitened(s: SparkSession, d: str) -> DataFrame:
    return rounded(A.gae(tokens(s, d), gamma=0.9, lam=0.8), "seq_id", "pos", advantage="advantage", returns="returns")


@put("adv_dispatched", f"{VIEWS}, r AS (SELECT seq_id, pos, value, sum(reward) OVER (PARTITION BY seq_id ORDER BY pos DESC) AS g FROM tok), st AS (SELECT avg(g) AS mu, var_samp(g) AS va FROM r) SELECT seq_id, pos, {r6(f'(g - mu) / sqrt(va + {E8})', 'advantage')}, {r6('g', 'returns')} FROM r, st")
def dispatched(s: SparkSession, d: str) -> DataFrame:
    """By name, on tokens that bring no mask."""
    return rounded(A.advantage("reinforce_plus_plus", None, tokens(s, d).drop("mask"), gamma=1.0), "seq_id", "pos", advantage="advantage", returns="returns")


@put("adv_kl_step", f"{VIEWS}, q AS (SELECT seq_id, sum((old_lp - ref_lp) * mask) / (sum(mask) + {E8}) AS k FROM tok GROUP BY seq_id), c AS (SELECT avg(k) AS k FROM q) SELECT {r6('k', 'kl')}, {r6('CAST(0.2 AS DOUBLE) * (1 + greatest(-CAST(0.2 AS DOUBLE), least(CAST(0.2 AS DOUBLE), k / CAST(0.1 AS DOUBLE) - 1)) * CAST(0.5 AS DOUBLE))', 'beta')} FROM c")
def kl_step(s: SparkSession, d: str) -> DataFrame:
    """The batch's divergence, and the adaptive weight after it."""
    out = A.batch_kl(A.kl_rewards(tokens(s, d), F.col("old_lp") - F.col("ref_lp"), 0.2))
    return rounded(out, kl="kl", beta=A.adapted(F.lit(0.2), F.col("kl"), 0.1, 100, 50))


# losses
def with_advantage(s: SparkSession, d: str) -> DataFrame:
    return tokens(s, d).withColumn("advantage", F.col("reward") * 10)


@put("loss_entropy", f"{VIEWS}, q AS (SELECT seq_id, sum(-old_lp * mask) / (sum(mask) + {E8}) AS x FROM tok GROUP BY seq_id HAVING sum(mask) > 0) SELECT {r6('(SELECT sum(-old_lp * mask) / sum(mask) FROM tok)', 'token_mean')}, {r6('avg(x)', 'seq_mean')} FROM q")
def entropy_loss(s: SparkSession, d: str) -> DataFrame:
    t = tokens(s, d).withColumn("entropy", -F.col("old_lp"))
    a, b = P.entropy_loss(t).toDF("a"), P.entropy_loss(t, mode="seq-mean-token-mean").toDF("b")
    return rounded(K.scalar_join(a, b), token_mean="a", seq_mean="b")


_K3 = "least(greatest(exp(ref_lp - new_lp) - (ref_lp - new_lp) - 1, -10), 10)"


@put("loss_distillation", f"{VIEWS} SELECT {r6(f'sum(least({_K3}, CAST(0.05 AS DOUBLE)) * mask) / sum(mask)', 'loss')} FROM tok")
def distillation(s: SparkSession, d: str) -> DataFrame:
    return rounded(P.distillation(tokens(s, d), P.DISTILLATION["k3"](), most=0.05), loss="loss")


_BY = f"""{VIEWS}, w AS (SELECT *, reward * 10 AS advantage, new_lp - old_lp AS st, CASE WHEN mask <> 0 AND old_lp - new_lp BETWEEN -ln(CAST(1.05 AS DOUBLE)) AND ln(CAST(1.05 AS DOUBLE)) THEN 1 ELSE 0 END AS m FROM tok)"""


@put("loss_bypass_reinforce", f"{_BY} SELECT {r6('sum(-new_lp * advantage * least(exp(st) * mask, CAST(1.1 AS DOUBLE)) * m) / sum(m)', 'loss')} FROM w")
def bypass_reinforce(s: SparkSession, d: str) -> DataFrame:
    return rounded(P.policy_loss("bypass_mode", with_advantage(s, d), loss="reinforce", level="token", threshold=1.1, options="token_k1", rejection="1.05"), loss="loss")


_CLIP = "greatest(-advantage * exp(st), -advantage * least(greatest(exp(st), CAST(0.8 AS DOUBLE)), CAST(1.2 AS DOUBLE)))"


@put("loss_bypass_clip", f"{_BY} SELECT {r6(f'sum(CASE WHEN advantage < 0 THEN least(-advantage * 3, {_CLIP}) ELSE {_CLIP} END * m) / sum(m)', 'loss')} FROM w")
def bypass_clip(s: SparkSession, d: str) -> DataFrame:
    return rounded(P.policy_loss("bypass_mode", with_advantage(s, d), options="token_k1", rejection="1.05"), loss="loss")


# corrections
@put("is_correct", f"{VIEWS}, w AS (SELECT *, exp(old_lp - rollout_lp) * mask AS raw, CASE WHEN mask <> 0 AND rollout_lp - old_lp BETWEEN -ln(CAST(1.2 AS DOUBLE)) AND ln(CAST(1.2 AS DOUBLE)) THEN 1 ELSE 0 END AS m FROM tok) SELECT seq_id, CAST(sum(m) AS BIGINT) AS n, {r6('sum(least(raw, CAST(1.5 AS DOUBLE)))', 'weight')} FROM w GROUP BY seq_id")
def corrected(s: SparkSession, d: str) -> DataFrame:
    """Weights and what rejection leaves of the mask, together."""
    out = O.correct(tokens(s, d), "token", 1.5, "token_k1", "1.2").groupBy("seq_id").agg(F.sum("mask").cast("long").alias("n"), F.sum("weight").alias("w"))
    return rounded(out, "seq_id", "n", weight="w")


@put("is_bypass", f"{VIEWS} SELECT seq_id, pos, {r6('rollout_lp', 'old')}, CAST(0 AS DOUBLE) AS gap FROM tok")
def bypassed(s: SparkSession, d: str) -> DataFrame:
    return rounded(O.bypass(tokens(s, d)), "seq_id", "pos", old="old_lp", gap=O.log_ratio())


@put("is_groups", f"{VIEWS} SELECT seq_id, uid FROM sc WHERE uid IN (SELECT uid FROM sc GROUP BY uid HAVING min(score) <> max(score) OR count(*) = 1)")
def groups(s: SparkSession, d: str) -> DataFrame:
    return varied_groups(scored(s, d)).select("seq_id", "uid")


# metrics and evaluation
@put("metric_imbalance", f"{_LEN}, n AS (SELECT count(*) AS n FROM ln), c AS (SELECT (row_number() OVER (ORDER BY row_idx) - 1) * 8 // n AS c, seqlen FROM ln, n), t AS (SELECT sum(seqlen) AS s FROM c GROUP BY c), p AS (SELECT sum(seqlen) AS s FROM ln GROUP BY row_idx % 8) SELECT {r6('min(s)', 'minmax_min')}, {r6('max(s)', 'minmax_max')}, {r6('avg(s)', 'mean')}, {r6('max(s) - min(s)', 'minmax_diff')}, {r6('(SELECT min(s) FROM p)', 'balanced_min')}, {r6('(SELECT max(s) FROM p)', 'balanced_max')} FROM t")
def imbalance(s: SparkSession, d: str) -> DataFrame:
    rows = lengths(s, d).withColumnRenamed("row_idx", "key").withColumn("part", F.col("key") % 8)
    out = M.imbalance(numbered(rows, "key"), 8)
    return rounded(out, **{k: F.col(k).cast("double") for k in ("minmax_min", "minmax_max", "mean", "minmax_diff", "balanced_min", "balanced_max")})


@put("metric_components", f"{VIEWS}, l AS (SELECT 'score' AS key, score AS v FROM sc UNION ALL SELECT 'length', CAST(length AS DOUBLE) FROM sc) SELECT key, {r6('avg(v)', 'mean')}, {r6('stddev_pop(v)', 'std')}, {r6('max(v)', 'max')}, {r6('min(v)', 'min')} FROM l GROUP BY key")
def components(s: SparkSession, d: str) -> DataFrame:
    return rounded(M.component_stats(scored(s, d), ["score", "length", "missing"]), "key", **{k: k for k in ("mean", "std", "max", "min")})


_SPECIAL = ("global_seqlen/max", "global_seqlen/min", "global_seqlen/minmax_diff", "perf/throughput", "perf/total_num_tokens", "perf/time_per_step", "timing_s/gen", "timing_s/step")


@put("metric_specials", f"""WITH v AS (SELECT {list(_SPECIAL)}[event_id % 8 + 1] AS name, coalesce(value, 0) + 1 AS value FROM events),
a AS (SELECT name, CASE WHEN name LIKE 'timing_s/%' THEN sum(value) WHEN name LIKE '%max%' THEN max(value) WHEN name LIKE '%min%' THEN min(value) WHEN name LIKE '%total%' THEN sum(value) ELSE avg(value) END AS value FROM v GROUP BY name),
w AS (SELECT max(value) FILTER (WHERE name = 'global_seqlen/max') AS hi, max(value) FILTER (WHERE name = 'global_seqlen/min') AS lo, max(value) FILTER (WHERE name = 'perf/total_num_tokens') AS tk, max(value) FILTER (WHERE name = 'perf/time_per_step') AS ti, max(value) FILTER (WHERE name = 'timing_s/gen') AS g, max(value) FILTER (WHERE name = 'timing_s/step') AS st FROM a)
SELECT name, {r6("CASE name WHEN 'global_seqlen/minmax_diff' THEN hi - lo WHEN 'perf/throughput' THEN tk / (ti * 4) ELSE value END", 'value')} FROM a, w UNION ALL SELECT 'fully_async/trainer/idle_ratio', {r6('g / st', 'value')} FROM w""")
def specials(s: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _SPECIAL)), (F.col("event_id") % 8 + 1).cast("int"))
    rows = table(s, d, "events").select(name.alias("name"), (F.coalesce("value", F.lit(0.0)) + 1).alias("value"), F.lit(1).alias("weight"))
    return rounded(M.specials(M.aggregate_steps(rows), 4), "name", value="value")


_EXPERTS = {"hidden_size": 2048, "vocab_size": 151936, "layers": 48, "heads": 32, "kv_heads": 4, "head_dim": 128, "experts": 128, "expert_size": 768, "chosen": 8}
_N = (2048 * 128 + 2048 * 768 * 8 * 3 + 2048 * 128 * (32 + 4 + 4 + 32)) * 48 + 151936 * 2048 * 2


@put("metric_flops_experts", f"{_LEN} SELECT {r6(f'(CAST(6 AS DOUBLE) * {_N} * sum(seqlen) + CAST(6 AS DOUBLE) * {128 * 32 * 48} * sum(CAST(seqlen AS DOUBLE) * seqlen)) / 2 / 1e12', 'tflops')}, CAST(0 AS DOUBLE) AS unknown FROM ln")
def flops_experts(s: SparkSession, d: str) -> DataFrame:
    a, b = M.flops_of(lengths(s, d), "qwen3_moe", _EXPERTS, 2.0), M.flops_of(lengths(s, d), "another", {}, 2.0).toDF("b")
    return rounded(K.scalar_join(a, b), tflops="tflops", unknown="b")


@put("metric_response_info", f"{VIEWS}, m AS (SELECT seq_id, max(pos) AS top, CAST(count(*) FILTER (WHERE mask <> 0 AND pos < 3) AS BIGINT) AS prompt_length, CAST(count(*) FILTER (WHERE mask <> 0 AND pos >= 3) AS BIGINT) AS response_length FROM tok GROUP BY seq_id) SELECT seq_id, prompt_length, response_length FROM m")
def response_info(s: SparkSession, d: str) -> DataFrame:
    """A prompt of 3 places and a response of 13, or of as many as a sequence has."""
    at = F.collect_set(F.when(F.col("mask") != 0, F.col("pos")))
    places = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("top"), F.lit(15)))
    masks = tokens(s, d).groupBy("seq_id").agg(at.alias("at"), F.max("pos").alias("top")).withColumn("attention_mask", F.transform(places, lambda i: F.array_contains("at", i).cast("long")))
    return M.response_info(masks, width=F.size("attention_mask") - 3).select("seq_id", "prompt_length", "response_length")


@put("metric_agent_loops", f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS generate, l_extendedprice / 1000 AS tool, l_linenumber AS turn FROM lineitem), w AS (SELECT * FROM r ORDER BY generate + tool DESC, l_orderkey DESC, l_linenumber DESC LIMIT 1)
SELECT {r6('min(generate)', 'generate_min')}, {r6('max(generate)', 'generate_max')}, {r6('avg(generate)', 'generate_mean')}, {r6('min(tool)', 'tool_min')}, {r6('max(tool)', 'tool_max')}, {r6('avg(tool)', 'tool_mean')}, (SELECT CAST(l_orderkey AS BIGINT) FROM w) AS slowest_l_orderkey, (SELECT CAST(l_linenumber AS BIGINT) FROM w) AS slowest_l_linenumber FROM r""")
def agent_loops(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("generate"), (F.col("l_extendedprice") / 1000).alias("tool"))
    out = M.slowest(li, ["generate", "tool"], ["l_orderkey", "l_linenumber"])
    return rounded(out, *(F.col(f"slowest_{c}").cast("long").alias(f"slowest_{c}") for c in ("l_orderkey", "l_linenumber")), **{f"{p}_{h}": f"{p}_{h}" for p in ("generate", "tool") for h in ("min", "max", "mean")})


@put("metric_names", "SELECT doc_id, regexp_replace(regexp_replace(replace(source || '@' || lang || '//' || doc_id || '#', '@', '_at_'), '/+', '/', 'g'), '[^/\\w.\\- :]', '_', 'g') AS name FROM documents")
def metric_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", M.sanitised(F.concat("source", F.lit("@"), "lang", F.lit("//"), F.col("doc_id").cast("string"), F.lit("#"))).alias("name"))


def two_runs(s: SparkSession, d: str) -> list[DataFrame]:
    rows = scored(s, d).select("data_source", "uid", F.col("seq_id").alias("order"), F.col("score").alias("acc"), F.col("length").cast("double").alias("size"))
    return [rows.where("order % 2 = 0"), rows.where("order % 2 = 1").drop("size")]


@put("eval_merged", f"""{VIEWS}, r AS (SELECT data_source, uid, 'acc' AS variable, score AS v FROM sc UNION ALL SELECT data_source, uid, 'size', CAST(length AS DOUBLE) FROM sc WHERE seq_id % 2 = 0),
g AS (SELECT data_source, uid, variable, count(*) AS n, avg(v) AS m, stddev_pop(v) AS sd FROM r GROUP BY ALL),
l AS (SELECT data_source, variable, n, 'mean@' || n AS metric, m AS v FROM g UNION ALL SELECT data_source, variable, n, 'std@' || n, sd FROM g WHERE n > 1),
a AS (SELECT data_source, variable, metric, any_value(n) AS n, avg(v) AS v FROM l GROUP BY data_source, variable, metric),
x AS (SELECT *, max(n) OVER (PARTITION BY data_source) AS top FROM a)
SELECT data_source, variable, metric, CASE WHEN variable = 'acc' AND metric LIKE 'mean%' AND n = top THEN 'val-core' ELSE 'val-aux' END || '/' || data_source || '/' || variable || '/' || metric AS name, {r6('v', 'value')} FROM x""")
def merged(s: SparkSession, d: str) -> DataFrame:
    """Two runs as one, of which one lacks a variable; what is drawn at random is left out."""
    out = M.validation_metrics(M.merged_validation(*two_runs(s, d), None), ["acc", "size"], times=0)
    return rounded(M.validation_names(out), "data_source", "variable", "metric", "name", value="value")


# the table algebra
put("tbl_select", f"{B} SELECT row_idx, cust FROM b")(lambda s, d: batch(s, d).select(["cust"]).rows.select(ROW, "cust"))
put("tbl_pop", f"{B} SELECT row_idx, key AS popped, status FROM b")(lambda s, d: popped(batch(s, d)))
put("tbl_rename", f"{B} SELECT row_idx, key AS id, cust AS customer, status FROM b")(lambda s, d: batch(s, d).rename(["key", "cust"], ["id", "customer"]).rows.select(ROW, "id", "customer", "status"))
put("tbl_take", f"{B} SELECT i.new AS row_idx, key, cust, status FROM b JOIN (SELECT * FROM (VALUES (0, 5), (1, 0), (2, 5), (3, 17)) AS t(new, old)) i ON b.row_idx = i.old")(lambda s, d: same(batch(s, d).take([5, 0, 5, 17])))
put("tbl_index", f"{B} SELECT row_idx - 10 AS row_idx, key, cust, status FROM b WHERE row_idx BETWEEN 10 AND 99")(lambda s, d: same(batch(s, d)[10:100]))
put("tbl_unpad", f"{B} SELECT * FROM b")(lambda s, d: same(unpadded(batch(s, d))))
put("tbl_blank_rows", f"{B} SELECT row_idx, key, cust, status, 0 AS is_padding FROM b UNION ALL SELECT n + k, CAST(-1 AS BIGINT), NULL, NULL, 1 FROM n, (SELECT unnest(range(1000)) AS k) WHERE k < (1000 - n % 1000) % 1000")(lambda s, d: same(batch(s, d).with_padding_rows(1000, {"key": F.lit(-1).cast("long")}), "is_padding"))
put("tbl_unfold_rows", f"{B}, x AS (SELECT n // 5 * 5 AS m FROM n) SELECT row_idx, key, cust, status FROM b, x WHERE row_idx < m OR m < (SELECT n FROM n)")(lambda s, d: same(batch(s, d).fold(5).unfold_rows()))
put("tbl_for_generation", f"{B} SELECT row_idx * 2 + k AS row_idx, key, cust, status, 'single_turn' AS agent_name FROM b, (SELECT unnest(range(2)) AS k)")(lambda s, d: for_generation(batch(s, d), 2, "single_turn").rows.select(*COLS, "agent_name"))
put("tbl_generation_view", f"{B} SELECT row_idx, status FROM b")(lambda s, d: generation_view(batch(s, d), ["status", "absent"])[1].rows.select(ROW, "status"))
put("tbl_saved", f"{B} SELECT * FROM b")(lambda s, d: saved(s, batch(s, d)))
put("tbl_from_rows", "SELECT CAST(r_regionkey AS BIGINT) AS row_idx, r_name AS name FROM region")(lambda s, d: from_records(s, d))
put("tbl_inverse", f"{B} SELECT row_idx, key, cust, status FROM b")(lambda s, d: there_and_back(batch(s, d)))


def popped(b: Batch) -> DataFrame:
    out, rest = b.pop(["key"])
    return rest.union(Batch(out.rows.withColumnRenamed("key", "popped"))).rows.select(ROW, "popped", "status")


def unpadded(b: Batch) -> Batch:
    padded, extra = b.pad_to(4096)
    return padded.unpad(extra)


def saved(s: SparkSession, b: Batch) -> DataFrame:
    path = folder(s, "batch")
    b.save(path)
    return same(Batch.load(s, path))


def from_records(s: SparkSession, d: str) -> DataFrame:
    from tidemill.operators.batch import from_rows

    return from_rows(s, [{"name": r[0]} for r in table(s, d, "region").orderBy("r_regionkey").select("r_name").collect()], "name string").rows.select(ROW, "name")


def there_and_back(b: Batch) -> DataFrame:
    n = len(b)
    moved = b.rows.select(ROW, ((F.col(ROW) * 7 + 3) % n).alias("new")) if n % 7 else b.rows.select(ROW, (n - 1 - F.col(ROW)).alias("new"))
    return same(b.reorder(moved, ROW, "new").reorder(L.inverse(moved, ROW, "new"), ROW, "new"))


# dispatch
def _count(batches):
    for pdf in batches:
        yield pd.DataFrame({"n": [len(pdf)], "keys": [int(pdf["key"].sum())]})


put("dispatch_rows", f"{B} SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(key) AS BIGINT) AS keys FROM b")(lambda s, d: D.run("dp_compute_proto", batch(s, d).rows, _count, "n long, keys long", 4).agg(F.sum("n").alias("n"), F.sum("keys").alias("keys")))
put("dispatch_ranks", f"{B} SELECT row_idx % 4 AS rank, CAST(count(*) AS BIGINT) AS n, CAST(sum(key) AS BIGINT) AS keys FROM b GROUP BY 1")(
    lambda s, d: D.run("dp_compute", batch(s, d).rows.withColumn("rank", F.col(ROW) % 4), lambda pdf: pd.DataFrame({"rank": [pdf["rank"].iloc[0]], "n": [len(pdf)], "keys": [int(pdf["key"].sum())]}), "rank long, n long, keys long"))
put("dispatch_shared", f"{B} SELECT CAST(sum(key * 3) AS BIGINT) AS keys FROM b")(lambda s, d: D.run("one_to_all", batch(s, d).rows, lambda batches, k: (pd.DataFrame({"keys": [int((p["key"] * k).sum())]}) for p in batches), "keys long", 3).agg(F.sum("keys").alias("keys")))
put("dispatch_groups", f"{B} SELECT row_idx % 3 AS rank, count(*) AS n FROM b WHERE row_idx % 3 IN (0, 2) GROUP BY 1")(lambda s, d: D.collected(batch(s, d).rows.withColumn("rank", F.col(ROW) % 3), [0, 2]).groupBy("rank").agg(F.count("*").alias("n")))


# sources and sinks
@put("src_tables", "WITH f AS (SELECT n_nationkey AS key, n_name AS name, 0 AS k FROM nation UNION ALL SELECT n_nationkey, n_name, 1 FROM nation) SELECT k * 25 + key AS row_idx, name FROM f")
def read(s: SparkSession, d: str) -> DataFrame:
    """Files one after another; rows in the order that they have in the files."""
    table(s, d, "nation")
    return R.read_tables(s, [f"{d}/nation.parquet"] * 2).select(ROW, F.col("n_name").alias("name"))


@put("src_dump", "SELECT CAST(doc_id % 3 AS BIGINT) AS step, lang AS input, regexp_replace(source, 'src', '*', 'g') AS output, CAST(n_chars AS BIGINT) AS score, count(*) AS n FROM documents GROUP BY ALL")
def dump(s: SparkSession, d: str) -> DataFrame:
    """Rollouts written as JSON lines, a folder per step, and read again with a pattern masked."""
    path = folder(s, "dump")
    R.write_dump(table(s, d, "documents").select(F.col("lang").alias("input"), F.col("source").alias("output"), F.col("n_chars").alias("score"), (F.col("doc_id") % 3).alias("step")), path)
    back = R.read_dump(s, path, "src")
    return back.groupBy(F.col("step").cast("long").alias("step"), "input", "output", F.col("score").cast("long").alias("score")).agg(F.count("*").alias("n"))


@put("src_browse", "SELECT doc_id, source FROM documents WHERE contains(coalesce(source, ''), '1') OR contains(coalesce(lang, ''), '1') OR contains(coalesce(text, ''), '1')")
def browse(s: SparkSession, d: str) -> DataFrame:
    return R.browse(table(s, d, "documents").withColumn("score", F.col("n_chars")), "1", fields=["doc_id", "source"])


@put("src_browse_order", "(SELECT 'most' AS which, doc_id, n_chars * 1000000 + doc_id AS score FROM documents ORDER BY 3 DESC LIMIT 30) UNION ALL (SELECT 'least', doc_id, n_chars * 1000000 + doc_id FROM documents WHERE contains(text, 'th') ORDER BY 3 LIMIT 30) UNION ALL SELECT 'request', doc_id, n_chars * 1000000 + doc_id FROM documents WHERE doc_id % 50 = 7")
def browse_order(s: SparkSession, d: str) -> DataFrame:
    """The first rows by score either way, and those of one request, its id written with and without hyphens."""
    request = F.concat_ws("-", F.lit("ab12"), (F.col("doc_id") % 50).cast("string"), F.lit("ff"))
    dump = table(s, d, "documents").select("doc_id", "text", (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("score"), F.when(F.col("doc_id") % 2 == 0, request).otherwise(F.replace(request, F.lit("-"), F.lit(""))).alias("request_id"))
    named = lambda rows, which: rows.select(F.lit(which).alias("which"), "doc_id", "score")
    most, least = R.browse(dump).limit(30), R.browse(dump, "th", descending=False).limit(30)
    return named(most, "most").unionByName(named(least, "least")).unionByName(named(R.browse(dump, request="ab127-f-f"), "request"))


@put("src_ordered", f"{B} SELECT CAST(row_number() OVER (ORDER BY {word_sql(11, 'row_idx')}, row_idx) - 1 AS BIGINT) AS row_idx, key, cust, status FROM b")
def in_drawn_order(s: SparkSession, d: str) -> DataFrame:
    return same(R.ordered(batch(s, d).rows, True, seed=11))


@put("src_validation_sample", f"SELECT text_md5, n FROM (SELECT md5(text) AS text_md5, length(text) AS n, text FROM documents GROUP BY text) ORDER BY {word_sql('text', 42)}, text LIMIT 25")
def validation_sample(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select(F.col("text").alias("input")).distinct()
    return R.validation_sample(rows, 25).select(F.md5("input").alias("text_md5"), F.length("input").cast("long").alias("n"))

@put("src_responses", f"{VIEWS} SELECT uid, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(seq_id AS VARCHAR), ',' ORDER BY seq_id) AS responses FROM seq GROUP BY uid")
def responses(s: SparkSession, d: str) -> DataFrame:
    """Prompts with their responses in order, written and read."""
    path, seqs = folder(s, "responses"), sequences(s, d)
    prompts = numbered(seqs.select("uid").distinct(), "uid")
    R.write_responses(prompts, seqs.join(prompts, "uid").select(ROW, F.col("seq_id").alias("k"), F.col("seq_id").cast("string").alias("response")), path)
    return s.read.parquet(path).select("uid", F.size("responses").cast("long").alias("n"), F.array_join("responses", ",").alias("responses"))


@put("src_replayed", f"{B} SELECT cust, count(*) AS n FROM b GROUP BY cust")
def replayed(s: SparkSession, d: str) -> DataFrame:
    """A step's table, made once and read the second time."""
    path, made = folder(s, "step"), lambda: same(batch(s, d))
    R.replayed(s, path, made)
    return R.replayed(s, path, lambda: made().limit(0)).groupBy("cust").agg(F.count("*").alias("n"))


@put("src_metrics", "SELECT CAST(event_id % 50 AS BIGINT) AS step, " + r6("sum(value)", "total") + " FROM events GROUP BY 1")
def metric_lines(s: SparkSession, d: str) -> DataFrame:
    path = folder(s, "metrics")
    R.write_metrics(table(s, d, "events").groupBy((F.col("event_id") % 50).alias("step")).agg(F.sum("value").alias("total")), path)
    return rounded(s.read.json(path), F.col("step").cast("long").alias("step"), total="total")


@put("src_finished", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 0 END AS index, '{}' AS tools_kwargs FROM documents")
def finished(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("index")).alias("extra_info"))
    return R.finished(rows).select("doc_id", F.col("index").cast("long").alias("index"), "tools_kwargs")


# sharing out
@put("balance_in_rank", f"{_LEN}, r AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY 24576 * seqlen + seqlen * seqlen, row_idx) - 1 AS r, count(*) OVER (PARTITION BY step) AS n FROM ln) SELECT step, row_idx, CAST(0 AS BIGINT) AS part, CAST(CASE WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - r // 2 END AS BIGINT) AS place FROM r")
def in_rank(s: SparkSession, d: str) -> DataFrame:
    """One rank: light rows at both ends, heavy ones in the middle."""
    return L.in_rank_order(lengths(s, d), "step", 1).select("step", "row_idx", "part", "place")


@put("balance_greedy", f"""{_LEN}, o AS (SELECT step, row_idx, seqlen, row_number() OVER (PARTITION BY step ORDER BY row_idx) AS i FROM ln),
g AS (WITH RECURSIVE w(step, i, row_idx, part, a, b) AS (
  SELECT step, i, row_idx, CAST(0 AS BIGINT), CAST(24576 * seqlen + seqlen * seqlen AS BIGINT), CAST(0 AS BIGINT) FROM o WHERE i = 1
  UNION ALL SELECT o.step, o.i, o.row_idx, CASE WHEN w.a <= w.b THEN 0 ELSE 1 END, w.a + CASE WHEN w.a <= w.b THEN 24576 * seqlen + seqlen * seqlen ELSE 0 END, w.b + CASE WHEN w.a <= w.b THEN 0 ELSE 24576 * seqlen + seqlen * seqlen END
  FROM w JOIN o ON o.step = w.step AND o.i = w.i + 1) SELECT * FROM w)
SELECT step, row_idx, part FROM g""")
def greedy(s: SparkSession, d: str) -> DataFrame:
    """Row by row to the lighter of two sets: each placement against the recursion."""
    return L.assigned(lengths(s, d), "step", 2, how="greedy").select("step", "row_idx", "part")


# chats and tokens
@put("text_within", "SELECT doc_id FROM documents WHERE length(text) <= 500")
def within(s: SparkSession, d: str) -> DataFrame:
    return T.within(table(s, d, "documents"), F.length("text"), 500).select("doc_id")


@put("text_left_padding", "SELECT vec_id, CAST(vec_id % 9 AS BIGINT) AS n, " + r6("coalesce(list_sum(list_transform(embedding[len(embedding) - vec_id % 9 + 1 : len(embedding)], lambda v: CAST(v AS DOUBLE))), 0)", "total") + " FROM embeddings")
def left_padding(s: SparkSession, d: str) -> DataFrame:
    n = (F.col("vec_id") % 9).cast("int")
    mask = F.transform("embedding", lambda _, i: (i >= F.size("embedding") - n).cast("int"))
    x = table(s, d, "embeddings").withColumn("t", T.without_left_padding("embedding", mask))
    return rounded(x, "vec_id", F.size("t").cast("long").alias("n"), total=F.aggregate(F.col("t").cast("array<double>"), F.lit(0.0), lambda a, v: a + v))


@put("text_response_part", "SELECT vec_id, CAST(7 AS BIGINT) AS ones, " + r6("list_sum(list_transform(embedding[5:11], lambda v: CAST(v AS DOUBLE)))", "total") + " FROM embeddings")
def response_part(s: SparkSession, d: str) -> DataFrame:
    """A prompt of 5 tokens and a response of 7: the values one place earlier, and the response's mask."""
    x = table(s, d, "embeddings").withColumns({"t": T.response_part("embedding", F.lit(5), F.lit(7)), "m": T.mask_of(F.lit(7), 12)})
    return rounded(x, "vec_id", F.aggregate("m", F.lit(0), lambda a, v: a + v).cast("long").alias("ones"), total=F.aggregate(F.col("t").cast("array<double>"), F.lit(0.0), lambda a, v: a + v))


@put("text_full_width", "SELECT vec_id, " + r6("list_sum(list_transform(embedding[5:11], lambda v: CAST(v AS DOUBLE)))", "total") + ", " + r6("CAST(embedding[5 + vec_id % 3] AS DOUBLE)", "first") + ", CAST(12 AS BIGINT) AS width FROM embeddings")
def full_width(s: SparkSession, d: str) -> DataFrame:
    """Responses of 7 tokens after prompts of 5 to 7, back where they were among 12 and more."""
    prompt = (F.col("vec_id") % 3 + 5).cast("int")
    x = table(s, d, "embeddings").withColumn("t", T.full_width(T.response_part("embedding", F.lit(5), F.lit(7)), F.lit(5), 12)).withColumn("u", T.full_width(T.response_part("embedding", prompt, F.lit(3)), prompt, 12))
    return rounded(x, "vec_id", F.size("u").cast("long").alias("width"), total=F.aggregate("t", F.lit(0.0), lambda a, v: a + v), first=F.element_at("u", prompt))


@put("text_preference_tokens", "SELECT doc_id, CAST(12 AS BIGINT) AS width, CAST(CASE WHEN text IS NULL THEN NULL WHEN len(string_split(text, ' ')) < 12 THEN 1 ELSE 0 END AS BIGINT) AS ended FROM documents")
def preference_tokens(s: SparkSession, d: str) -> DataFrame:
    """Word lengths as tokens, an end of -1 and a fill of -2; a null text has none."""
    x = table(s, d, "documents").withColumn("t", T.preference_tokens(F.transform(F.split("text", " "), F.length), 12, -2, -1))
    return x.select("doc_id", F.coalesce(F.when(F.col("t").isNotNull(), F.size("t")), F.lit(12)).cast("long").alias("width"), F.array_contains("t", -1).cast("long").alias("ended"))


@put("text_media", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 4 ELSE 5 END AS BIGINT) AS parts, 'img' || doc_id || ',' || 'vid' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',jmg' || doc_id END AS items FROM documents")
def media(s: SparkSession, d: str) -> DataFrame:
    """Two kinds of marks, each filled in order."""
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("see <image> and <video>"), F.when(F.col("doc_id") % 2 == 1, "<image>").otherwise(""))
    images = F.filter(F.array(F.concat(F.lit("img"), k), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("jmg"), k))), lambda x: x.isNotNull())
    x = table(s, d, "documents").withColumn("p", T.with_all_media(T.segments(text), image=images, video=F.array(F.concat(F.lit("vid"), k))))
    return x.select("doc_id", F.size("p").cast("long").alias("parts"), F.array_join("p.item", ",").alias("items"))


@put("text_channel_calls", "SELECT c_custkey, CAST(1 AS BIGINT) AS n, 'find' AS name, '{\"nation\": ' || c_nationkey || '}' AS args FROM customer")
def channel_calls(s: SparkSession, d: str) -> DataFrame:
    call = F.concat(F.lit('<|start|>assistant<|channel|>analysis<|message|>to=functions.no <|end|><|start|>assistant<|channel|>commentary to=functions.find <|constrain|>json<|message|>{"nation": '), F.col("c_nationkey").cast("string"), F.lit("}<|call|>"))
    x = table(s, d, "customer").withColumn("c", T.channel_calls(call))
    return x.select("c_custkey", F.size("c").cast("long").alias("n"), F.col("c")[0]["name"].alias("name"), F.col("c")[0]["arguments"].alias("args"))


@put("text_xml_calls", "SELECT c_custkey, CAST(2 AS BIGINT) AS n, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey % 2 = 0 AS VARCHAR) AS flag FROM customer")
def xml_calls(s: SparkSession, d: str) -> DataFrame:
    """Typed parameters of calls in tags."""
    call = F.concat(F.lit("<function=find>\n<parameter=nation>\n"), F.col("c_nationkey").cast("string"), F.lit("\n</parameter><parameter=flag>"), F.upper((F.col("c_custkey") % 2 == 0).cast("string")), F.lit("</parameter></function>"))
    x = table(s, d, "customer").withColumn("c", T.xml_calls_udf({"find": {"nation": "integer", "flag": "boolean"}})(F.concat(F.lit("so <tool_call>"), call, call)))
    return x.select("c_custkey", F.size("c").cast("long").alias("n"), F.get_json_object(F.col("c")[0], "$.arguments.nation").alias("nation"), F.get_json_object(F.col("c")[1], "$.arguments.flag").alias("flag"))


@put("text_brace_calls", "SELECT c_custkey, c_custkey + c_nationkey AS total FROM customer")
def brace_calls(s: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("long")
    def total(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sum(v for c in T.brace_calls(t) for v in c["arguments"].values() if isinstance(v, int)))

    text = F.concat(F.lit("call:add{a:"), F.col("c_custkey").cast("string"), F.lit(',b:<|"|>1,2<|"|>}call:add{c:'), F.col("c_nationkey").cast("string"), F.lit("}"))
    return table(s, d, "customer").select("c_custkey", total(text).alias("total"))


_ASK = " Let''s think step by step and output the final answer after \"####\"."


@put("text_gsm8k_prompt", f"SELECT 'openai/gsm8k' AS data_source, coalesce(text, '') || '{_ASK}' AS content, CAST(1000 + doc_id AS VARCHAR) AS ground_truth, doc_id AS index FROM documents")
def gsm8k_prompt(s: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("so\n#### "), F.format_number(F.col("doc_id") + 1000, 0))
    x = table(s, d, "documents").select(*T.gsm8k_prompt(F.coalesce("text", F.lit("")), answer, F.col("doc_id")))
    return x.select("data_source", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.index")


@put("text_math_prompt", "SELECT 'p' || doc_id || ' Let''s think step by step and output the final answer within \\boxed{}.' AS content, '\\frac{' || doc_id || '}{2}' AS ground_truth, doc_id AS index FROM documents")
def math_prompt(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    x = table(s, d, "documents").select(*T.math_prompt(F.concat(F.lit("p"), k), F.concat(F.lit("first \\boxed{1}, so \\boxed{\\frac{"), k, F.lit("}{2}}.")), F.col("doc_id")))
    return x.select(F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", "extra_info.index")


@put("text_choice_prompt", "SELECT doc_id AS index, lang || ': he goes. And on ' || source AS content, CAST(doc_id % 4 AS INT) AS ground_truth, 'one' || source AS choice FROM documents WHERE doc_id % 5 > 0")
def choice_prompt(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("lang").alias("activity_label"), F.lit("he goes.").alias("ctx_a"), F.concat(F.lit("AND ON "), F.upper("source")).alias("ctx_b"),
                                           F.array(F.concat(F.lit("one[note]"), "source")).alias("endings"), F.when(F.col("doc_id") % 5 == 0, "").otherwise((F.col("doc_id") % 4).cast("string")).alias("label"))
    x = T.choice_prompt(rows)
    return x.select("extra_info.index", F.col("prompt")[0]["content"].alias("content"), "reward_model.ground_truth", F.col("choices")[0].alias("choice"))


@put("text_search_prompt", "SELECT 'searchR1_' || source AS data_source, 'lead: q' || doc_id AS content, doc_id AS index, lang AS wanted FROM documents")
def search_prompt(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "documents").select(*T.search_prompt(F.concat(F.lit("q"), F.col("doc_id").cast("string")), F.col("lang"), F.col("source"), F.col("doc_id"), "be brief", "lead: \n"))
    return x.select("data_source", F.col("prompt")[1]["content"].alias("content"), "extra_info.index", F.col("extra_info.tools_kwargs.search.create_kwargs.ground_truth").alias("wanted"))


def pairs(s: SparkSession, d: str) -> DataFrame:
    return batch(s, d).rows.select(ROW, F.col("status").alias("prompt"), F.concat(F.lit("c"), F.col("key").cast("string")).alias("chosen"), F.concat(F.lit("r"), F.col("key").cast("string")).alias("rejected"))


put("text_preferred_sft", f"{B} SELECT status AS prompt, x || key AS response FROM b, (SELECT unnest(['c', 'r']) AS x)")(lambda s, d: T.preferred_sft(pairs(s, d)))
put("text_preferred_split", f"{B} SELECT row_idx, CASE WHEN row_idx < round(n * CAST(0.75 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM b, n")(lambda s, d: T.preferred_split(pairs(s, d)).select(ROW, "split"))
put("text_multiturn", "SELECT conv_id, count(*) AS n, false AS enable_thinking FROM conversations GROUP BY conv_id")(lambda s, d: T.multiturn_rows(table(s, d, "conversations")).select("conv_id", F.size("messages").cast("long").alias("n"), "enable_thinking"))


@put("text_agent_rows", f"{VIEWS}, r AS (SELECT seq_id, (pos + 1) * 3 - 3 AS head, mask FROM tok WHERE pos < 3) SELECT seq_id, CAST(least(count(*) * 3, 8) AS BIGINT) AS n, CAST(sum(mask * greatest(least(8 - head, 3), 0)) AS BIGINT) AS own FROM r GROUP BY seq_id")
def agent_rows(s: SparkSession, d: str) -> DataFrame:
    """Turns of 3 tokens, returned line items for observations, cut to 8 tokens."""
    steps = tokens(s, d).where("pos < 3").select("seq_id", F.col("pos").alias("turn"), F.when(F.col("mask") != 0, "assistant").otherwise("tool").alias("role"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("ids"))
    x = T.agent_rows(steps, 8)
    return x.select("seq_id", F.size("response_ids").cast("long").alias("n"), F.aggregate("response_mask", F.lit(0), lambda a, v: a + v).cast("long").alias("own"))


# scores
def _doc(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "n_chars")


@put("score_gsm8k_flexible", f"SELECT doc_id, {r6('CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END', 'score')} FROM documents")
def gsm8k_flexible(s: SparkSession, d: str) -> DataFrame:
    """The last number at all, whatever is written about it."""
    x = _doc(s, d)
    n = F.col("doc_id").cast("string")
    said = F.concat(F.regexp_replace("text", "[0-9.,]", ""), F.lit(" 5 so "), F.when(F.col("doc_id") % 3 == 0, n).otherwise("17x3"), F.lit(" it is"))
    return rounded(x, "doc_id", score=S.gsm8k(said, F.when(F.col("doc_id") % 3 == 0, n).otherwise("17"), flexible=True))


@put("score_answers_equal", f"SELECT doc_id, {r6('CASE WHEN doc_id % 5 < 4 THEN 1 ELSE 0 END', 'score')} FROM documents")
def answers_equal(s: SparkSession, d: str) -> DataFrame:
    """Fractions, products with pi, matrices and intervals against the same in another form; and a wrong one."""
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    said = F.when(k == 0, F.concat(F.lit("\\boxed{\\frac{"), n, F.lit("}{4}}"))).when(k == 1, F.concat(F.lit("\\boxed{"), n, F.lit("\\pi}"))).when(k == 2, F.concat(F.lit("\\boxed{\\begin{pmatrix}"), n, F.lit("&2\\\\3&4\\end{pmatrix}}"))).when(k == 3, F.concat(F.lit("\\boxed{(0,"), n, F.lit("]}"))).otherwise("\\boxed{-7}")
    truth = F.when(k == 0, (F.col("doc_id") / 4).cast("string")).when(k == 1, F.concat(n, F.lit("*3.14159265"))).when(k == 2, F.concat(F.lit("\\begin{bmatrix}"), n, F.lit("&2\\\\3&4\\end{bmatrix}"))).when(k == 3, F.concat(F.lit("(0.0, "), n, F.lit("]"))).otherwise(n)
    return rounded(_doc(s, d), "doc_id", score=S.as_udf(S.answer_match)(F.concat("text", said), truth))


@put("score_geometry", f"SELECT doc_id, {r6('CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END', 'score')} FROM documents")
def geometry(s: SparkSession, d: str) -> DataFrame:
    """Right in form and answer; in form only; in the answer only."""
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    said = F.when(k == 0, F.concat(F.lit("<think>so</think> it is \\boxed{"), n, F.lit("}"))).when(k == 1, F.lit("<think>so</think> it is \\boxed{-1}")).otherwise(F.concat(F.lit("\\boxed{"), n, F.lit("}")))
    return rounded(_doc(s, d), "doc_id", score=S.as_udf(S.geo3k)(said, n))


@put("score_strict_box", "SELECT doc_id, doc_id % 2 = 0 AS acc, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '0.5' END AS pred FROM documents")
def strict_box(s: SparkSession, d: str) -> DataFrame:
    """As it is written, or not at all; boxes further up than the last 100 characters do not count."""
    n = F.col("doc_id").cast("string")
    said = F.concat(F.lit("\\boxed{9}"), F.repeat(F.lit("x"), F.lit(120)), F.lit("\\boxed{"), F.when(F.col("doc_id") % 2 == 0, n).otherwise("0.5"), F.lit("}"))
    x = _doc(s, d).withColumn("r", S.strict_box(said, F.when(F.col("doc_id") % 2 == 0, n).otherwise("1/2")))
    return x.select("doc_id", "r.acc", "r.pred")


@put("score_code", f"SELECT doc_id, {r6('CASE WHEN doc_id % 4 = 0 THEN 0 ELSE (10 - doc_id % 4) / CAST(10 AS DOUBLE) END', 'score')}, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'f(' || doc_id || ')' END AS code FROM documents")
def code(s: SparkSession, d: str) -> DataFrame:
    """Shares of the first ten tests; no fenced block, no code."""
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.lit("no code")).otherwise(F.concat(F.lit("so\n```python\nf("), F.col("doc_id").cast("string"), F.lit(")```")))
    results = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: i >= k)
    return rounded(_doc(s, d), "doc_id", S.fenced_code(said).alias("code"), score=S.code_score(said, results))


@put("score_tools", f"SELECT doc_id, {r6('CASE doc_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE -3 END', 'score')} FROM documents")
def tools(s: SparkSession, d: str) -> DataFrame:
    """A call as it should be; with another value; without the tags."""
    call = lambda v: F.concat(F.lit('<think>so</think>\n<tool_call>\n{"name": "f", "parameters": {"x": '), v, F.lit("}}\n</tool_call>"))
    k, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    said = F.when(k == 0, call(n)).when(k == 1, call(F.lit("-1"))).otherwise(F.lit("I would call f"))
    return rounded(_doc(s, d), "doc_id", score=S.as_udf(lambda a, b: S.tool_reward(a, b)["score"])(said, call(n)))


@put("score_multisets", "SELECT c_custkey, " + r6("CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE CAST(1 AS DOUBLE) / 3 END", "score") + " FROM customer")
def multisets(s: SparkSession, d: str) -> DataFrame:
    """Elements in common, over those of either."""
    score = S.as_udf(lambda a, b: S.overlap_score(json.loads(a), json.loads(b)))
    return rounded(table(s, d, "customer"), "c_custkey", score=score(F.lit("[1, 2]"), F.when(F.col("c_custkey") % 2 == 0, "[1, 2]").otherwise("[2, 3]")))


_SOURCES = ["openai/gsm8k", "math_dapo_reasoning", "aime2024", "numina_olympiads", "taco", "searchR1_musique", "lighteval/MATH", "hiyouga/geometry3k"]


@put("score_by_source", f"SELECT doc_id, {_SOURCES}[doc_id % 8 + 1] AS source, {r6('CASE doc_id % 8 WHEN 7 THEN CAST(0.9 AS DOUBLE) WHEN 4 THEN CAST(0.5 AS DOUBLE) ELSE 1 END', 'score')} FROM documents")
def by_source(s: SparkSession, d: str) -> DataFrame:
    """Every family of sources, each row by its own scorer."""
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("doc_id") % 8 + 1).cast("int"))
    truth = F.when(F.col("doc_id") % 8 == 4, "[true, false]").otherwise("12")
    said = F.lit("```\nx\n``` #### 12 <answer>12</answer> \\boxed{12}\nAnswer: 12")
    x = _doc(s, d).withColumn("source", source)
    return rounded(x, "doc_id", "source", score=S.route(F.col("source"), F.concat("text", F.lit("\n"), said), truth))


@put("score_null_texts", f"SELECT doc_id, {r6('CASE WHEN text IS NULL THEN 0 ELSE 1 END', 'score')} FROM documents")
def null_texts(s: SparkSession, d: str) -> DataFrame:
    """Null texts score as empty ones."""
    x = table(s, d, "documents")
    return rounded(x, "doc_id", score=S.route(F.lit("openai/gsm8k"), F.concat("text", F.lit(" #### 12")), F.lit("12"), ["openai/gsm8k"]))


@put("score_managers", f"{VIEWS} SELECT seq_id, {r6('CASE WHEN length > 0 THEN score + least(-(length - CAST(4 AS DOUBLE)) / 3 * CAST(0.5 AS DOUBLE), 0) ELSE 0 END', 'total')}, length > 4 AS overlong FROM sc")
def managers(s: SparkSession, d: str) -> DataFrame:
    """Scores at the last token, less what overlong responses pay."""
    x = X.MANAGERS["dapo"](scored(s, d).withColumnRenamed("length", "response_length"), 16, 7, 3, 0.5)
    return rounded(x, "seq_id", "overlong", total=F.aggregate("token_level_scores", F.lit(0.0), lambda a, v: a + v))


@put("score_last_outputs", "SELECT l_orderkey AS sample_id, max(l_linenumber) AS turn FROM lineitem GROUP BY 1")
def last_outputs(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("turn")).distinct()
    return X.last_outputs(rows)


# streams
def split_events(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream over many files, dealt by a hash, one file in a micro-batch."""
    path = folder(s, "events")
    table(s, d, "events").repartition(6, "event_type", F.col("event_id") % 5).write.parquet(path)
    return E.read_events(s, path)


@put("stream_queue_files", "SELECT user_id, CAST(least(count(*), 32) AS BIGINT) AS size, count(*) AS produced, CAST(greatest(count(*) - 32, 0) AS BIGINT) AS dropped FROM events GROUP BY user_id")
def queue_files(s: SparkSession, d: str) -> DataFrame:
    """Bounded queues over many micro-batches: users that a late one does not have keep what they had."""
    out = E.run_to_table(Q.queue_counts(split_events(s, d), "user_id", "event_id", 32), folder(s, "stream"), "update", ["user_id"])
    return out.select("user_id", "size", "produced", "dropped")


@put("stream_batches_files", "SELECT user_id, CAST(count(*) // 16 AS BIGINT) AS batches, CAST(count(*) // 16 * 16 AS BIGINT) AS items FROM events GROUP BY user_id HAVING count(*) >= 16")
def batches_files(s: SparkSession, d: str) -> DataFrame:
    out = E.run_to_table(Q.count_batches(split_events(s, d), "user_id", "event_id", 16), folder(s, "stream"), "append")
    return out.groupBy("user_id").agg(F.countDistinct("batch").alias("batches"), F.countDistinct("event_id").alias("items"))


@put("stream_replay_state", "WITH e AS (SELECT user_id, event_id, event_id % 101 AS step, CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'success' ELSE 'failure' END AS status, event_id % 7 = 0 AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events), s AS (SELECT * FROM e WHERE k = 1 AND NOT gone) SELECT user_id, step, status FROM s WHERE status = 'success' AND step NOT IN (SELECT step FROM s WHERE status = 'running')")
def replay_state(s: SparkSession, d: str) -> DataFrame:
    """The replay buffer as state over a stream of tags and removals, in whatever order files come."""
    k = F.col("event_id") % 3
    status = F.when(k == 0, "running").when(k == 1, "success").otherwise("failure")
    tags = split_events(s, d).select(F.col("event_id").alias("at"), F.lit("train").alias("partition_id"), F.col("user_id").alias("key"), F.when(F.col("event_id") % 7 == 0, "remove").otherwise("put").alias("op"), status.alias("status"), (F.col("event_id") % 101).alias("step"))
    held = E.run_to_table(Q.replay_stream(tags), folder(s, "stream"), "update", ["partition_id", "key"])
    return Q.ready(held.where("not removed")).select(F.col("key").alias("user_id"), "step", "status")


@put("stream_once", "SELECT event_id, min(user_id) AS user_id FROM events GROUP BY event_id")
def once(s: SparkSession, d: str) -> DataFrame:
    return E.run_to_table(E.once(stream(s, d).select("event_id", "user_id", "ts"), ["event_id"]), folder(s, "stream")).select("event_id", "user_id")


@put("stream_sample_ids", f"{B} SELECT 'sample_' || e || '_' || (e * n + row_idx) AS sample_id, key FROM b, n, (SELECT unnest(range(4)) AS e) WHERE e * n + row_idx < n * 5 // 2")
def sample_ids(s: SparkSession, d: str) -> DataFrame:
    """Two epochs and a half of prompts."""
    b = batch(s, d)
    n = len(b)
    return Q.sample_ids(b.rows, n * 5 // 2, n).select("sample_id", "key")


@put("stream_assembled", f"{_LEN}, r AS (SELECT *, row_number() OVER (ORDER BY row_idx) - 1 AS k, count(*) OVER () AS n FROM ln) SELECT k // 64 AS batch, count(*) AS n, CAST(sum(seqlen) AS BIGINT) AS tokens, CAST(16 AS BIGINT) AS least, CAST(16 AS BIGINT) AS most FROM r WHERE k // 64 < n // 64 GROUP BY 1")
def assembled(s: SparkSession, d: str) -> DataFrame:
    """Samples in batches of 64, each balanced over 4 ranks of as many rows."""
    rows = Q.assembled(lengths(s, d).withColumnRenamed("row_idx", "sample"), 64, 4)
    per = rows.groupBy("batch", "part").agg(F.count("*").alias("n"), F.sum("seqlen").alias("t"))
    return per.groupBy("batch").agg(F.sum("n").alias("n"), F.sum("t").cast("long").alias("tokens"), F.min("n").alias("least"), F.max("n").alias("most"))
