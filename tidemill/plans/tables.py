"""Queries of the table algebra, of sharing out, of texts, scores and streams, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.draws import word_sql
from tidemill.functions import scoring as S
from tidemill.functions import text as T
from tidemill.operators import balance as L
from tidemill.operators.batch import ROW, Batch, concat, numbered
from tidemill.plans.advantages import r6, rounded
from tidemill.plans.views import VIEWS, scored, table
from tidemill.session import shared_folder
from tidemill.sources import tables as R
from tidemill.streaming import events as E
from tidemill.streaming import samples as Q

QUERIES, SQL = {}, {}


def put(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def batch(spark: SparkSession, d: str) -> Batch:
    """Orders by key: row_idx, key, cust, status."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))
    return Batch(numbered(o, "key"))


B = "WITH b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey AS key, o_custkey AS cust, o_orderstatus AS status FROM orders), n AS (SELECT count(*) AS n FROM orders)"
COLS = (ROW, "key", "cust", "status")


def same(b: Batch | DataFrame, *more: str) -> DataFrame:
    rows = b.rows if isinstance(b, Batch) else b
    return rows.select(*COLS, *(F.col(c).cast("long").alias(c) for c in more))


put("tbl_number", f"{B} SELECT * FROM b")(lambda s, d: same(batch(s, d)))
put("tbl_repeat_interleave", f"{B} SELECT row_idx * 3 + k AS row_idx, key, cust, status FROM b, (SELECT unnest(range(3)) AS k)")(lambda s, d: same(batch(s, d).repeat(3)))
put("tbl_repeat_tile", f"{B} SELECT row_idx + k * n AS row_idx, key, cust, status FROM b, n, (SELECT unnest(range(3)) AS k)")(lambda s, d: same(batch(s, d).repeat(3, interleave=False)))


@put("tbl_repeat_each", f"{B}, e AS (SELECT *, sum(cust % 3) OVER (ORDER BY row_idx) - cust % 3 AS s FROM b) SELECT CAST(s + k AS BIGINT) AS row_idx, key, cust, status FROM (SELECT *, unnest(range(cust % 3)) AS k FROM e)")
def repeat_each(s: SparkSession, d: str) -> DataFrame:
    b = batch(s, d)
    return same(Batch(b.rows.withColumn("times", F.col("cust") % 3)).repeat_each("times"))


put("tbl_slice", f"{B} SELECT (n - 1 - row_idx) // 3 AS row_idx, key, cust, status FROM b, n WHERE (n - 1 - row_idx) % 3 = 0 AND row_idx > 10")(lambda s, d: same(batch(s, d).slice(None, 10, -3)))
put("tbl_chunk", f"{B} SELECT *, row_idx * 7 // n AS chunk FROM b, n".replace("SELECT *,", "SELECT row_idx, key, cust, status,"))(lambda s, d: same(batch(s, d).chunk_ids(7, even=False), "chunk"))
put("tbl_split", f"{B} SELECT *, row_idx // 64 AS piece FROM b")(lambda s, d: same(batch(s, d).split_ids(64), "piece"))
put("tbl_pad", f"{B} SELECT * FROM b UNION ALL SELECT row_idx + k * n, key, cust, status FROM b, n, (SELECT unnest(range(1, 4096)) AS k) WHERE k * n < (n + 4095) // 4096 * 4096 AND row_idx + k * n < (n + 4095) // 4096 * 4096")(lambda s, d: same(batch(s, d).pad_to(4096)[0]))
put("tbl_padding", f"{B} SELECT * FROM b UNION ALL SELECT n + k, key, cust, status FROM b, n, (SELECT unnest(range(5)) AS k) WHERE row_idx = n - 1")(lambda s, d: same(batch(s, d).padding(5)))
put("tbl_reorder", f"{B} SELECT n - 1 - row_idx AS row_idx, key, cust, status FROM b, n")(lambda s, d: same(reverse(batch(s, d))))


def reverse(b: Batch) -> Batch:
    n = len(b)
    return b.reorder(b.rows.select(ROW, (n - 1 - F.col(ROW)).alias("new")), ROW, "new")


@put("tbl_union", f"{B} SELECT row_idx, key, cust, status, key * 2 AS double_key FROM b")
def union(s: SparkSession, d: str) -> DataFrame:
    b = batch(s, d)
    other = Batch(b.rows.select(ROW, "key", (F.col("key") * 2).alias("double_key")))
    return same(b.union(other), "double_key")


@put("tbl_concat", f"{B} SELECT * FROM b UNION ALL SELECT row_idx + n, key, cust, status FROM b, n")
def concatenated(s: SparkSession, d: str) -> DataFrame:
    b = batch(s, d)
    return same(concat([b, b]))


@put("tbl_fold_sums", f"{B} SELECT row_idx // 5 AS row_idx, CAST(count(*) AS BIGINT) AS n, CAST(sum(key) AS BIGINT) AS keys, CAST(max(key) FILTER (WHERE row_idx % 5 = 4) AS BIGINT) AS last_key FROM b GROUP BY 1")
def fold(s: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("key", F.lit(0).cast("long"), lambda a, v: a + v)
    return batch(s, d).fold(5).rows.select(ROW, F.size("key").cast("long").alias("n"), total.alias("keys"), F.element_at("key", -1).alias("last_key"))


@put("tbl_unfold", "SELECT (dense_rank() OVER (ORDER BY vec_id) - 1) * 4 + k AS row_idx, vec_id, CAST(label AS BIGINT) AS label, " + r6("list_sum(list_transform(embedding[k * 16 + 1 : k * 16 + 16], lambda v: CAST(v AS DOUBLE)))", "part_sum") + " FROM embeddings, (SELECT unnest(range(4)) AS k)")
def unfold(s: SparkSession, d: str) -> DataFrame:
    b = Batch(numbered(table(s, d, "embeddings").select("vec_id", "label", "embedding"), "vec_id")).unfold(4, ["embedding"])
    return rounded(b.rows, ROW, "vec_id", F.col("label").cast("long").alias("label"), part_sum=F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v))


put("tbl_mini_batches", f"{B}, o AS (SELECT b.*, e, row_number() OVER (PARTITION BY e ORDER BY {word_sql('row_idx', 'e', 1)}, row_idx) - 1 AS k FROM b, (SELECT unnest([0, 1]) AS e)) SELECT row_idx, key, cust, status, CAST(e AS INTEGER) AS epoch, CAST(k // 5 AS INTEGER) AS mini_batch FROM o")(lambda s, d: same(batch(s, d).mini_batches(5, 2, seed=1), "epoch", "mini_batch"))


@put("src_loader", f"{B} SELECT row_idx, key, cust, status, row_idx // 128 AS batch_id FROM b, n WHERE row_idx // 128 < n // 128")
def loader(s: SparkSession, d: str) -> DataFrame:
    return same(R.batches(batch(s, d).rows, 128), "batch_id")


@put("src_ranked", f"{B} SELECT row_idx, key, cust, status, row_idx % 4 AS rank, row_idx // 4 // 16 AS batch_id FROM b, n WHERE row_idx // 4 // 16 < n // 4 // 16")
def ranked(s: SparkSession, d: str) -> DataFrame:
    return same(R.ranked(batch(s, d).rows, 4, 64), "rank", "batch_id")


@put("src_split", f"{B} SELECT row_idx, key, cust, status, row_idx // (n // 7) AS part FROM b, n WHERE row_idx < n // 7 * 7")
def split(s: SparkSession, d: str) -> DataFrame:
    return same(R.split(batch(s, d).rows, 7), "part")


put("src_sampled", f"{B} SELECT row_idx, key, cust, status FROM b ORDER BY {word_sql(3, 'row_idx')}, row_idx LIMIT 100")(lambda s, d: same(R.sampled(batch(s, d).rows, 100, shuffle=True, seed=3)))


# sharing out
def lengths(s: SparkSession, d: str) -> DataFrame:
    """A step is the orders of a customer's tens digit; seqlen from the number of line items."""
    return scored(s, d).select(F.col("seq_id").alias("row_idx"), "uid", (F.col("uid") % 20).alias("step"), (F.col("n_tokens") * 37 + F.col("seq_id") % 50 + 1).alias("seqlen"))


_LEN = f"{VIEWS}, ln AS (SELECT seq_id AS row_idx, uid, uid % 20 AS step, n_tokens * 37 + seq_id % 50 + 1 AS seqlen FROM sc)"


@put("balance_loads", f"{_LEN} SELECT step, count(*) AS n, CAST(sum(24576 * seqlen + seqlen * seqlen) AS BIGINT) AS work, CAST(4 AS BIGINT) AS parts, true AS even FROM ln GROUP BY step")
def balance_loads(s: SparkSession, d: str) -> DataFrame:
    """Per step: rows and work dealt to 4 parts, whether every part has rows and none has a hundredth more than the mean."""
    rows = lengths(s, d)
    dealt = L.assigned(rows, "step", 4).join(rows, ["step", "row_idx"]).groupBy("step", "part").agg(F.count("*").alias("n"), F.sum(L.workload(F.col("seqlen"))).alias("w"))
    out = dealt.groupBy("step").agg(F.sum("n").alias("n"), F.sum("w").alias("work"), F.count("*").alias("parts"), (F.max("w") <= 1.01 * F.avg("w")).alias("even"))
    return out.select("step", "n", F.col("work").cast("long").alias("work"), "parts", "even")


@put("balance_micro_batches", f"{_LEN} SELECT step, count(*) AS n, CAST(sum(seqlen) AS BIGINT) AS tokens, true AS together FROM ln GROUP BY step")
def balance_micro(s: SparkSession, d: str) -> DataFrame:
    """Per step: rows and tokens in micro-batches that keep a customer's orders together."""
    rows = lengths(s, d)
    dealt = L.micro_assigned(rows, "step", 4096, group="uid").join(rows, ["step", "row_idx"])
    whole = dealt.groupBy("step", "uid").agg(F.countDistinct("micro_batch").alias("k")).groupBy("step").agg((F.max("k") == 1).alias("together"))
    return dealt.groupBy("step").agg(F.count("*").alias("n"), F.sum("seqlen").cast("long").alias("tokens")).join(whole, "step").select("step", "n", "tokens", "together")


put("balance_parts")(lambda s, d: L.assigned(lengths(s, d), "step", 4, group=None))


@put("balance_prefixes", f"{_LEN} SELECT uid, count(*) AS n, CAST(max(seqlen) AS BIGINT) AS prefix_tokens, CAST(max(seqlen) * (count(*) - 1) AS BIGINT) AS saved_tokens FROM ln GROUP BY uid")
def prefixes(s: SparkSession, d: str) -> DataFrame:
    return L.shared_prefixes(lengths(s, d), length="seqlen")


def texts(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table whose null texts are empty ones."""
    return table(s, d, name).withColumn("text", F.coalesce("text", F.lit("")))


# texts
@put("text_truncate_pad", "WITH w AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda t: length(t)) AS l FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)) SELECT doc_id, CAST(list_sum(l[1:16]) AS BIGINT) AS right_sum, CAST(list_sum(CASE WHEN len(l) <= 16 THEN l ELSE l[len(l) - 15 : len(l)] END) AS BIGINT) AS left_sum, CAST(list_sum(CASE WHEN len(l) <= 16 THEN l ELSE list_concat(l[1:8], l[len(l) - 7 : len(l)]) END) AS BIGINT) AS middle_sum, CAST(greatest(16, 16) AS BIGINT) AS width FROM w")
def truncate_pad(s: SparkSession, d: str) -> DataFrame:
    """Word lengths as tokens, cut to 16 on either side or in the middle, and padded."""
    ids = F.transform(F.split("text", " "), F.length)
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y).cast("long")
    docs = texts(s, d, "documents").select("doc_id", ids.alias("ids"))
    return docs.select("doc_id", *(add(T.truncate("ids", 16, how)).alias(f"{how}_sum") for how in ("right", "left", "middle")), F.size(T.fitted("ids", 16, 0, how="right")).cast("long").alias("width"))


@put("text_eos_mask", f"{VIEWS} SELECT seq_id, pos, CAST(CASE WHEN coalesce(sum(CASE WHEN mask = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS BIGINT) AS m FROM tok")
def eos_mask(s: SparkSession, d: str) -> DataFrame:
    """Valid up to the first returned line item."""
    from tidemill.functions.masked import response_mask
    from tidemill.plans.views import tokens

    return response_mask(tokens(s, d), "mask", 0).select("seq_id", "pos", F.col("response_mask").cast("long").alias("m"))


@put("text_score_placement", f"{VIEWS} SELECT seq_id, CAST(length AS BIGINT) AS length, {r6('CASE WHEN length > 0 THEN score ELSE 0 END', 'total')} FROM sc")
def score_placement(s: SparkSession, d: str) -> DataFrame:
    x = scored(s, d).withColumn("p", T.placed("score", "length", 16))
    return rounded(x, "seq_id", "length", total=F.aggregate("p", F.lit(0.0), lambda a, v: a + v))


@put("text_conversations", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def conversations(s: SparkSession, d: str) -> DataFrame:
    c = T.conversations(table(s, d, "conversations"))
    chars = F.aggregate("messages", F.lit(0), lambda a, m: a + F.coalesce(F.length(m["content"]), F.lit(0)))
    return c.select("conv_id", F.size("messages").cast("long").alias("n"), F.array_join("messages.role", ",").alias("roles"), chars.cast("long").alias("chars"))


@put("text_sft_mask", "SELECT conv_id, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n, CAST(coalesce(sum(greatest(length(text) - 1, 0)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_tokens FROM conversations GROUP BY conv_id")
def sft_mask(s: SparkSession, d: str) -> DataFrame:
    """A character is a token; loss on what assistants say but for the first one."""
    one = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: i)
    ids = F.when(F.length("text") > 0, one).otherwise(F.array().cast("array<int>"))
    x = T.sft_rows(texts(s, d, "conversations"), ids, lead=1)
    return x.select("conv_id", F.size("input_ids").cast("long").alias("n"), F.aggregate("loss_mask", F.lit(0), lambda a, m: a + m).cast("long").alias("loss_tokens"))


@put("text_preferences", "SELECT doc_id, md5(lang || source || x) AS text_md5, x = 'yes' AS is_chosen FROM documents, (SELECT unnest(['yes', 'no']) AS x)")
def preferences(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "documents").select("doc_id", F.concat("lang", "source").alias("prompt"), F.lit("yes").alias("chosen"), F.lit("no").alias("rejected"))
    return T.preference_rows(p).select("doc_id", F.md5("text").alias("text_md5"), "is_chosen")


@put("text_numbered_runs", "WITH r AS (SELECT event_id, event_type, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events) SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, island ORDER BY event_id) - 1 AS n FROM r")
def numbered_runs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", "event_type")
    return T.numbered_runs(e, "event_type", "event_id", "n").select("event_id", "event_type", F.col("n").cast("long").alias("n"))


@put("text_tool_calls", "SELECT c_custkey, CAST(1 + c_custkey % 2 AS BIGINT) AS n, 'order' AS first_name, CAST(c_nationkey AS VARCHAR) AS nation, 'I will. ' AS content FROM customer")
def tool_calls(s: SparkSession, d: str) -> DataFrame:
    """Calls written into a text, and read again; one of them is broken."""
    call = lambda n: F.concat(F.lit('<tool_call>\n{"name": "order", "arguments": {"nation": '), n, F.lit("}}\n</tool_call>"))
    n = F.col("c_nationkey").cast("string")
    text = F.concat(F.lit("I will. "), call(n), F.when(F.col("c_custkey") % 2 == 1, call(n)).otherwise(""), F.lit("<tool_call>{oops</tool_call>"))
    c = table(s, d, "customer").select("c_custkey", text.alias("t")).withColumn("calls", T.hermes_calls(F.col("t")))
    return c.select("c_custkey", F.size("calls").cast("long").alias("n"), F.col("calls")[0]["name"].alias("first_name"), F.get_json_object(F.col("calls")[0]["arguments"], "$.nation").alias("nation"), T.without_calls(F.col("t")).alias("content"))


@put("text_offsets", f"{_LEN} SELECT row_idx, CAST(sum(seqlen) OVER (ORDER BY row_idx) - seqlen AS BIGINT) AS first, CAST(sum(seqlen) OVER (ORDER BY row_idx) AS BIGINT) AS past FROM ln")
def running_offsets(s: SparkSession, d: str) -> DataFrame:
    return T.offsets(lengths(s, d), "seqlen", "row_idx").select("row_idx", F.col("start").cast("long").alias("first"), F.col("end").cast("long").alias("past"))


# scores
_D = "(SELECT * REPLACE (coalesce(text, '') AS text) FROM documents)"


@put("score_gsm8k", f"SELECT doc_id, {r6('CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END', 'score')} FROM {_D}")
def score_gsm8k(s: SparkSession, d: str) -> DataFrame:
    """Right, wrong and missing answers after documents."""
    x = texts(s, d, "documents")
    n = F.col("n_chars").cast("string")
    end = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n#### "), F.format_number("n_chars", 0))).when(F.col("doc_id") % 3 == 1, F.lit("\n#### -77")).otherwise("")
    plain = F.regexp_replace("text", "#### ", "")
    return rounded(x, "doc_id", score=S.gsm8k(F.concat(plain, end), n, format_score=0.1))


@put("score_qa", f"SELECT doc_id, {r6('CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END', 'em')}, {r6('CASE WHEN doc_id % 4 <= 1 THEN 1 ELSE 0 END', 'sub_em')} FROM {_D}")
def score_qa(s: SparkSession, d: str) -> DataFrame:
    """Answers that are right but for case, articles and points; right with more words; wrong; missing."""
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(F.lit("<answer> The Code of "), F.col("source"), F.lit(".</answer>"))).when(k == 1, F.concat(F.lit("<answer>it is code of "), F.col("source"), F.lit(" indeed</answer>"))).when(k == 2, F.lit("<answer>none</answer>")).otherwise("no answer")
    golden = F.array(F.lit("other one"), F.concat(F.lit("code of "), F.col("source")))
    x = texts(s, d, "documents").withColumns({"said": F.concat(F.lit("<answer>first</answer> "), said), "golden": golden})
    said = F.when(k == 3, F.lit("no answer")).otherwise(F.col("said"))
    return rounded(x, "doc_id", em=S.qa_score(said, F.col("golden")), sub_em=S.qa_score(said, F.col("golden"), sub=True))


@put("score_answer_line", f"SELECT doc_id, doc_id % 2 = 0 AS acc, {r6('CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END', 'score')}, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE 'nothing' END AS pred FROM {_D}")
def score_answer_line(s: SparkSession, d: str) -> DataFrame:
    x = texts(s, d, "documents")
    n = F.col("n_chars").cast("string")
    said = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nanswer : $x = "), n, F.lit(" \\text{m}$\n"))).otherwise("\nAnswer: nothing"))
    return rounded(x.withColumn("r", S.answer_line(said, n)), "doc_id", F.col("r.acc").alias("acc"), F.col("r.pred").alias("pred"), score=F.col("r.score"))


@put("score_boxed", f"SELECT doc_id, {r6('CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END', 'score')} FROM {_D}")
def score_boxed(s: SparkSession, d: str) -> DataFrame:
    x = texts(s, d, "documents")
    said = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit(" \\boxed{\\dfrac12}")).otherwise(" \\boxed{2}"))
    return rounded(x, "doc_id", score=S.as_udf(S.math_score)(said, F.lit("1/2")))


@put("score_routed", f"SELECT doc_id, {r6('CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END', 'score')} FROM {_D}")
def score_routed(s: SparkSession, d: str) -> DataFrame:
    """By the row's source, whichever scorer that is."""
    x = texts(s, d, "documents")
    source = F.when(F.col("doc_id") % 3 == 0, "openai/gsm8k").otherwise("searchR1_nq")
    right = F.when(F.col("doc_id") % 2 == 0, F.lit("12")).otherwise("13")
    said = F.concat(F.lit("x #### "), right, F.lit(" <answer>"), right, F.lit("</answer>"))
    return rounded(x, "doc_id", score=S.route(source, said, F.lit("12"), ["openai/gsm8k", "searchR1_nq"]))


@put("score_overlong", f"{VIEWS} SELECT seq_id, {r6('least(-(length - CAST(4 AS DOUBLE)) / 3 * CAST(0.5 AS DOUBLE), 0)', 'penalty')} FROM sc")
def score_overlong(s: SparkSession, d: str) -> DataFrame:
    return rounded(scored(s, d), "seq_id", penalty=S.overlong_penalty(F.col("length"), 7, 3, 0.5))


# streams
def folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"


def stream(s: SparkSession, d: str) -> DataFrame:
    return E.read_events(s, f"{d}/events.parquet")


_NTZ = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@put("stream_tumbling", f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, {r6('sum(value)', 'total')} FROM events GROUP BY ALL")
def tumbling(s: SparkSession, d: str) -> DataFrame:
    out = E.run_to_table(E.windowed(stream(s, d), "1 hour", by=["event_type"]), folder(s), "complete")
    return rounded(out, _NTZ("window_start").alias("window_start"), "event_type", "n", total="total")


@put("stream_sliding", "WITH e AS (SELECT ts, unnest([0, 1]) AS k FROM events) SELECT strftime(time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes', '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM e GROUP BY ALL")
def sliding(s: SparkSession, d: str) -> DataFrame:
    out = E.run_to_table(E.windowed(stream(s, d), "1 hour", "30 minutes"), folder(s), "complete")
    return out.select(_NTZ("window_start").alias("window_start"), "n")


@put("stream_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM g GROUP BY user_id, k")
def sessions(s: SparkSession, d: str) -> DataFrame:
    out = E.run_to_table(E.sessions(stream(s, d), "30 minutes", "user_id"), folder(s), "complete")
    return out.select("user_id", _NTZ("session_start").alias("session_start"), "n")


@put("stream_count_batches", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, k // 16 AS batch, event_id FROM e WHERE k < n - n % 16")
def count_batches(s: SparkSession, d: str) -> DataFrame:
    return E.run_to_table(Q.count_batches(stream(s, d), "user_id", "event_id", 16), folder(s), "append")


@put("stream_queue", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, CAST(least(any_value(n), 32) AS BIGINT) AS size, any_value(n) AS produced, CAST(greatest(any_value(n) - 32, 0) AS BIGINT) AS dropped, min(event_id) AS oldest, max(event_id) AS newest FROM e WHERE k <= 32 GROUP BY user_id")
def queue(s: SparkSession, d: str) -> DataFrame:
    """The bounded queue of each user's events, as the stream's last micro-batch leaves it."""
    out = E.run_to_table(Q.queue_counts(stream(s, d), "user_id", "event_id", 32), folder(s), "update", ["user_id"])
    return out.select("user_id", "size", "produced", "dropped", "oldest", "newest")


@put("stream_replay", "WITH e AS (SELECT user_id, event_id, event_id % 101 AS step, CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'success' ELSE 'failure' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events), s AS (SELECT * FROM e WHERE k = 1) SELECT user_id, step, status FROM s WHERE status = 'success' AND step NOT IN (SELECT step FROM s WHERE status = 'running')")
def replay(s: SparkSession, d: str) -> DataFrame:
    """Each user's last event tags it; users of steps with nobody running are ready."""
    k = F.col("event_id") % 3
    status = F.when(k == 0, "running").when(k == 1, "success").otherwise("failure")
    e = table(s, d, "events").select(F.col("event_id").alias("at"), F.lit("train").alias("partition_id"), F.col("user_id").alias("key"), F.lit("put").alias("op"), status.alias("status"), (F.col("event_id") % 101).alias("step"))
    return Q.replay_sample(e).select(F.col("key").alias("user_id"), "step", "status")


@put("stream_staleness", "SELECT greatest(4 - event_id % 6, 0) AS behind, count(*) AS n FROM events GROUP BY ALL")
def staleness(s: SparkSession, d: str) -> DataFrame:
    e = Q.stale(table(s, d, "events"), F.col("event_id") % 6, F.lit(4))
    return e.groupBy("behind").agg(F.count("*").alias("n"))
