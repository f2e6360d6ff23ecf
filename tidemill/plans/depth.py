"""Queries of operators that are built from several steps: symbolic scores, sources of their own, state by element, shared prefixes, deals of large steps, resampled metrics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import scoring as S
from tidemill.functions import text as T
from tidemill.functions.chat import TEMPLATES, decoded, sft_tokens
from tidemill.functions.extensions import Tool, guarded
from tidemill.functions.tables import called, rows_function, sessions
from tidemill.operators import balance as L
from tidemill.operators.batch import Batch, concat, numbered
from tidemill.operators.deal import dealt, micro_dealt
from tidemill.operators.metrics import metric_cube
from tidemill.operators.objects import alike, collated, from_records, kind_of, same, to_records, united
from tidemill.operators.prefixes import prefix_forest, prefix_savings
from tidemill.plans.advantages import r6, rounded
from tidemill.plans.breadth import folder
from tidemill.plans.tables import _LEN, lengths
from tidemill.plans.views import VIEWS, scored, table
from tidemill.sources.datasets import read_dataset
from tidemill.streaming.events import read_events, run_to_table
from tidemill.streaming.sinks import SINKS, Observed, observed_queues, queue_stats, read_sink, write_once
from tidemill.streaming.state import full_batches, queues, released

QUERIES, SQL = {}, {}


def put(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# symbolic scores
def _forms(kind: Column, a: Column, b: Column, x: Column) -> tuple[Column, Column]:
    """For each kind a formula in two forms: a, b: whole numbers as text; x: the unknown."""
    f = lambda pattern, *args: F.format_string(pattern, *args)
    square = (f("(%s%s + %sy)^2", a, x, b), f("%s^2%s^2 + 2\\cdot %s\\cdot %s %s y + %s^2 y^2", a, x, a, b, x, b))
    partial = (f("\\frac{1}{%s-%s} - \\frac{1}{%s+%s}", x, a, x, b), f("\\frac{%s+%s}{(%s-%s)(%s+%s)}", a, b, x, a, x, b))
    root = (f("\\sqrt{%s^2\\cdot %s}%s", a, b, x), f("%s\\sqrt{%s}\\cdot %s", a, b, x))
    circle = (f("%s\\sin^2 %s + %s\\cos^2 %s + %s", a, x, a, x, b), f("%s+%s", a, b))
    powers = (f("%s^{%s+%s}", x, a, b), f("%s^{%s}%s^{%s}", x, a, x, b))
    matrix = (f("\\begin{pmatrix}%s%s & 1\\\\ %s & (%s+1)^2\\end{pmatrix}", a, x, b, x), f("\\begin{bmatrix}%s%s & 1\\\\ %s & %s^2+2%s+1\\end{bmatrix}", x, F.concat(F.lit("\\cdot "), a), b, x, x))
    forms = (square, partial, root, circle, powers, matrix)
    pick = lambda side: F.element_at(F.array(*(v[side] for v in forms)), kind + 1)
    return pick(0), pick(1)


@put("score_symbolic", """SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM documents""")
def symbolic(s: SparkSession, d: str) -> DataFrame:
    """Expanded against factored formulas with unknowns, whose numbers come from the documents' ids and lengths, behind the documents'
    texts; of every third length the answer is of other numbers."""
    docs = table(s, d, "documents")
    kind, a, b = (F.col("doc_id") % 6).cast("int"), F.col("n_chars") % 89 + 2, F.col("doc_id") % 97 + 3
    wrong = F.when(F.col("n_chars") % 3 == 0, 1).otherwise(0)
    x = F.element_at(F.array(*map(F.lit, ("x", "t", "\\alpha", "n_1"))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = lambda c: c.cast("string")
    said, _ = _forms(kind, text(a + wrong), text(b), x)
    _, truth = _forms(kind, text(a), text(b), x)
    return docs.select("doc_id", S.as_udf(S.answer_match)(F.concat(F.coalesce("text", F.lit("")), F.lit(" \\boxed{"), said, F.lit("}")), truth).alias("score"))


def _strict(text: str, truth: str) -> float:
    """As answer_match, of answers that say so; others are errors."""
    if "Answer:" not in text:
        raise LookupError("no answer")
    return S.answer_match(text.rsplit("Answer:", 1)[1], truth)


@put("score_guarded", "SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN doc_id % 4 = 0 THEN 'LookupError: no answer' END AS error FROM documents")
def guarded_scores(s: SparkSession, d: str) -> DataFrame:
    """A scorer that fails on some rows: they score 0 and say why. Right answers are written in two ways."""
    docs = table(s, d, "documents")
    n = F.col("n_chars").cast("string")
    answer = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("2x+"), n)).when(F.col("doc_id") % 4 == 2, F.concat(n, F.lit("+x+x"))).otherwise(F.concat(F.lit("2x-1-"), n))
    said = F.concat(F.translate(F.coalesce("text", F.lit("")), ":", ";"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("\nAnswer: "), answer)).otherwise(F.lit("")))
    return docs.select("doc_id", guarded(_strict, seconds=30)(said, F.concat(F.lit("2x+"), n)).alias("r")).select("doc_id", "r.score", "r.error")


# datasets
_TURNS = "conv_id bigint, turn bigint, role string, text string"


@put("src_dataset", "SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(conv_id) AS BIGINT) AS ids FROM conversations WHERE role <> 'user' AND turn >= 1 AND turn < 6 AND text IS NOT NULL GROUP BY role")
def dataset(s: SparkSession, d: str) -> DataFrame:
    """The conversations through the rows dataset, in parts, filters pushed down to row groups."""
    turns = read_dataset(s, path=f"{d}/conversations.parquet", schema=_TURNS, splitBytes=65536)
    kept = turns.where("role <> 'user' AND turn >= 1 AND turn < 6 AND text IS NOT NULL")
    return kept.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("conv_id").alias("ids"))


@put("src_dataset_lines", "SELECT conv_id, turn, role, text FROM conversations WHERE turn IN (0, 2)")
def dataset_lines(s: SparkSession, d: str) -> DataFrame:
    """The same as JSON lines, written and read in parts that cut lines anywhere."""
    path = folder(s, "lines")
    table(s, d, "conversations").repartitionByRange(3, "conv_id", "turn").write.json(path)
    return read_dataset(s, path=path, schema=_TURNS, splitBytes=4001).where("turn IN (0, 2)")


@put("src_dataset_stream", "SELECT turn, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(count(DISTINCT conv_id) AS BIGINT) AS convs FROM conversations GROUP BY turn")
def dataset_stream(s: SparkSession, d: str) -> DataFrame:
    """The dataset as a stream: a first run over the files that are there, a second over those that came since, each file once."""
    path, out = folder(s, "rollouts"), folder(s, "stream")
    turns = table(s, d, "conversations")
    for k in range(3):
        turns.where(F.col("conv_id") % 3 == k).write.json(f"{path}/step={k:09d}")
        if k != 1:
            found = run_to_table(read_dataset(s, path=path, schema=_TURNS, stream=True, splitBytes=65536), out)
    return found.groupBy("turn").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("conv_id").alias("convs"))


# state by element
def tag_stream(s: SparkSession, d: str) -> DataFrame:
    """Tags of events as a stream of five files by time: an event runs, then ends after up to half an hour, unless it is one that never does; some are removed."""
    e = table(s, d, "events").select("event_id", F.col("event_type").alias("partition_id"), F.col("ts").cast("timestamp").alias("ts"))
    e = e.withColumn("step", F.floor(F.unix_seconds("ts") / 86400))
    after = lambda minutes: F.col("ts") + F.make_dt_interval(mins=minutes)
    ends = (F.col("event_id") % 30).cast("int")
    tag = lambda at, status: F.struct(at.alias("at"), status.alias("status"))
    end = F.when(F.col("event_id") % 997 != 5, tag(after(ends), F.when(F.col("event_id") % 11 == 0, "failure").otherwise("success")))
    gone = F.when((F.col("event_id") % 997 != 5) & (F.col("event_id") % 13 == 0), tag(after(ends + 5), F.lit("removed")))
    tags = e.select("partition_id", "step", F.col("event_id").alias("key"), F.explode(F.filter(F.array(tag(F.col("ts"), F.lit("running")), end, gone), lambda x: x.isNotNull())).alias("t")).select("partition_id", "step", "key", "t.*")
    path, days = folder(s, "tags"), e.agg(F.min("step"), F.max("step")).first()
    for k in range(5):
        low, high = (F.timestamp_seconds(F.lit((days[0] + (days[1] - days[0] + 1) * j // 5) * 86400)) for j in (k, k + 1))
        part = (F.col("at") < high) if k == 0 else (F.col("at") >= low) if k == 4 else (F.col("at") >= low) & (F.col("at") < high)
        tags.where(part).coalesce(1).write.mode("append").parquet(path)
    return s.readStream.schema(tags.schema).option("maxFilesPerTrigger", 1).parquet(path)


_TAGS = """WITH e AS (SELECT event_id, event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step, event_id % 997 = 5 AS stuck, ts + to_minutes(CAST(CASE WHEN event_id % 997 = 5 THEN 0 ELSE event_id % 30 + CASE WHEN event_id % 13 = 0 THEN 5 ELSE 0 END END AS BIGINT)) AS last FROM events),
w AS (SELECT max(last) - INTERVAL 1 HOUR AS w FROM e),
r AS (SELECT event_type, step FROM e, w GROUP BY event_type, step, w HAVING NOT bool_or(stuck) AND max(last) + INTERVAL 6 HOUR <= w)"""


@put("stream_replay_ready", f"{_TAGS} SELECT event_type AS partition_id, step, event_id AS key FROM e JOIN r USING (event_type, step) WHERE event_id % 11 <> 0 AND event_id % 13 <> 0")
def replay_ready(s: SparkSession, d: str) -> DataFrame:
    """What the replay buffer releases as tags come in five micro-batches: steps in which nothing runs and nothing came for six hours."""
    return run_to_table(released(tag_stream(s, d)), folder(s, "stream"))


@put("stream_queue_elements", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, CAST(least(any_value(n), 32) AS BIGINT) AS size, any_value(n) AS produced, CAST(greatest(any_value(n) - 32, 0) AS BIGINT) AS dropped, min(event_id) FILTER (WHERE k > n - 32) AS oldest, max(event_id) AS newest FROM e GROUP BY user_id")
def queue_elements(s: SparkSession, d: str) -> DataFrame:
    """Bounded queues kept place by place, over files that come by id."""
    return run_to_table(queues(id_stream(s, d), "user_id", "event_id", 32), folder(s, "stream"), "update", ["user_id"])


@put("stream_batch_elements", "WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, CAST(k // 16 AS BIGINT) AS batch, event_id FROM e WHERE k < n - n % 16")
def batch_elements(s: SparkSession, d: str) -> DataFrame:
    """Batches of 16 from lists that grow at their end, over files that come by id."""
    return run_to_table(full_batches(id_stream(s, d), "user_id", "event_id", 16), folder(s, "stream"))


def id_stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of four files, by id."""
    path, e = folder(s, "events"), table(s, d, "events")
    low, high = e.agg(F.min("event_id"), F.max("event_id")).first()
    for k in range(4):
        cut = [low + (high + 1 - low) * j // 4 for j in (k, k + 1)]
        e.where((F.col("event_id") >= cut[0]) & (F.col("event_id") < cut[1])).coalesce(1).write.mode("append").parquet(path)
    return read_events(s, path)


# shared prefixes
def histories(s: SparkSession, d: str) -> DataFrame:
    """part, words: for each turn of a conversation the words of all turns up to it; repeated as often as the turn's number is a multiple of 3."""
    c = table(s, d, "conversations").withColumn("own", F.split(F.coalesce("text", F.lit("")), " "))
    upto = F.flatten(F.collect_list("own").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    again = F.explode(F.when(F.col("turn") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return c.select("turn", (F.col("conv_id") % 4).alias("part"), upto.alias("words")).select("part", "words", again.alias("k"))


_HISTORY = """WITH c AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS own FROM conversations),
h AS (SELECT conv_id % 4 AS part, flatten(list(own) OVER (PARTITION BY conv_id ORDER BY turn)) AS words, turn FROM c),
s AS MATERIALIZED (SELECT part, words, count(*) AS n FROM (SELECT part, words FROM h UNION ALL SELECT part, words FROM h WHERE turn % 3 = 0) GROUP BY ALL),
p AS MATERIALIZED (SELECT part, k, md5(array_to_string(words[1:k], ' ')) AS id, words[k + 1] AS next, len(words) = k AS ends, n, md5(array_to_string(words, ' ')) AS seq, len(words) AS length FROM s, unnest(range(1, len(words) + 1)) t(k)),
f AS MATERIALIZED (SELECT part, k, id FROM p GROUP BY ALL HAVING count(DISTINCT CASE WHEN ends THEN NULL ELSE next END) + coalesce(sum(n) FILTER (WHERE ends), 0) >= 2),
q AS (SELECT p.part, p.seq AS id, any_value(p.length) AS length, any_value(p.n) AS n, coalesce(max(f.k), 0) AS parent_length FROM p LEFT JOIN f ON p.part = f.part AND p.k = f.k AND p.id = f.id GROUP BY 1, 2),
g AS (SELECT DISTINCT f.part, f.id, f.k AS length, p.seq FROM f JOIN p ON p.part = f.part AND p.k = f.k AND p.id = f.id),
o AS (SELECT g.part, g.id, g.length, max(f.k) AS parent FROM (SELECT part, id, length, min(seq) AS seq FROM g GROUP BY ALL) g JOIN p ON p.part = g.part AND p.seq = g.seq AND p.k < g.length JOIN f ON f.part = p.part AND f.k = p.k AND f.id = p.id GROUP BY ALL)"""


@put("balance_prefix_forest", f"{_HISTORY} SELECT 'sequence' AS kind, part, id, CAST(n AS BIGINT) AS n, CAST(length AS BIGINT) AS length, CAST(parent_length AS BIGINT) AS parent_length FROM q UNION ALL SELECT 'prefix', f.part, f.id, 0, CAST(f.k AS BIGINT), CAST(coalesce(o.parent, 0) AS BIGINT) FROM f LEFT JOIN o ON f.part = o.part AND f.id = o.id AND f.k = o.length")
def forest(s: SparkSession, d: str) -> DataFrame:
    """The prefixes that conversations' histories share, and what each row has of its own."""
    return prefix_forest(histories(s, d), "words", ["part"]).select("kind", "part", F.md5(F.array_join("tokens", " ")).alias("id"), "n", "length", "parent_length")


@put("balance_prefix_savings", f"{_HISTORY} SELECT s.part, CAST(sum(s.n) AS BIGINT) AS n, CAST(sum(s.n * len(s.words)) AS BIGINT) AS tokens, any_value(t.kept) AS kept, CAST(sum(s.n * len(s.words)) AS BIGINT) - any_value(t.kept) AS saved FROM s JOIN (SELECT part, CAST(count(DISTINCT (k, id)) AS BIGINT) AS kept FROM p GROUP BY part) t USING (part) GROUP BY s.part")
def savings(s: SparkSession, d: str) -> DataFrame:
    """Tokens that are kept when each prefix is kept once: as many as there are different prefixes of any length."""
    return prefix_savings(prefix_forest(histories(s, d), "words", ["part"]), ["part"])


# deals of large steps
def copies(s: SparkSession, d: str, n: int) -> DataFrame:
    """One step of all orders, each n times."""
    rows = lengths(s, d).select("row_idx", "seqlen", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy"))
    return rows.select(F.lit(1).alias("step"), (F.col("row_idx") * n + F.col("copy")).alias("row_idx"), "seqlen")


_WORK = "24576 * seqlen + seqlen * seqlen"


@put("balance_large", f"{_LEN} SELECT CAST(part AS BIGINT) AS part, count(*) AS n, CAST(sum({_WORK}) AS BIGINT) AS work, CAST(sum(seqlen) AS BIGINT) AS tokens FROM ln, range(8) t(part) GROUP BY part")
def balance_large(s: SparkSession, d: str) -> DataFrame:
    """One step of all orders, eight times each, dealt to 8 parts in a tree of buckets: each part gets as many rows and the same work."""
    rows = copies(s, d, 8)
    out = dealt(rows, "step", 8, equal_size=True, bucket=512, fan=8).join(rows, ["step", "row_idx"])
    return out.groupBy("part").agg(F.count("*").alias("n"), F.sum("load").cast("long").alias("work"), F.sum("seqlen").cast("long").alias("tokens"))


@put("balance_halves")
def balance_halves(s: SparkSession, d: str) -> DataFrame:
    """The work of the two parts that largest differencing makes of each step."""
    out = L.assigned(lengths(s, d), "step", 2).join(lengths(s, d), ["step", "row_idx"]).groupBy("step", "part").agg(F.sum(L.workload(F.col("seqlen"))).cast("long").alias("w"))
    return out.groupBy("step").agg(F.max("w").alias("heavy"), F.min("w").alias("light"))


# two parts: the two largest of a list give way to their difference, until one is left
SQL["balance_halves"] = VIEWS.replace("WITH", "WITH RECURSIVE", 1) + f""", ln AS (SELECT uid % 20 AS step, n_tokens * 37 + seq_id % 50 + 1 AS seqlen FROM sc),
t AS (SELECT step, CAST(sum({_WORK}) AS BIGINT) AS total, list_reverse_sort(list(CAST({_WORK} AS BIGINT))) AS l FROM ln GROUP BY step),
r AS (SELECT step, l FROM t UNION ALL SELECT step, list_reverse_sort(list_prepend(l[1] - l[2], l[3:])) FROM r WHERE len(l) > 1)
SELECT step, CAST((total + r.l[1]) // 2 AS BIGINT) AS heavy, CAST((total - r.l[1]) // 2 AS BIGINT) AS light FROM r JOIN t USING (step) WHERE len(r.l) = 1"""


@put("balance_micro_shards", f"{_LEN}, g AS (SELECT uid, sum({_WORK}) AS work, count(*) AS n FROM ln GROUP BY uid), k AS (SELECT CAST(ceil(sum(n) / 256.0) AS BIGINT) AS shards FROM g), o AS (SELECT g.*, row_number() OVER (ORDER BY work DESC, uid) - 1 AS i FROM g), p AS (SELECT o.uid, CASE WHEN (i // shards) % 2 = 0 THEN i % shards ELSE shards - 1 - i % shards END AS shard FROM o, k) SELECT CAST(shard AS BIGINT) AS shard, CAST(least(count(DISTINCT ln.uid), ceil(sum(seqlen) / 4096.0)) AS BIGINT) AS batches, count(*) AS n, CAST(sum(seqlen) AS BIGINT) AS tokens, CAST(count(DISTINCT ln.uid) AS BIGINT) AS pieces FROM ln JOIN p USING (uid) GROUP BY shard")
def micro_shards(s: SparkSession, d: str) -> DataFrame:
    """One step of all orders in shards and micro-batches that keep a customer's orders together: pieces counts a customer for each micro-batch that has one of its rows."""
    rows = lengths(s, d).withColumn("step", F.lit(1))
    out = micro_dealt(rows, "step", 4096, group="uid", bucket=256).join(rows, ["step", "row_idx"])
    return out.groupBy("shard").agg(F.countDistinct("micro_batch").alias("batches"), F.count("*").alias("n"), F.sum("seqlen").cast("long").alias("tokens"), F.countDistinct("micro_batch", "uid").alias("pieces"))


# conversations as tokens
def _said(of: str) -> str:
    return f"md5(coalesce(string_agg({of}, '' ORDER BY turn), ''))"


_TURN = "'<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)"


@put("text_sft_tokens", f"SELECT conv_id, {_said(_TURN)} AS text_md5, md5(coalesce(string_agg(coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS trained_md5, CAST(count(*) AS BIGINT) AS n_starts FROM conversations GROUP BY conv_id")
def sft(s: SparkSession, d: str) -> DataFrame:
    """Conversations as tokens: all of them say the rendered text, those with loss what assistants say and the ends of their turns; a start of turn is one token."""
    path, special = tokenizer_path("byte_bpe_50k.json"), ("<|im_start|>", "<|im_end|>")
    rows = sft_tokens(T.conversations(table(s, d, "conversations")), TEMPLATES["chatml"], path, special=special)
    trained = F.transform(F.filter(F.arrays_zip("input_ids", "loss_mask"), lambda x: x["loss_mask"] == 1), lambda x: x["input_ids"])
    starts = F.size(F.filter("input_ids", lambda i: i == 50257)).cast("long")
    return rows.select("conv_id", F.md5(decoded(F.col("input_ids"), path, special)).alias("text_md5"), F.md5(decoded(trained, path, special)).alias("trained_md5"), starts.alias("n_starts"))


@put("text_rendered", "SELECT conv_id, md5('<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || coalesce(text, '') || '<|eot_id|>', '' ORDER BY turn) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)) AS text_md5 FROM (SELECT conv_id, -1 AS turn, 'system' AS role, 'Be brief.' AS text FROM conversations GROUP BY conv_id HAVING arg_min(role, turn) <> 'system' UNION ALL SELECT conv_id, turn, role, text FROM conversations) GROUP BY conv_id")
def rendered_chats(s: SparkSession, d: str) -> DataFrame:
    """Conversations as text that asks for an answer, with a system message before those that lack one."""
    t = replace(TEMPLATES["headers"], system="Be brief.")
    return T.conversations(table(s, d, "conversations")).select("conv_id", F.md5(t.rendered(F.col("messages"), ask=True)).alias("text_md5"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# tools
def long_words(least: int, text: str):
    """Of a text the words of at least so many characters."""
    for at, word in enumerate(text.split(" ")):
        if len(word) >= least:
            yield {"place": at, "word": word}


_CALLS = "SELECT conv_id, turn, text, turn % 5 = 3 AS broken FROM conversations"


@put("tools_rows", f"WITH c AS ({_CALLS}), w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM c WHERE NOT broken) SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS nth, CAST(i AS INTEGER) AS place, word, false AS failed FROM w WHERE length(word) >= 9 UNION ALL SELECT conv_id, turn, 0, NULL, NULL, true FROM c WHERE broken")
def tools_rows(s: SparkSession, d: str) -> DataFrame:
    """A tool that gives several rows a call, over what conversations say; calls with broken arguments are rows that say so."""
    text = F.to_json(F.struct("text"), {"ignoreNullFields": "false"})
    calls = table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 3, F.concat(F.lit("{"), text)).otherwise(text).alias("arguments"))
    out = called(calls, rows_function(long_words, "place int, word string"), "arguments", 9)
    return out.select("conv_id", "turn", "nth", "place", "word", F.col("error").isNotNull().alias("failed"))


class WordCount(Tool):
    """Counts words over an instance's calls; its reward is the mean of them."""

    def execute(self, instance: str, arguments: dict) -> tuple[str, float, dict]:
        state = self.held[instance]
        state["n"] = state.get("n", 0) + len(arguments["text"].split(" "))
        state["calls"] = state.get("calls", 0) + 1
        return str(state["n"]), 0.5, {}

    def reward(self, instance: str) -> float:
        state = self.held[instance]
        return state.get("n", 0) / max(1, state.get("calls", 0))


@put("tools_sessions", "WITH c AS (SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL ELSE len(string_split(text, ' ')) END AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n IS NOT NULL THEN CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) END AS response, CASE WHEN n IS NULL THEN CAST(0 AS DOUBLE) ELSE 0.5 END::DOUBLE AS reward, n IS NULL AS failed FROM c UNION ALL SELECT conv_id, NULL, NULL, coalesce(sum(n), 0) / greatest(1, count(n))::DOUBLE, false FROM c GROUP BY conv_id")
def tools_sessions(s: SparkSession, d: str) -> DataFrame:
    """A tool with a state for each conversation: created, called turn by turn, rewarded and released."""
    calls = table(s, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("text")).alias("arguments"))
    out = sessions(calls, WordCount, "conv_id", "turn")
    return out.select("conv_id", "turn", "response", "reward", F.col("error").isNotNull().alias("failed"))


# objects
def truths(s: SparkSession, d: str) -> list[DataFrame]:
    """Ground truths that are whole numbers in one table, structs in another, texts in a third, doubles in a fourth."""
    orders = table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderkey")).alias("truth"))
    lines = table(s, d, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("l"), F.col("l_orderkey")).alias("id"), F.struct(F.col("l_returnflag").alias("flag"), F.array(F.col("l_linenumber"), F.col("l_orderkey")).alias("at")).alias("truth"))
    docs = table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.col("lang").alias("truth"))
    odd = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("c_custkey") + 0.5).alias("truth"))
    return [orders, lines, docs, odd]


@put("tbl_objects", """SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN 'BIGINT' END AS kind, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey AS VARCHAR) END AS said, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey END AS number FROM orders
UNION ALL SELECT 'l' || l_orderkey, 'OBJECT<at: ARRAY<BIGINT>, flag: STRING>', '{"at":[1,' || l_orderkey || '],"flag":"' || l_returnflag || '"}', NULL FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT 'd' || doc_id, CASE WHEN lang IS NOT NULL THEN 'STRING' END, '"' || lang || '"', NULL FROM documents
UNION ALL SELECT 'c' || c_custkey, 'DOUBLE', CASE WHEN c_custkey % 2 = 0 THEN '"NaN"' ELSE c_custkey || '.5' END, NULL FROM customer""")
def objects(s: SparkSession, d: str) -> DataFrame:
    """Tables whose ground truths differ in type, one after another as rows of objects."""
    whole = concat([Batch(numbered(t, "id")) for t in alike(*truths(s, d))]).rows
    number = F.when(kind_of("truth") == "BIGINT", F.variant_get("truth", "$", "bigint"))
    return whole.select("id", kind_of("truth").alias("kind"), F.to_json("truth").alias("said"), number.alias("number"))


@put("tbl_object_equality", "WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k, k % 5 <> 0 AS alike FROM o")
def object_equality(s: SparkSession, d: str) -> DataFrame:
    """Objects against others written otherwise: keys in another order, whole numbers and decimals, NaN and NaN; and against texts of the same look."""
    k = F.col("o_orderkey")
    a = F.when(k % 5 == 1, F.parse_json(F.format_string('{"x": %d, "y": [1, null]}', k))).when(k % 5 == 2, k.cast("variant")).when(k % 5 == 3, F.lit(float("nan")).cast("variant")).when(k % 5 == 0, k.cast("variant"))
    b = F.when(k % 5 == 1, F.parse_json(F.format_string('{"y":[1,null],"x":%d.0}', k))).when(k % 5 == 2, F.parse_json(F.format_string("%d.00", k))).when(k % 5 == 3, F.lit(float("nan")).cast("variant")).when(k % 5 == 0, k.cast("string").cast("variant"))
    return table(s, d, "orders").select(k.alias("k"), same(a, b).alias("alike"))


@put("tbl_collated", """WITH r AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, * FROM conversations) SELECT CAST(i // 32 AS BIGINT) AS batch_id, count(*) AS n, CAST(min(conv_id) AS BIGINT) AS first, md5('[' || string_agg(CASE WHEN turn % 2 = 0 THEN '{"conv":' || conv_id || ',"role":"' || role || '"}' ELSE CAST(turn AS VARCHAR) END, ',' ORDER BY i) || ']') AS objects_md5 FROM r GROUP BY 1""")
def collated_turns(s: SparkSession, d: str) -> DataFrame:
    """Turns in batches of 32, with a column of objects that are structs or numbers."""
    c = table(s, d, "conversations")
    even, odd = c.where("turn % 2 = 0").withColumn("x", F.struct("role", F.col("conv_id").alias("conv"))), c.where("turn % 2 = 1").withColumn("x", F.col("turn"))
    rows = numbered(united(even, odd).select("conv_id", "turn", "x"), "conv_id", "turn")
    out = collated(rows, 32)
    return out.select("batch_id", F.size("conv_id").cast("long").alias("n"), F.try_element_at("conv_id", F.lit(1)).alias("first"), F.md5(F.to_json("x")).alias("objects_md5"))


@put("tbl_records", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority, [CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT)] AS ids, md5(CASE WHEN o_orderkey % 2 = 0 THEN '\"even\"' ELSE CAST(o_orderkey AS VARCHAR) END) AS mixed_md5 FROM orders")
def records(s: SparkSession, d: str) -> DataFrame:
    """Rows to JSON records and back: columns of one type come back as that, one of several as objects."""
    o = table(s, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"), F.array("o_orderkey", "o_custkey").alias("ids"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("even").cast("variant")).otherwise(F.col("o_orderkey").cast("variant")).alias("mixed"))
    back = from_records(to_records(numbered(rows, "key")), ["key", "priority", "ids", "mixed"])
    return back.select("key", "priority", "ids", F.md5(F.to_json("mixed")).alias("mixed_md5"))


# sinks and listeners
@put("stream_queue_stats", "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT CAST(sum(least(n, 32)) AS BIGINT) AS size, CAST(sum(n) AS BIGINT) AS produced, CAST(sum(greatest(n - 32, 0)) AS BIGINT) AS dropped, CAST(32 AS BIGINT) AS most FROM n")
def stats_of_queues(s: SparkSession, d: str) -> DataFrame:
    """Statistics of all queues, told by a listener from what the micro-batches observe."""
    told = Observed()
    s.streams.addListener(told)
    try:
        stream = observed_queues(queues(id_stream(s, d), "user_id", "event_id", 32))
        query = stream.writeStream.option("checkpointLocation", folder(s, "state")).trigger(availableNow=True).outputMode("update").format("noop").start()
        told.wait(query)
    finally:
        s.streams.removeListener(told)
    return s.createDataFrame([queue_stats(told, 32)], "size long, produced long, dropped long, most long")


@put("stream_metric_sinks", "SELECT sink, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step, event_type || '/' || event_id AS metric, value, CAST(1 AS BIGINT) AS times FROM events, (SELECT unnest(['json', 'parquet']) AS sink)")
def metric_sinks(s: SparkSession, d: str) -> DataFrame:
    """Metrics of a stream in two sinks, of which the second fails in the third batch; after a restart each metric is in both, once."""
    events = id_stream(s, d).select(F.floor(F.unix_seconds("ts") / 86400).alias("step"), F.concat_ws("/", "event_type", "event_id").alias("metric"), "value")
    base, failed = folder(s, "metrics"), []

    def fails_once(df: DataFrame, to: str) -> None:
        df.limit(1).write.mode("overwrite").parquet(to)  # a part of the batch is there already
        if to.endswith("batch=2") and not failed:
            failed.append(to)
            raise OSError("the sink is gone")
        SINKS["parquet"](df, to)

    sinks = {"json": f"{base}/json", "parquet": f"{base}/parquet"}
    for _ in range(2):
        query = write_once(events, "rollouts", sinks, f"{base}/state", custom={"parquet": fails_once})
        try:
            query.awaitTermination()
        except StreamingQueryException:
            continue
    both = [read_sink(s, k, p, events.schema).withColumn("sink", F.lit(k)) for k, p in sinks.items()]
    return both[0].unionByName(both[1]).groupBy("sink", "step", "metric", "value").agg(F.count("*").alias("times"))


# metric cubes
@put("eval_cube", f"""{VIEWS}, p AS (SELECT data_source, uid, variable, avg(v) AS mean, stddev_pop(v) AS std, count(*) AS n FROM (SELECT data_source, uid, unnest(['reward', 'tokens']) AS variable, unnest([score, CAST(n_tokens AS DOUBLE)]) AS v FROM sc) GROUP BY ALL),
l AS (SELECT data_source, variable, 'mean' AS metric, mean AS value FROM p UNION ALL SELECT data_source, variable, 'std', std FROM p WHERE n > 1)
SELECT data_source, variable, metric, CAST(GROUPING_ID(data_source, variable, metric) AS BIGINT) AS grouping_id, count(*) AS n, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'std')}, {r6('min(value)', 'least')}, {r6('max(value)', 'most')} FROM l GROUP BY GROUPING SETS ((data_source, variable, metric), (variable, metric), (data_source, metric), (metric))""")
def cube(s: SparkSession, d: str) -> DataFrame:
    """Prompts' means and deviations by source, variable and metric, and over sources, variables and both, in one aggregate."""
    rows = scored(s, d).select("data_source", "uid", F.explode(F.create_map(F.lit("reward"), F.col("score"), F.lit("tokens"), F.col("n_tokens").cast("double"))).alias("variable", "v"))
    p = rows.groupBy("data_source", "uid", "variable").agg(F.avg("v").alias("mean"), F.when(F.count("*") > 1, F.stddev_pop("v")).alias("std"))
    tall = p.select("data_source", "variable", F.explode(F.create_map(F.lit("mean"), F.col("mean"), F.lit("std"), F.col("std"))).alias("metric", "value")).where("value IS NOT NULL")
    out = metric_cube(tall, ["data_source", "variable", "metric"], "value", [["data_source", "variable", "metric"], ["variable", "metric"], ["data_source", "metric"], ["metric"]])
    return rounded(out, "data_source", "variable", "metric", "grouping_id", "n", mean="mean", std="std", least="least", most="most")
