"""Sequences of tokens and chat texts: padding, cutting, masks, tool calls, conversations."""

from __future__ import annotations

import ast
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.batch import before_runs


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# arrays of token ids
def pad(ids: Column | str, length: int, fill: int | float, left: bool = False) -> Column:
    """The array filled up to a length; a longer one stays."""
    ids = _c(ids)
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(more, ids) if left else F.concat(ids, more)


def truncate(ids: Column | str, length: int, how: str = "right") -> Column:
    """At most `length` elements: without the right, left or middle ones; `error` fails on a longer array."""
    ids = _c(ids)
    n = F.size(ids)
    first, last = (lambda k: F.slice(ids, F.lit(1), F.lit(k))), (lambda k: F.slice(ids, F.greatest(n - k + 1, F.lit(1)), F.lit(k)))
    match how:
        case "right":
            cut = first(length)
        case "left":
            cut = last(length)
        case "middle":
            cut = F.concat(first(length // 2), last(length - length // 2))
        case "error":
            cut = F.filter(ids, lambda _: F.raise_error(F.lit("a sequence is too long")).cast("boolean"))
        case _:
            raise ValueError(f"no such truncation: {how}")
    return F.when(n <= length, ids).otherwise(cut)


def fitted(ids: Column | str, length: int, fill: int, left_pad: bool = True, how: str = "error") -> Column:
    return pad(truncate(ids, length, how), length, fill, left_pad)


def without_left_padding(ids: Column | str, mask: Column | str) -> Column:
    n = F.aggregate(_c(mask).cast("array<int>"), F.lit(0), lambda a, v: a + v)
    return F.slice(_c(ids), F.size(_c(ids)) - n + 1, n)


def mask_of(length: Column | str, width: int) -> Column:
    """1 for places below a length."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i < _c(length)).cast("int"))


def response_part(values: Column | str, prompt: Column | str, response: Column | str) -> Column:
    """Of values per token of prompt and response, those that foretell the response: one place earlier."""
    return F.slice(_c(values), F.when(_c(prompt) > 0, _c(prompt)).otherwise(F.raise_error(F.lit("a prompt is empty")).cast("int")), _c(response))


def full_width(part: Column | str, prompt: Column | str, width: int, fill: float = 0.0) -> Column:
    """The way back of response_part: an array of `width` values with the part where it was, one place before the response, and `fill` elsewhere. A part that does not fit
    is an error."""
    start, n = _c(prompt) - 1, F.size(_c(part))
    blank = lambda k: F.array_repeat(F.lit(fill), k)
    room = F.when((start >= 0) & (start + n <= width), start).otherwise(F.raise_error(F.lit("the response does not fit")).cast("int"))
    return F.concat(blank(room), _c(part).cast("array<double>"), blank(F.lit(width) - start - n))


def placed(score: Column | str, length: Column | str, width: int) -> Column:
    """The score at the last valid token, zeros elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == _c(length) - 1, _c(score).cast("double")).otherwise(0.0))


def unpadded(rows: DataFrame, ids: str, mask: str, key: str) -> DataFrame:
    """A row per valid token: key, place (in its row), id. `offsets` gives where rows start among all tokens."""
    pairs = F.arrays_zip(F.col(ids).alias("i"), F.col(mask).alias("m"))
    long = rows.select(key, F.posexplode(pairs).alias("place", "x"))
    return long.where("x.m <> 0").select(key, "place", F.col("x.i").alias("id"))


def offsets(rows: DataFrame, length: str, key: str, run: int = 4096) -> DataFrame:
    """rows with start and end of their tokens in one running order of key: sums over runs of keys first, then within them."""
    runs = rows.withColumn("__run", F.floor(F.col(key) / run))
    before = before_runs(runs.groupBy("__run").agg(F.sum(length).alias("__s")), run)
    w = Window.partitionBy("__run").orderBy(key)
    out = runs.join(before, "__run").withColumn("end", F.col("__b") + F.sum(length).over(w))
    return out.withColumn("start", F.col("end") - F.col(length)).drop("__run", "__b")


# conversations
def within(rows: DataFrame, n_tokens: Column, most: int) -> DataFrame:
    """Rows of at most so many tokens; those that could not be counted (null) go."""
    return rows.where(F.coalesce(n_tokens <= most, F.lit(False)))


def segments(text: Column, marks: tuple[str, ...] = ("<image>", "<video>", "<audio>")) -> Column:
    """A text as an array of struct<type, text>: its pieces, and a struct for each mark between them; empty pieces are left out."""
    cut = F.split(F.regexp_replace(text, "(" + "|".join(marks) + ")", "\u0001$1\u0001"), "\u0001")
    kind = lambda p: F.when(p.isin(*marks), F.regexp_replace(p, "[<>]", "")).otherwise("text")
    return F.transform(F.filter(cut, lambda p: p != ""), lambda p: F.struct(kind(p).alias("type"), F.when(p.isin(*marks), F.lit(None)).otherwise(p).alias("text")))


def with_media(parts: Column, images: Column) -> Column:
    """Struct<type, text, image> with images put in for their marks, in order; too few or too many fail."""
    n = F.size(F.filter(parts, lambda p: p["type"] == "image"))
    nth = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda p: p["type"] == "image"))
    filled = F.transform(parts, lambda p, i: F.struct(p["type"].alias("type"), p["text"].alias("text"), F.when(p["type"] == "image", F.try_element_at(images, nth(i))).alias("image")))
    wrong = F.filter(filled, lambda _: F.raise_error(F.lit("marks and images differ in number")).cast("boolean"))
    return F.when(n == F.size(images), filled).otherwise(wrong)


def with_all_media(parts: Column, **media: Column) -> Column:
    """Struct<type, text, item> with each kind's items (image, video, audio) put in for its marks, in order; too few or too many of a kind fail."""
    kinds = ("image", "video", "audio")
    of = lambda kind, some: F.size(F.filter(some, lambda p: p["type"] == kind))
    upto = lambda i: F.slice(parts, F.lit(1), i + 1)

    def item(p: Column, i: Column) -> Column:
        out = F.lit(None).cast("string")
        for k in kinds:
            out = F.when(p["type"] == k, F.try_element_at(media[k], of(k, upto(i)))).otherwise(out) if k in media else out
        return out

    filled = F.transform(parts, lambda p, i: F.struct(p["type"].alias("type"), p["text"].alias("text"), item(p, i).alias("item")))
    right = F.lit(True)
    for k in kinds:
        right = right & (of(k, parts) == (F.size(media[k]) if k in media else F.lit(0)))
    wrong = F.filter(filled, lambda _: F.raise_error(F.lit("marks and media differ in number")).cast("boolean"))
    return F.when(right, filled).otherwise(wrong)


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, messages array<struct<role, content>> in order of turn. turns: conv_id, turn, role, text."""
    item = F.struct("turn", F.col("role"), F.col("text").alias("content"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def sft_rows(turns: DataFrame, tokens: Column, system: int = 0, lead: int = 0) -> DataFrame:
    """conv_id, input_ids, loss_mask: each turn's tokens in order, without the template's system prefix after the first turn; loss on
    assistant turns but for the first `lead` tokens. tokens: array<int> of a turn, prefix included."""
    stripped = F.when((F.col("turn") > 0) & (F.col("role") != "system") & F.lit(system > 0), F.slice(tokens, F.lit(system + 1), F.greatest(F.size(tokens) - system, F.lit(0)))).otherwise(tokens)
    mask = F.transform(F.col("ids"), lambda _, i: F.when((F.col("role") == "assistant") & (i >= lead), 1).otherwise(0))
    item = F.struct("turn", "ids", mask.alias("mask"))
    got = turns.withColumn("ids", stripped).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    return got.select("conv_id", F.flatten(F.transform("t", lambda x: x["ids"])).alias("input_ids"), F.flatten(F.transform("t", lambda x: x["mask"])).alias("loss_mask"))


def preference_tokens(ids: Column | str, length: int, fill: int, end: int | None = None) -> Column:
    """An answer's token ids with the end token (if there is one), cut on the right and filled up to a length."""
    whole = F.concat(_c(ids), F.array(F.lit(end))) if end is not None else _c(ids)
    return pad(truncate(whole, length, "right"), length, fill)


def preference_rows(pairs: DataFrame) -> DataFrame:
    """Two rows of a pair: text (prompt and answer), chosen or not."""
    both = F.explode(F.array(F.struct(F.concat("prompt", "chosen").alias("text"), F.lit(True).alias("is_chosen")), F.struct(F.concat("prompt", "rejected").alias("text"), F.lit(False).alias("is_chosen"))))
    return pairs.select("*", both.alias("x")).select(*pairs.columns, "x.*")


def numbered_runs(rows: DataFrame, index: str, order: str, out: str = "rollout_n") -> DataFrame:
    """The place of each row in its run of consecutive rows of equal index, from 0; order: row numbers without gaps."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(index).orderBy(order))
    rows = rows.withColumn("__island", island)
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(index, "__island").orderBy(order)) - 1).drop("__island")


def clean_choices(text: Column) -> Column:
    """Sentence ends for titles in brackets, no bracketed notes, single spaces."""
    x = F.replace(F.trim(text), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(x, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def gsm8k_prompt(question: Column, answer: Column, index: Column, split: str = "train") -> list[Column]:
    """The columns of a prompt table from a question and its worked answer."""
    ask = F.concat(question, F.lit(' Let\'s think step by step and output the final answer after "####".'))
    truth = F.replace(F.regexp_extract(answer, r"#### (\-?[0-9\.\,]+)", 1), F.lit(","), F.lit(""))
    return [
        F.lit("openai/gsm8k").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), ask.alias("content"))).alias("prompt"), F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.alias("index"), answer.alias("answer"), question.alias("question")).alias("extra_info")]


def _prompt(source: Column | str, messages: list[tuple[str, Column]], ability: str, style: str, truth: Column, index: Column, split: str, **extra: Column) -> list[Column]:
    """The columns of a prompt table."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    chat = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in messages))
    return [
        lit(source).alias("data_source"), chat.alias("prompt"), F.lit(ability).alias("ability"), F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index"), *(c.alias(k) for k, c in extra.items())).alias("extra_info")]


def math_prompt(problem: Column, solution: Column, index: Column, split: str = "train") -> list[Column]:
    """From a problem and its worked solution, whose last boxed answer is the truth."""
    from tidemill.functions.scoring import last_boxed

    @F.pandas_udf("string")
    def boxed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: last_boxed(t) if t is not None else None)

    # fixed value: what the model is asked
    ask = F.concat(problem, F.lit(" Let's think step by step and output the final answer within \\boxed{}."))
    return _prompt("DigitalLearningGmbH/MATH-lighteval", [("user", ask)], "math", "rule", boxed(solution), index, split)


def choice_prompt(rows: DataFrame, split: str = "train") -> DataFrame:
    """Prompts for sentences with several endings. rows: row_idx, activity_label, ctx_a, ctx_b, endings, label (empty: the row goes)."""
    second = F.concat(F.upper(F.left("ctx_b", F.lit(1))), F.lower(F.substring("ctx_b", 2, 1 << 30)))
    query = clean_choices(F.concat(F.col("activity_label"), F.lit(": "), F.col("ctx_a"), F.lit(" "), second))
    rows = rows.where(F.length("label") > 0)
    cols = _prompt("Rowan/hellaswag", [("user", query)], "nlp", "model", F.col("label").cast("int"), F.col("row_idx"), split)
    return rows.select(*cols, F.transform("endings", clean_choices).alias("choices"))


def search_prompt(question: Column, truth: Column, source: Column, index: Column, system: str, lead: str, split: str = "train") -> list[Column]:
    """From a question for search, with the lead before it and the arguments that the search tool takes."""
    tagged = F.concat(F.lit("searchR1_"), source)
    args = F.struct(F.struct(F.struct(truth.alias("ground_truth"), question.alias("question"), tagged.alias("data_source")).alias("create_kwargs")).alias("search"))
    return _prompt(tagged, [("system", F.lit(system)), ("user", F.concat(F.lit(lead.rstrip("\n")), question))], "fact-reasoning", "rule", truth, index, split, need_tools_kwargs=F.lit(True), question=question, tools_kwargs=args)


def preferred_sft(pairs: DataFrame) -> DataFrame:
    """prompt, response: two rows of a pair, the chosen answer and the rejected one."""
    return pairs.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


def preferred_split(pairs: DataFrame, order: str = "row_idx", share: float = 0.75) -> DataFrame:
    """pairs with split: the first `share` of rows (rounded) train, the last rest test. order: row numbers from 0."""
    from tidemill.functions.masked import scalar_join

    n = pairs.agg(F.count("*").alias("__n"))
    return scalar_join(pairs, n).withColumn("split", F.when(F.col(order) < F.round(F.col("__n") * share), "train").otherwise("test")).drop("__n")


def multiturn_rows(turns: DataFrame) -> DataFrame:
    """messages, and the tools and thinking switch beside them, a row per conversation. turns: conv_id, turn, role, text."""
    return conversations(turns).select("conv_id", "messages", F.lit(None).cast("string").alias("tools"), F.lit(False).alias("enable_thinking"))


def agent_rows(steps: DataFrame, width: int) -> DataFrame:
    """seq_id, response_ids, response_mask: what an agent and its tools wrote, in order, 1 for the agent's tokens and 0 for observations, cut
    to `width`. steps: seq_id, turn, role (assistant or tool), ids."""
    mask = F.transform("ids", lambda _: F.when(F.col("role") == "assistant", 1).otherwise(0))
    held = steps.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ids", mask.alias("mask")))).alias("t"))
    part = lambda name: F.slice(F.flatten(F.transform("t", lambda x: x[name])), F.lit(1), F.lit(width))
    return held.select("seq_id", part("ids").alias("response_ids"), part("mask").alias("response_mask"))


# tool calls
def hermes_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of the JSON calls between tags (arguments as JSON text); unreadable ones are left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    read = F.transform(found, lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.get_json_object(j, "$.arguments").alias("arguments")))
    return F.filter(read, lambda x: x["name"].isNotNull() & x["arguments"].isNotNull())


def without_calls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<tool_call>(.*?)</tool_call>", "")


def channel_calls(text: Column) -> Column:
    """array<struct<name, arguments>> of calls on the commentary channel, reasoning taken off first; arguments as they stand."""
    plain = F.regexp_replace(text, r"(?s)<\|start\|>assistant<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    pattern = r"(?s)<\|start\|>assistant<\|channel\|>commentary to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
    names, args = (F.regexp_extract_all(plain, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(names, args, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def typed(value: str, kind: str | None) -> Any:
    """A parameter's text by its declared type; what doesn't read as that type stays text. Nothing is evaluated but literals."""
    if value.lower() == "null":
        return None
    kind = (kind or "string").strip().lower()
    if kind in ("string", "str", "text", "varchar", "char", "enum"):
        return value
    try:
        if re.match(r"int|uint|long|short|unsigned", kind):
            return int(value)
        if re.match(r"num|float", kind):
            x = float(value)
            return int(x) if x.is_integer() else x
        if kind in ("boolean", "bool", "binary"):
            return value.lower() == "true"
        return json.loads(value) if kind == "object" or kind.startswith("dict") else ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return value


def xml_calls(text: str, types: dict[str, dict[str, str]]) -> tuple[str, list[dict]]:
    """The text before the first call, and the calls; types: of each function's parameters. What can't be read: the text, no calls."""
    try:
        calls = []
        for body in re.findall(r"<function=(.*?)(?:</function>|$)", text, re.DOTALL):
            name, _, rest = body.partition(">")
            found = re.findall(r"<parameter=(.*?)>(.*?)(?:</parameter>|(?=<parameter=)|$)", rest, re.DOTALL)
            trim = lambda v: re.sub(r"\A\n|\n\Z", "", v)
            calls.append({"name": name, "arguments": {k: typed(trim(v), types.get(name, {}).get(k)) for k, v in found}})
        at = re.search(r"<tool_call>|<function=", text)
        return (text[: at.start()] if at else text), calls
    except Exception:
        return text, []


QUOTE = '<|"|>'


def brace_calls(text: str) -> list[dict]:
    """Calls written call:name{key:value,...}, texts between quote marks, other values by how they look."""

    def value(v: str) -> Any:
        if v.startswith(QUOTE):
            return v.removeprefix(QUOTE).removesuffix(QUOTE)
        if v in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[v]
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    item = re.compile(r"(\w+):(<\|\"\|>.*?<\|\"\|>|[^,}]*)", re.DOTALL)
    return [{"name": n, "arguments": {k: value(v.strip()) for k, v in item.findall(body)}} for n, body in re.findall(r"call:([\w.]+)\{((?:<\|\"\|>.*?<\|\"\|>|[^}])*)\}", text, re.DOTALL)]


def xml_calls_udf(types: dict[str, dict[str, str]]):
    """A column function: array of the calls as JSON."""

    @F.pandas_udf("array<string>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [json.dumps(c) for c in xml_calls(t, types)[1]] if t is not None else [])

    return run


def token_ids(x: Any) -> list[int]:
    """Token ids from a list, a list of one list, a mapping with input_ids, or an array of either shape."""
    if hasattr(x, "keys"):
        x = x["input_ids"]
    x = x.tolist() if hasattr(x, "tolist") else list(x)
    return list(x[0]) if x and isinstance(x[0], list | tuple) else x


def template_prefix(render, empty: str = "") -> tuple[list[int], list[int]]:
    """What a chat template puts before the first message, and what it adds to ask for an answer, from renderings of one and two
    messages. render(messages, ask): token ids."""
    user = {"role": "user", "content": empty}
    one, two = render([user], False), render([user, user], False)
    each = len(two) - len(one)
    return one[: len(one) - each], render([user], True)[len(one) :]
