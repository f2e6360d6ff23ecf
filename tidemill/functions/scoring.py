"""Rule-based scores of responses: column expressions where patterns suffice, pandas functions where braces or JSON must be followed."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.formulas import formula, identical
from tidemill.functions.registry import Registry
from tidemill.session import BATCH, BATCH_BYTES

SCORERS = Registry("scorer")
TAIL = 300

# fixed values: what answers are rid of before they are compared
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), (r"\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", r"\mathrm{th}", r"^\circ", r"^{\circ}", r"\;", r",\!", "{,}", '"', "\\dots",
]


def _last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def ending(text: Column, n: int = TAIL) -> Column:
    return F.right(text, F.lit(n))


def gsm8k_answer(text: Column, flexible: bool = False) -> Column:
    """The last number after ####, or (flexible) the last number at all; null if there is none."""
    if not flexible:
        return F.replace(F.replace(_last(_all(ending(text), r"#### (\-?[0-9\.\,]+)", 1)), F.lit(","), F.lit("")), F.lit("$"), F.lit(""))
    found = _all(ending(text), r"(\-?[0-9\.\,]+)", 1)
    proper = F.filter(found, lambda x: ~x.isin("", "."))
    return F.coalesce(_last(proper), F.try_element_at(found, F.lit(1)))


def gsm8k(text: Column, truth: Column, flexible: bool = False, format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = gsm8k_answer(text, flexible)
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


def final_answer(answer: Column) -> Column:
    """A quantitative answer in a plain form: what follows its last =, without words, units and markup. The patterns are fixed values."""
    x = _last(F.split(answer, "="))
    for old, new in SUBSTITUTIONS:
        x = F.replace(x, F.lit(old), F.lit(new))
    for gone in REMOVED:
        x = F.replace(x, F.lit(gone), F.lit(""))
    x = F.regexp_replace(x, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for command in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, rf"(\\{command}\{{)(.*?)(\}})", "$2")
    x = F.regexp_replace(x, r"(\\boxed\{)(.*)(\})", "$2")
    x = F.regexp_replace(x, r"(frac)([^{])(.)", "frac{$2}{$3}")
    x = F.regexp_replace(x, r"(sqrt)([^{])", "sqrt{$2}")
    x = F.replace(x, F.lit("$"), F.lit(""))
    return F.trim(F.when(F.replace(x, F.lit(","), F.lit("")).rlike(r"^\p{Nd}+$"), F.replace(x, F.lit(","), F.lit(""))).otherwise(x))


def answer_line(text: Column, truth: Column) -> Column:
    """A struct of score (1 or -1), acc and pred, by the last line that says `Answer:`."""
    found = _last(_all(ending(text), r"(?i)Answer\s*:\s*([^\n]+)", 1))
    pred = final_answer(F.coalesce(found, F.lit("[INVALID]")))
    right = pred == final_answer(truth)
    return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 down to -factor as a response fills the buffer before the greatest length, and below beyond it."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


# answers of questions
def qa_normalise(text: Column) -> Column:
    """Lower case, without punctuation and articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(answer: Column, golden: Column) -> Column:
    return F.exists(golden, lambda g: qa_normalise(g) == qa_normalise(answer))


def sub_match(answer: Column, golden: Column) -> Column:
    return F.exists(golden, lambda g: F.contains(qa_normalise(answer), qa_normalise(g)))


def tagged_answer(text: Column) -> Column:
    return F.trim(_last(_all(text, r"(?s)<answer>(.*?)</answer>", 1)))


def qa_score(text: Column, golden: Column, sub: bool = False, format_score: float = 0.0, score: float = 1.0) -> Column:
    """By the last <answer>; exact matches count a quarter in a text with more than ten tags."""
    answer = tagged_answer(text)
    hit = sub_match(answer, golden) if sub else exact_match(answer, golden)
    many = F.lit(False) if sub else (F.size(F.split(text, "<answer>")) > 11) | (F.size(F.split(text, "</answer>")) > 11)
    return F.when(answer.isNull(), 0.0).when(hit, F.when(many, score / 4).otherwise(score)).otherwise(format_score)


# boxed answers
def last_boxed(text: str) -> str | None:
    """The content of the last \\boxed or \\fbox, braces matched, or of `\\boxed x$`; None if there is none."""
    at = max(text.rfind("\\boxed"), text.rfind("\\fbox")) if "\\boxed " not in text else -1
    if at < 0:
        return text.split("\\boxed ")[-1].split("$")[0] if "\\boxed " in text else None
    open_at, depth = text.find("{", at), 0
    for i in range(open_at, len(text) if open_at >= 0 else -1):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if depth == 0:
            return text[open_at + 1 : i]
    return None


def math_normal(s: str) -> str:
    """A formula with one spelling of fractions, roots and numbers, and without units, degrees and spacing."""
    for old, new in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        s = s.replace(old, new)
    if s.count("\\text{ ") > 1:
        raise ValueError("two units")
    s = s.split("\\text{ ")[0].replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    s = re.sub(r"^\.", "0.", s)
    s = re.sub(r"^[^=]{0,2}=([^=]*)$", r"\1", s)
    s = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", s).replace(" ", "")
    s = re.sub(r"\\frac([^{])(\{)", r"\\frac{\1}\2", s)
    s = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", s)
    if s == "0.5":
        s = "\\frac{1}{2}"
    if m := re.fullmatch(r"(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))", s):
        s = rf"\frac{{{m[1]}}}{{{m[2]}}}"
    return s


def math_score(text: str | None, truth: str | None) -> float:
    """1 if the boxed answer and the truth are equal once normalised; 0 also for what can't be read."""
    try:
        answer = last_boxed(text)
        return float(answer is not None and math_normal(answer) == math_normal(truth))
    except Exception:
        return 0.0


def number(s: str) -> float | None:
    s = re.sub(r"^\\frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}$", r"\1/\2", s.strip().replace(",", "").replace("$", "").rstrip("%"))
    if m := re.fullmatch(r"(-?[\d.]+)/(-?[\d.]+)", s):
        return float(m[1]) / float(m[2]) if float(m[2]) else None
    try:
        return float(s)
    except ValueError:
        return None


def math_equal(a: str, b: str, rel: float = 1e-4) -> bool:
    """Equal as text (brackets aside), as numbers (also as per cent of one another), by the value of their formulas or as functions of their
    unknowns (`x^2-1` is `(x+1)(x-1)`), without the base a number is in (`12_8` is `12`); or element by element between brackets of one
    kind, of matrices too. An interval's open and closed ends differ."""
    whole = [re.sub(r"^[^=]{0,2}=([^=]*)$", r"\1", x.strip()) for x in (a, b)]
    try:
        a, b = (re.sub(r"_\{?\d+\}?$", "", math_normal(x)) if re.fullmatch(r"\w+_\{?\d+\}?", math_normal(x)) else math_normal(x) for x in (a, b))
    except ValueError:
        return False
    if a.lower() == b.lower():
        return True
    x, y = (number(v) if number(v) is not None else formula(v) for v in (a, b))
    if x is not None and y is not None:
        return any(abs(x - v) <= rel * max(abs(v), 1e-12) for v in (y, y / 100, y * 100))
    if identical(*whole):
        return True
    a, b = (re.sub(r"\\(?:left|right)(?![a-z])|\$", "", w).strip() for w in whole)
    matrix = re.compile(r"(?s)\\begin\{[pbv]?matrix\}(.*)\\end\{[pbv]?matrix\}")
    if (m := matrix.fullmatch(a)) and (n := matrix.fullmatch(b)):
        p, q = ([row.split("&") for row in re.split(r"\\\\|\\(?![a-zA-Z])", t[1])] for t in (m, n))
        return [len(r) for r in p] == [len(r) for r in q] and all(math_equal(u, v, rel) for r, s in zip(p, q, strict=True) for u, v in zip(r, s, strict=True))
    ends = lambda t: (t[0], t[-1]) if len(t) > 1 and t[0] in "([" and t[-1] in ")]" else ("", "")
    if ends(a) != ends(b) and "" not in (ends(a)[0], ends(b)[0]):
        return False
    p, q = (re.split(r",", t[1:-1] if ends(t)[0] else t) for t in (a, b))
    return len(p) == len(q) > 1 and all(math_equal(u, v, rel) for u, v in zip(p, q, strict=True))


def answer_match(text: str | None, truth: str | None) -> float:
    """1 if the last boxed answer, or else the whole text, equals the truth as math_equal has it."""
    if text is None or truth is None:
        return 0.0
    boxed = last_boxed(text)
    return float(math_equal(boxed if boxed is not None else text.strip(), truth))


def strict_box(text: Column, truth: Column) -> Column:
    """A struct of score (1 or -1), acc and pred: the boxed answer within the last 100 characters, exactly as the truth is written."""

    @F.pandas_udf("string")
    def boxed(tails: pd.Series) -> pd.Series:
        return tails.map(lambda t: last_boxed(t) if t is not None else None)

    pred = boxed(ending(text, 100))
    right = F.coalesce(pred == truth, F.lit(False))
    return F.struct(F.when(right, 1.0).otherwise(-1.0).alias("score"), right.alias("acc"), pred.alias("pred"))


def fenced_code(text: Column) -> Column:
    """The code of the last fenced block, its language's name off; null without one."""
    return _last(_all(text, r"(?s)```(?:\w+\n)?(.*?)```", 1))


def code_score(text: Column, results: Column, continuous: bool = True) -> Column:
    """Of test results of a response's code; a response without a fenced block has no code, and scores 0."""
    return F.when(fenced_code(text).isNull(), 0.0).otherwise(passed(results, continuous))


# tool calls
def overlap_score(a: list, b: list) -> float:
    """Common elements, each as often as in both, over all of either list; equal lists: 1."""
    if a == b:
        return 1.0
    common = sum((Counter(a) & Counter(b)).values())
    return common / (len(a) + len(b) - common) if a or b else 0.0


def tool_call_score(truth: list[dict], found: list[dict], low: float = -3.0, high: float = 3.0) -> float:
    """Between low and high: names in common, and for each true call the best unused one of its name by parameters and values."""
    if truth == found:
        return high
    score, most = overlap_score([t["name"] for t in truth], [f["name"] for f in found]), 1.0
    free = list(range(len(found)))
    for call in truth:
        want = call["parameters"]
        most += 1 + len(want)
        worth = {i: overlap_score(list(want), list(found[i]["parameters"])) + sum(found[i]["parameters"].get(k, ...) == v for k, v in want.items()) for i in free if found[i]["name"] == call["name"]}
        if worth and max(worth.values()) > 0:
            best = max(worth, key=worth.get)
            free.remove(best)
            score += worth[best]
    return (high - low) * score / most + low


def call_lines(text: str) -> list[dict]:
    return [json.loads(line) for line in text.split("<tool_call>")[1].split("</tool_call>")[0].strip().split("\n")]


def tool_format(response: str, truth: str) -> float:
    """1 if the response has the parts that the truth has, once each, in order, after its thoughts."""
    tags = [t for t in ("tool_call", "response") if f"<{t}>" in truth]
    body = {"tool_call": r"\n<tool_call>\n.*?\n</tool_call>", "response": r"\n<response>.*?</response>"}
    shape = r"^<think>.*?</think>" + "".join(body[t] for t in tags) + "$"
    once = all(response.count(f"<{t}>") == response.count(f"</{t}>") == 1 for t in tags)
    return float(once and bool(re.search(shape, response, re.DOTALL)))


def tool_reward(text: str, truth: str, markers: tuple[str, str] = ("<|im_start|>assistant", "<|im_end|>")) -> dict[str, float]:
    response = text.split(markers[0])[-1].split(markers[1])[0].strip()
    layout, calls = tool_format(response, truth), 0.0
    if "<tool_call>" in truth:
        try:
            if "</tool_call>" not in response:
                raise ValueError("no call")
            calls = tool_call_score(call_lines(truth), call_lines(response))
        except Exception:
            calls = -3.0
    return {"score": layout + calls, "format_reward": layout, "accuracy_reward": calls}


def geo3k(text: str | None, truth: str | None) -> float:
    if text is None or truth is None:
        return 0.0
    shape = bool(re.fullmatch(r"(?s)<think>.*</think>.*\\boxed\{.*\}.*", text))
    answer = last_boxed(text)
    return 0.9 * float(answer is not None and math_equal(answer, truth)) + 0.1 * shape


def passed(results: Column, continuous: bool = False) -> Column:
    """From an array of test results: all passed, or the share of the first ten; no results: 0."""
    first = F.slice(results, F.lit(1), F.lit(10)) if continuous else results
    n = F.size(F.filter(first, lambda r: r))
    share = F.when(F.size(first) > 0, n / F.size(first)).otherwise(0.0)
    return share if continuous else F.when(share == 1, 1.0).otherwise(0.0)


def as_udf(f: Callable[..., float], kind: str = "double") -> Callable[..., Column]:
    """A row function over Arrow batches. An error in a row is an error of the query, which names the row's beginning: rows that may fail go through `extensions.guarded`,
    which says of each what went wrong."""

    @F.pandas_udf(kind)
    def run(text: pd.Series, truth: pd.Series) -> pd.Series:
        def one(a, b):
            try:
                return f(a, b)
            except Exception as e:
                raise ValueError(f"no score for {a!r:.80} against {b!r:.80}: {type(e).__name__}: {e}") from e

        return pd.Series([one(a, b) for a, b in zip(text, truth, strict=True)])

    return run


# fixed values: sources, by the scorer each has
SOURCES = {
    "gsm8k": ["openai/gsm8k"],
    "math": ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"],
    "line": ["math_dapo", "math", "math_dapo_reasoning"],
    "match": ["numina_aops_forum", "numina_synthetic_math", "numina_amc_aime", "numina_synthetic_amc", "numina_cn_k12", "numina_olympiads"],
    "code": ["codecontests", "apps", "codeforces", "taco"],
    "geometry": ["hiyouga/geometry3k"],
    "search": ["searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa", "searchR1_musique", "searchR1_bamboogle"],
}


def _results(text: Column, truth: Column) -> Column:
    """truth: the results of the tests as a JSON array, since code is not run here."""
    return code_score(text, F.from_json(truth, "array<boolean>"))


RULES: dict[str, Callable[[Column, Column], Column]] = {
    "gsm8k": gsm8k, "math": lambda text, truth: as_udf(math_score)(text, truth), "line": lambda text, truth: answer_line(text, truth)["score"], "match": lambda text, truth: as_udf(answer_match)(text, truth),
    "code": _results, "geometry": lambda text, truth: as_udf(geo3k)(text, truth), "search": lambda text, truth: qa_score(text, F.array(truth))}
for _rule, _names in SOURCES.items():
    for _name in _names:
        SCORERS.register(_name)(RULES[_rule])


def scorer(source: str) -> Callable[[Column, Column], Column]:
    """The scorer of a source; sources whose names begin with aime have that of answer lines."""
    return RULES["line"] if source.startswith("aime") else SCORERS[source]


def route(source: Column, text: Column, truth: Column, sources: list[str] | None = None) -> Column:
    """The score by each row's source, of those named, else of all that there are; a row of another source fails. A null text scores as an empty one.
    Batches go to Python by size, since texts differ in length: what a task holds of them is bounded in bytes."""
    if spark := SparkSession.getActiveSession():
        spark.conf.set(BATCH, BATCH_BYTES)
    text = F.coalesce(text, F.lit(""))
    out = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double")
    by_rule: dict[int, tuple[Callable[[Column, Column], Column], list[str]]] = {}
    for name in sources if sources is not None else SCORERS.entries:
        by_rule.setdefault(id(scorer(name)), (scorer(name), []))[1].append(name)
    if sources is None:
        out = F.when(F.startswith(source, F.lit("aime")), RULES["line"](text, truth)).otherwise(out)
    for f, names in by_rule.values():
        out = F.when(source.isin(*names), f(text, truth)).otherwise(out)
    return out
