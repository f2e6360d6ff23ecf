"""Conversations as token ids with loss masks, by a chat template and a real tokenizer.

A template is what stands before and after each role's content, so texts are rendered by column expressions. Messages are encoded one
by one, a batch of rows at a time; a token counts for the loss if it begins at or after its message's content and the role is
trained. No row leaves its place: there is no shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.registry import Registry

TEMPLATES = Registry("chat template")
SLICE_ROWS = 64


@dataclass(frozen=True)
class Template:
    """before, after: what stands around a role's content, `` for any other role, in which {role} is its name. start: what comes first of all;
    system: the content of a system message put before conversations that don't begin with one; ask: what asks for an answer."""

    before: Mapping[str, str]
    after: Mapping[str, str]
    start: str = ""
    system: str | None = None
    ask: str = ""
    trained: Sequence[str] = field(default=("assistant",))

    def _around(self, pieces: Mapping[str, str], role: Column) -> Column:
        text = lambda s: F.replace(F.lit(s), F.lit("{role}"), role)
        out = text(pieces[""]) if "" in pieces else F.raise_error(F.concat(F.lit("the template has no role "), F.coalesce(role, F.lit("null")))).cast("string")
        for name, s in pieces.items():
            if name:
                out = F.when(role == name, text(s)).otherwise(out)
        return out

    def pieces(self, messages: Column) -> Column:
        """array<struct<text, lead, trained>>: of each message the text, where in it the content begins, and whether it is trained. Null contents are empty."""
        if self.system is not None:
            own = F.struct(F.lit("system").alias("role"), F.lit(self.system).alias("content"))
            given = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
            first = F.try_element_at(messages, F.lit(1))["role"]
            messages = F.when(F.coalesce(first, F.lit("")) == "system", given).otherwise(F.concat(F.array(own), given))

        def piece(m: Column, i: Column) -> Column:
            head = F.concat(F.when(i == 0, F.lit(self.start)).otherwise(F.lit("")), self._around(self.before, m["role"]))
            text = F.concat(head, F.coalesce(m["content"], F.lit("")), self._around(self.after, m["role"]))
            return F.struct(text.alias("text"), F.length(head).alias("lead"), F.coalesce(m["role"].isin(*self.trained), F.lit(False)).alias("trained"))

        return F.transform(messages, piece)

    def rendered(self, messages: Column, ask: bool = False) -> Column:
        texts = F.array_join(F.transform(self.pieces(messages), lambda p: p["text"]), "")
        return F.concat(texts, F.lit(self.ask)) if ask else texts


TEMPLATES.entries |= {
    # fixed values: the formats of common templates
    "chatml": Template({"": "<|im_start|>{role}\n"}, {"": "<|im_end|>\n"}, ask="<|im_start|>assistant\n"),
    "headers": Template({"": "<|start_header_id|>{role}<|end_header_id|>\n\n"}, {"": "<|eot_id|>"}, start="<|begin_of_text|>", ask="<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "lines": Template({"": "<|{role}|>\n"}, {"": "</s>\n"}, ask="<|assistant|>\n"),
    "turns": Template({"assistant": "<start_of_turn>model\n", "": "<start_of_turn>{role}\n"}, {"": "<end_of_turn>\n"}, start="<bos>", ask="<start_of_turn>model\n"),
}


def template_of(render: Callable[[list[dict[str, str]], bool], str], roles: Sequence[str] = ("user", "assistant")) -> Template:
    """The template behind a rendering function (messages, whether to ask for an answer): told from renderings of marked contents, and checked
    on a conversation of all roles; a ValueError if messages are not rendered one after another, each by its role."""
    mark = "⁂mark⁂"
    one = lambda r: {"role": r, "content": mark}
    before, after, start = {}, {}, None
    for r in roles:
        once, twice = render([one(r)], False).split(mark), render([one(r)] * 2, False).split(mark)
        if len(once) != 2 or len(twice) != 3 or twice[0] != once[0] or not twice[1].startswith(once[1]) or twice[2] != once[1]:
            raise ValueError(f"messages of {r!r} are not rendered one after another")
        before[r], after[r] = twice[1][len(once[1]) :], once[1]
        if not once[0].endswith(before[r]) or start not in (None, once[0][: len(once[0]) - len(before[r])]):
            raise ValueError(f"what comes first depends on the role {r!r}")
        start = once[0][: len(once[0]) - len(before[r])]
    whole = [{"role": r, "content": f"{mark}{i}"} for i, r in enumerate([*roles, *roles])]
    plain = render(whole, False)
    if plain != start + "".join(before[m["role"]] + m["content"] + after[m["role"]] for m in whole) or not render(whole, True).startswith(plain):
        raise ValueError("a message is rendered otherwise among others")
    return Template(before, after, start=start, ask=render(whole, True)[len(plain) :])


def _encoded(path: str, special: Sequence[str]) -> Callable[[list[str], list[int], list[bool]], tuple[list, list]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if special:
        t.add_special_tokens(list(special))

    def run(texts: list[str], leads: list[int], trained: list[bool]) -> tuple[list, list]:
        ids, masks = [], []
        for e, lead, own in zip(t.encode_batch(texts, add_special_tokens=False), leads, trained, strict=True):
            ids.append(e.ids)
            masks.append([int(own and a >= lead) for a, _ in e.offsets])
        return ids, masks

    return run


def sft_tokens(rows: DataFrame, template: Template, tokenizer: str, messages: str = "messages", special: Sequence[str] = ()) -> DataFrame:
    """rows with input_ids and loss_mask (array<int>): all messages' tokens in order, and 1 where a token begins in what a trained role says or the end of its turn.

    tokenizer: a file of the tokenizers library, on every node; special: strings that are tokens of their own. A token that begins before the
    content counts as the template's. Null conversations have null ids; empty ones, and empty contents, have what the template
    gives; a role that the template lacks is an error; texts of any length are encoded whole."""
    pieces = template.pieces(F.col(messages))
    arrays = {"__texts": F.transform(pieces, lambda p: p["text"]), "__leads": F.transform(pieces, lambda p: p["lead"]), "__trained": F.transform(pieces, lambda p: p["trained"])}
    names, inner = [c for c in rows.columns if c not in ("input_ids", "loss_mask")], tuple(arrays)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for whole in batches:
            encode = encode or _encoded(tokenizer, special)
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                texts, leads, trained = (batch.column(c) for c in inner)
                none = texts.is_null().to_numpy(zero_copy_only=False)
                each = np.asarray(texts.value_lengths().fill_null(0))
                ids, masks = encode(texts.flatten().to_pylist(), leads.flatten().to_pylist(), trained.flatten().to_pylist())
                ends = np.cumsum(each)
                out = [[None if none[i] else [x for m in part[ends[i] - each[i] : ends[i]] for x in m] for i in range(len(each))] for part in (ids, masks)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, pa.list_(pa.int32())) for x in out)], names=[*names, "input_ids", "loss_mask"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
    return rows.select(*names, *(c.alias(n) for n, c in arrays.items())).mapInArrow(work, f"{fields}, input_ids array<int>, loss_mask array<int>")


def decoded(ids: Column, tokenizer: str, special: Sequence[str] = ()) -> Column:
    """The text of token ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        if special:
            t.add_special_tokens(list(special))
        for x in batches:
            held = [list(map(int, i)) if i is not None else None for i in x]
            texts = iter(t.decode_batch([i for i in held if i is not None], skip_special_tokens=False))
            yield pd.Series([next(texts) if i is not None else None for i in held], dtype=object)

    return run(ids)
