"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are read whole, as stretches of SPAN bytes; in each, one network of gated recurrent units runs forwards and one
backwards, and both states label every byte with a distribution over languages. A document's distribution is the mean of its
bytes'. The networks are trained in numpy by backpropagation through time, with Adam, on segments of SEGMENT bytes. The sample has two
bounds, which are parameters: about PER_LANG segments a language, drawn by a hash from all places of all its texts, and about SAMPLE
segments of all languages, of which there may be any number: the more there are, the smaller is each one's share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.runtime import columns, cut, grouped, lean, texts

SEGMENT, SPAN, UNITS = 64, 512, 8
PER_LANG, SAMPLE, SHARES_BYTES = 20_000, 90_000, 4_000_000
STEPS, BATCH, RATE = 350, 256, 0.02
GROUP_BYTES = 1_000_000
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double"
GATES = ("r", "z", "n")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def segments(bodies: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by time and segment, zero beyond a text's end; the bytes that each segment has; the text it is of."""
    sizes = np.array([len(b) for b in bodies], np.int64)
    counts = -(-sizes // size)
    flat = np.zeros((int(counts.sum()), size), np.uint8)
    offsets = (np.cumsum(counts) - counts) * size
    raw = flat.reshape(-1)
    for b, n, at in zip(bodies, sizes.tolist(), offsets.tolist(), strict=True):
        if n:
            raw[at : at + n] = np.frombuffer(b, np.uint8)
    doc = np.repeat(np.arange(len(bodies)), counts)
    filled = np.full(len(doc), size)
    last = np.cumsum(counts)[counts > 0] - 1
    filled[last] = sizes[counts > 0] - (counts[counts > 0] - 1) * size
    return np.ascontiguousarray(flat.T), filled, doc


def initial(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Parameters: for each direction and gate the input table e, of a row per byte, and the recurrent weights u; the outputs w, b."""
    p = {}
    for d in "fb":
        for g in GATES:
            p[f"{d}e{g}"] = rng.normal(0, 0.3, (256, UNITS))
            p[f"{d}u{g}"] = rng.normal(0, UNITS**-0.5, (UNITS, UNITS))
        p[f"{d}w"] = rng.normal(0, 0.3, (UNITS, classes))
    p["b"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _step(p: dict, d: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    r = _sigmoid(p[f"{d}er"].take(x, 0) + h @ p[f"{d}ur"])
    z = _sigmoid(p[f"{d}ez"].take(x, 0) + h @ p[f"{d}uz"])
    m = h @ p[f"{d}un"]
    n = np.tanh(p[f"{d}en"].take(x, 0) + r * m)
    return r, z, m, n, n + z * (h - n)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def gradients(p: dict, x: np.ndarray, filled: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the bytes' labels and its gradient, by backpropagation through time."""
    steps, n = x.shape
    logits, tape = np.zeros((steps, n, len(p["b"])), np.float32) + p["b"], {}
    on = (np.arange(steps)[:, None] < filled).astype(np.float32)[..., None]
    for d, times in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((n, UNITS), np.float32)
        for t in times:
            tape[d, t] = (h, *(got := _step(p, d, x[t], h)))
            h = got[-1] if d == "f" else got[-1] * on[t]  # backwards, the state is 0 until the text begins
            logits[t] += h @ p[f"{d}w"]
    prob = _softmax(logits.reshape(steps * n, -1)).reshape(logits.shape)
    valid = (np.arange(steps)[:, None] < filled).astype(np.float32) / filled.sum()
    loss = -float((np.log(prob[:, np.arange(n), y] + 1e-9) * valid).sum())
    prob[:, np.arange(n), y] -= 1
    prob *= valid[..., None]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["b"] = prob.sum((0, 1))
    for d, times in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        back = np.zeros((n, UNITS), np.float32)
        inputs = {g: np.zeros((steps, n, UNITS), np.float32) for g in GATES}
        for t in times:
            h, r, z, m, c, new = tape[d, t]
            back = back + prob[t] @ p[f"{d}w"].T if d == "f" else (back + prob[t] @ p[f"{d}w"].T) * on[t]
            grad[f"{d}w"] += new.T @ prob[t]
            a_n = back * (1 - z) * (1 - c * c)
            a_z = back * (h - c) * z * (1 - z)
            a_r = a_n * m * r * (1 - r)
            a_m = a_n * r
            for g, a in (("r", a_r), ("z", a_z), ("n", a_m)):
                grad[f"{d}u{g}"] += h.T @ a
            for g, a in (("r", a_r), ("z", a_z), ("n", a_n)):
                inputs[g][t] = a
            back = back * z + a_m @ p[f"{d}un"].T + a_r @ p[f"{d}ur"].T + a_z @ p[f"{d}uz"].T
        for g in GATES:
            np.add.at(grad[f"{d}e{g}"], x.reshape(-1), inputs[g].reshape(-1, UNITS))
    return loss, grad


def train(bodies: list[bytes], labels: list[str]) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and parameters. The same sample gives the same network."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(7)
    x, filled, doc = segments(bodies)
    y = np.array([langs.index(v) for v in labels])[doc]
    by_lang = [np.flatnonzero(y == k) for k in range(len(langs))]
    by_lang = [v for v in by_lang if len(v)]
    p = initial(len(langs), rng)
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1 if by_lang else 1):
        pick = np.array([rng.choice(by_lang[k]) for k in rng.integers(0, len(by_lang), BATCH)])
        _, grad = gradients(p, x[:, pick], filled[pick], y[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grad.items():
            g *= min(1.0, 1.0 / (size + 1e-9))
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.001 * (g * g - square[k])
            p[k] -= (rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)
    return langs, p


def document_probabilities(p: dict, bodies: list[bytes]) -> np.ndarray:
    """The mean distribution over each text's bytes; zeros for an empty text."""
    x, filled, doc = segments(bodies, SPAN)
    steps, n = x.shape
    out = np.zeros((len(bodies), len(p["b"])))
    if not n:
        return out
    logits = np.empty((steps, n, len(p["b"])), np.float32)
    h = np.zeros((n, UNITS), np.float32)
    for t in range(steps):
        h = _step(p, "f", x[t], h)[-1]
        np.matmul(h, p["fw"], out=logits[t])
    h = np.zeros((n, UNITS), np.float32)
    total = np.zeros((n, len(p["b"])), np.float32)
    for t in range(steps - 1, -1, -1):
        on = (t < filled)[:, None]
        h = _step(p, "b", x[t], h)[-1] * on  # 0 until the text begins
        prob = _softmax(logits[t] + h @ p["bw"] + p["b"])
        total += prob * on
    np.add.at(out, doc, total)
    return out / np.maximum(np.array([len(b) for b in bodies]), 1)[:, None]


def has_letter(body: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", body)) or any(map(str.isalpha, body.decode("utf-8", "replace")))


def sample(docs: DataFrame, usable: Column) -> tuple[list[bytes], list[str]]:
    """Training segments and their languages, in order of language, doc_id, place and text; a segment is SEGMENT characters."""
    known = docs.where(usable & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", F.ceil(F.length("text") / SEGMENT).alias("n"))
    every = cut(known.groupBy("lang").agg(F.sum("n").alias("all")))
    count, size = every.agg(F.count("*"), F.coalesce(F.sum(F.length("lang") + 16), F.lit(0))).first()
    part = float(min(PER_LANG, max(1.0, SAMPLE / max(1, count))))  # of a language
    share = every.select(F.col("lang").alias("known"), F.least(F.lit(1.0), part / F.col("all")).alias("share"))
    share = F.broadcast(share) if size <= SHARES_BYTES else share
    chance = lambda i: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), i, F.col("n")), F.lit(1 << 30)) / float(1 << 30)
    held = known.join(share, F.col("lang") == F.col("known"))
    places = F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: chance(i) < F.col("share"))
    piece = F.col("text").substr((F.col("i") * SEGMENT + 1).cast("int"), F.lit(SEGMENT))
    rows = held.withColumn("i", F.explode(places)).select("lang", "doc_id", "i", piece).collect()
    rows = sorted((r[0], r[1] is None, r[1] or 0, r[2], r[3]) for r in rows)
    return [r[4].encode() for r in rows], [r[0] for r in rows]


def identify(docs: DataFrame, usable: Column) -> DataFrame:
    """doc_id, lang_pred, score: a row per document; only those that `usable` allows, with a lang, are learnt from.

    A text that is null, empty or without a letter is UNKNOWN with score 0, as is every text where there is nothing to learn
    from; very long texts are read whole; repeated rows get equal answers; an empty table gives no rows; other columns are ignored."""
    bodies, labels = sample(docs, usable)
    langs, p = train(bodies, labels) if labels else ([], {})
    held = docs.sparkSession.sparkContext.broadcast((langs, p))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = held.value
        for group in grouped(batches, GROUP_BYTES):
            ids, bodies = columns(group, "doc_id", "text")
            bodies = [b if b and langs and has_letter(b) else b"" for b in bodies]
            prob = document_probabilities(p, bodies) if langs else np.zeros((len(bodies), 1))
            best = prob.argmax(1)
            found = [langs[k] if b else UNKNOWN for b, k in zip(bodies, best.tolist(), strict=True)]
            score = np.clip(prob[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(lean(work), SCHEMA)
