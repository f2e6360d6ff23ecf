"""Each operator against a brute-force version, on documents with every odd case, with clashing columns, and on an empty table."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import ctw, embeddings, langid, licenses, lines, lmscore, mixing, packing, quality, simhash, substrings
from tidemill.llm.queries import tokenizer_path

SPACE = r"[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return re.findall(SPACE, t or "")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=lambda r: tuple((x is None, x) for x in r))


def same(a, b):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(a, key=key) == sorted(b, key=key)


# packing
def tokens_of(cases):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x, *_ in cases]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_packing(which, cases, request):
    got = packing.pack_documents(request.getfixturevalue(which), tokenizer_path()).collect()
    want = collections.defaultdict(list)
    for d, ids in tokens_of(cases):
        want[d].append(np.array(ids, "<u4"))
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(want)
    for d, texts in want.items():
        copies = len(texts)
        assert sum(r.length for r in pieces[d]) == copies * len(texts[0])
        for r in pieces[d]:
            assert r.doc_tokens == len(texts[0]) and zlib.crc32(texts[0][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered = collections.Counter(i for r in pieces[d] for i in range(r.start, r.start + r.length))
        assert set(covered.values()) == {copies} and len(covered) == len(texts[0])
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_finds_the_best_cuts():
    rng = np.random.default_rng(0)
    for window in (16, 32):
        for _ in range(20):
            c = np.concatenate([[0], np.cumsum(rng.integers(1, 12, 25))])
            pen = rng.integers(0, 4, len(c))
            best = [0.0] + [math.inf] * (len(c) - 1)
            for j in range(1, len(c)):
                for i in range(j):
                    n = int(c[j] - c[i])
                    if n <= window:
                        best[j] = min(best[j], best[i] + (0 if n & (n - 1) == 0 else window - n) + int(pen[j]))
            path = packing.best_cuts(c, pen, window)
            cost = sum((0 if (n := int(c[b] - c[a])) & (n - 1) == 0 else window - n) + int(pen[b]) for a, b in zip(path, path[1:], strict=False))
            assert path[0] == 0 and path[-1] == len(c) - 1 and cost == best[-1]


# quality
def base(text):
    w = words(text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {k for k, n in collections.Counter(win).items() if n > 1}
    cover = {i + k for i, x in enumerate(win) if x in twice for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n") if text is not None else []:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality_rules(which, cases, request):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = quality.quality(request.getfixturevalue(which)).select(*cols).collect()
    want = [(d, *base(t)) for d, t, *_ in cases]
    same([tuple(r)[:6] for r in got], want)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert set(range(5, 40)) <= kept  # plain prose


def test_kneser_ney_sums_to_one():
    code, _ = quality.trigrams([b"the cat sat on the mat, the hat and the bat", b"another cat"])
    c, n = np.unique(code, return_counts=True)
    model = quality.KneserNey(c.astype(np.int64), n)
    for context in [*np.unique(c >> 8)[:20].tolist(), 0, 1, 65535]:
        assert np.exp(model.log_prob(context * 256 + np.arange(256))).sum() == pytest.approx(1, abs=1e-3)


def brute_surprise(bodies):
    """Modified Kneser-Ney over byte trigrams from dictionaries of counts."""
    three, two, one = collections.Counter(), collections.Counter(), collections.Counter()
    for b in bodies:
        b = b"\n\n" + b
        three.update(b[i - 2 : i + 1] for i in range(2, len(b)))
    two.update(g[1:] for g in three)
    one.update(g[1:] for g in two)

    def discounts(counts):
        k = collections.Counter(counts.values())
        y = k[1] / (k[1] + 2 * k[2])
        d = [min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.05 * i), 0.95 * i) if k[i] and k[i + 1] else 0.5 * i for i in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1] if c else 0.0

    d1, d2, d3 = discounts(one), discounts(two), discounts(three)

    def p(g):
        n1 = sum(one.values())
        p1 = (one[g[2:]] - d1(one[g[2:]])) / n1 + sum(map(d1, one.values())) / n1 / 256
        row = {k: c for k, c in two.items() if k[:1] == g[1:2]}
        n2 = sum(row.values())
        p2 = (two[g[1:]] - d2(two[g[1:]])) / n2 + sum(map(d2, row.values())) / n2 * p1 if n2 else p1
        row = {k: c for k, c in three.items() if k[:2] == g[:2]}
        n3 = sum(row.values())
        return (three[g] - d3(three[g])) / n3 + sum(map(d3, row.values())) / n3 * p2 if n3 else p2

    known = {}
    for b in bodies:
        b = b"\n\n" + b
        yield sum(-math.log(known.setdefault(b[i - 2 : i + 1], p(b[i - 2 : i + 1]))) for i in range(2, len(b))) / (len(b) - 2) if len(b) > 2 else None


def test_perplexities_bands_and_verdicts(spark):
    """Against dictionaries: every text's perplexity, and from those the bands of its language and what is kept."""
    from tests.llm.conftest import DOCUMENTS, prose

    made = [(i, prose(i, 30 + i), "en" if i % 3 else None, "s", 0) for i in range(60)]
    made += [(100 + i, " ".join(chr(65 + (i * 31 + j * j * 7) % 60) * 4 + "qzx" * (j % 3) for j in range(40)), "en", "s", 0) for i in range(3)] + [(200, None, "en", "s", 0), (201, "", None, "s", 0)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(made, DOCUMENTS)).collect()}
    want = dict(zip([m[0] for m in made], brute_surprise([(m[1] or "").encode() for m in made]), strict=True))
    for d, x in want.items():
        assert got[d].log_ppl == (pytest.approx(x, rel=1e-5) if x is not None else None)
    for lang in ("en", None):
        own = [r for r in got.values() if r.lang == lang and not r.base_failed]
        q, rare = ([sorted(x)[math.ceil(len(x) * s) - 1] for s in (0.25, 0.5, 0.75)] for x in ([r.log_ppl for r in own], [r.rarity for r in own if r.rarity is not None]))
        for r in (r for r in got.values() if r.lang == lang):
            room = max(0.06, 2 * (q[2] - q[0])) + 5 / max(1, r.n_words) ** 0.75
            most = rare[1] + 0.9 * max(1, math.sqrt(150 / max(1, r.n_words)))
            assert r.ppl_low == pytest.approx(math.exp(q[1] - room)) and r.ppl_high == pytest.approx(math.exp(q[1] + room)) and r.rarity_high == pytest.approx(most)
            assert r.kept == (not r.base_failed and q[1] - room <= r.log_ppl <= q[1] + room and r.rarity is not None and r.rarity <= most)


def test_perplexity_band_rejects_noise(spark):
    from tests.llm.conftest import DOCUMENTS, prose

    made = [(i, prose(i, 120), "en", "s", 0) for i in range(200)] + [(900, " ".join("".join(chr(33 + (i * 7919 + j * j * 31 + i * j * 17) % 94) for j in range(7)) for i in range(120)), "en", "s", 0)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(made, DOCUMENTS)).collect()}
    assert not got[900] and all(got[i] for i in range(200))


def test_words_of_no_other_document_are_rejected(spark):
    import random

    from tests.llm.conftest import DOCUMENTS, prose

    r = random.Random(5)
    made = [(i, prose(i, 150), "en", "s", 0) for i in range(200)]
    made += [(900 + i, " ".join("".join(r.sample(w, len(w))) + r.choice(["***", "$$$", " |"]) for w in prose(700 + i, 150).split()), "en", "s", 0) for i in range(6)]
    got = {x.doc_id: x for x in quality.quality(spark.createDataFrame(made, DOCUMENTS)).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[900 + i].kept for i in range(6))
    n = collections.Counter(w for d, t, *_ in made if not got[d].base_failed for w in set(words(t)))
    for d, t, *_ in made:
        own = [-math.log(max(n[w] - 1, 0.3)) for w in words(t) if re.search("[A-Za-z]", w)]
        assert got[d].base_failed or got[d].rarity == pytest.approx(sum(own) / len(own))


def test_named_holders_and_copyright_lines():
    table, own = licenses.Rules(licenses.SENTENCES, licenses.RULES), licenses.SENTENCES
    bsd = [own[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")]
    for name in ("Acme Inc.", "the University of Somewhere", "Acme Inc. and Sons"):
        held = [x.replace("the copyright holder", name).replace("THE COPYRIGHT HOLDERS", name.upper()) for x in bsd]
        text = "Copyright (c) 2019, 2020 " + name + "\nAll rights reserved.\n\n" + ":\n1. ".join(held[:1] + [". ".join(held[1:]) + "."])
        assert [x[1:] for x in table.match(text)[2]] == [("BSD-3-Clause", 5)], name
    mit = [own[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")]
    mit[3] = mit[3].replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME INC.")
    for line in ("Copyright (c) 2020 Acme Inc", "Copyright 2020-2021 Jane Doe <j@x.org>", "(c) 2020 Acme"):
        lines = [line, *re.sub(r"(.{50}\S*) ", r"\1\n", mit[0] + ": " + ". ".join(mit[1:]) + ".").split("\n")]
        for sign in ("# ", " * ", "", "// "):
            text = "\n".join(sign + x for x in lines)
            n, _, found = table.match(text)
            assert n == 5 and found == [(len(sign + line) + 1, "MIT", 4)], (sign, line, n, found)
    assert table.match("Copyright (c) 2020 Acme All rights reserved")[1] == ["all-rights"]


def test_components_go_on_until_nothing_changes(spark, monkeypatch):
    from tidemill.llm import components

    monkeypatch.setattr(components, "ROUNDS", 1, raising=False)
    path = [(i * 37 % 64, (i + 1) * 37 % 64) for i in range(63)]
    assert {r.component for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}


# line dedup
def leaves(line):
    t = [re.sub(r"^[^0-9]*[0-9].*$", "<*>", w, flags=re.DOTALL) for w in words(line)]
    k = math.ceil(len(t) * 0.7)
    return ([(len(t), *t[:k])] if len(t) >= 3 else []) + ([(len(t), "close", *t[len(t) - k :])] if len(t) >= 6 else [])


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_line_dedup(which, cases, request):
    found = collections.defaultdict(set)
    for d, t, *_ in cases:
        for line in t.split("\n") if t is not None and d is not None else []:
            for leaf in leaves(line):
                found[leaf].add(d)
    first = {k: min(v) for k, v in found.items() if len(v) >= 3}
    want = []
    for d, t, *_ in cases:
        if t is None or d is None:
            want.append((d, t, 0 if t is None else len(t.split("\n")), 0))
            continue
        parts = t.split("\n")
        kept = [x for x in parts if all(first.get(leaf, d) == d for leaf in leaves(x))]
        want.append((d, "\n".join(kept), len(parts), len(parts) - len(kept)))
    df = request.getfixturevalue(which)
    out = lines.dedup_lines(df)
    assert set(out.columns) == {*df.columns, "n_lines", "n_dropped"}
    same(rows(out, "doc_id", "text", "n_lines", "n_dropped"), want)
    assert any(w[3] for w in want)


def test_variable_fields_make_one_template(spark):
    made = [(i, f"Posted by user{i} on 2024-01-{i:02d} in the forum\nown line of document number {'x' * i} here", "en", "s", 0) for i in range(1, 6)]
    from tests.llm.conftest import DOCUMENTS

    got = {r.doc_id: r.n_dropped for r in lines.dedup_lines(spark.createDataFrame(made, DOCUMENTS)).collect()}
    assert got[1] == 0 and all(got[i] >= 1 for i in range(2, 6))


def test_fields_without_digits_are_generalised(spark):
    from tests.llm.conftest import DOCUMENTS

    names = ["anna", "boris", "chen", "dana"]
    made = [(i, f"user {n} logged in from the main office\nthe report was sent to all of {n}\nhere is {n} and not much else to say {n}", "en", "s", 0) for i, n in enumerate(names)]
    got = {r.doc_id: (r.n_dropped, r.text) for r in lines.dedup_lines(spark.createDataFrame(made, DOCUMENTS)).collect()}
    assert got[0][0] == 0 and all(got[i] == (2, f"here is {n} and not much else to say {n}") for i, n in enumerate(names) if i)


# SimHash
def brute_fingerprint(text):
    w = words(lower(text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, values, linked):
    label = dict(enumerate(range(len(ids))))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(which, cases, request):
    fps = [brute_fingerprint(t) for _, t, *_ in cases]
    comp = brute_components([c[0] for c in cases], fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = [(c[0], np.uint64(f).astype(np.int64).item(), k) for c, f, k in zip(cases, fps, comp, strict=True)]
    same(rows(simhash.near_duplicates(request.getfixturevalue(which)), "doc_id", "fp", "component_id"), want)


def test_ball_links_are_complete(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = list(centres)
    for c in centres[:20]:
        for _ in range(12):
            x = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
            fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in simhash.near_links(df).collect()]
    got = {x: x for x in fps.view(np.int64).tolist()}

    def find(a):
        while got[a] != a:
            a = got[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        got[max(a, b)] = min(a, b)
    comp = brute_components(fps.view(np.int64).tolist(), fps.tolist(), lambda a, b: (int(a) ^ int(b)).bit_count() <= 4)
    assert [find(x) for x in fps.view(np.int64).tolist()] == comp


def test_large_buckets_are_split():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 20, 300, dtype=np.uint64)
    whole = simhash.bucket_links(fp, np.zeros(300, np.int64), fp, list(range(64)), 4)
    keep, simhash.PIECE = simhash.PIECE, 5000
    try:
        parts = simhash.bucket_links(fp, np.zeros(300, np.int64), fp, list(range(64)), 4)
    finally:
        simhash.PIECE = keep
    assert set(zip(*map(np.ndarray.tolist, whole), strict=True)) == set(zip(*map(np.ndarray.tolist, parts), strict=True))


# suffix arrays
def brute_removed(cases):
    first = {}
    for d, t, *_ in cases:
        b = (t or "").encode()
        for i in range(len(b) - 49) if d is not None else ():
            w = b[i : i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t, *_ in cases:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("which", "size"), [("docs", 4_000_000), ("odd", 3000)])
def test_substrings(which, size, cases, request):
    got = substrings.remove_repeats(request.getfixturevalue(which), size)
    want = brute_removed(cases)
    assert sum(w[2] > 0 for w in want) > 5
    same(rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)


def test_two_stage_order_is_the_suffixes():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 3, 200):
        x = rng.integers(1, 1 + alphabet, 400).astype(np.uint8)
        text = np.concatenate([x, np.zeros(substrings.LENGTH + 16, np.uint8)])
        need = rng.random(400) < 0.5
        got = substrings._order(text, need)
        got = got[need[got]].tolist()
        assert sorted(got) == np.flatnonzero(need).tolist()
        cut = [x[i : i + 50].tobytes() for i in got]
        assert cut == sorted(cut)


# language-model scores
def brute_tree(streams, depth):
    """log10 probability of a byte after its context, from a dictionary of nodes and the recursion, by the decisions of a Huffman code."""
    total = collections.Counter(x for s in streams for x in s)
    by = ctw.Decisions(np.array([total[i] for i in range(256)]))
    path = [[(int(by.node[k, x]), bool(by.bit[k, x])) for k in range(by.steps) if by.node[k, x]] for x in range(256)]
    counts = collections.defaultdict(lambda: [0, 0])
    for s in streams:
        whole = b"\n" * depth + s
        for i in range(depth, len(whole)):
            for d in range(depth + 1):
                for node, bit in path[whole[i]]:
                    counts[whole[i - d : i], node][bit] += 1
    children = collections.defaultdict(set)
    for c, node in counts:
        if c:
            children[c[1:], node].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    pw, own = {}, {}
    for c, node in sorted(counts, key=lambda x: -len(x[0])):
        pe = kt(*counts[c, node])
        if len(c) == depth:
            pw[c, node], own[c, node] = pe, 1.0
        else:
            product = sum(pw[x, node] for x in children[c, node])
            pw[c, node], own[c, node] = math.log(0.5) + float(np.logaddexp(pe, product)), 1 / (1 + math.exp(min(700, max(-700, product - pe))))

    def log_p(context, x):
        out = 0.0
        for node, bit in path[x]:
            p = None
            for d in range(depth, -1, -1):
                at = context[len(context) - d :], node
                if at in counts:
                    a, b = counts[at]
                    one = (b + 0.5) / (a + b + 1)
                    p = one if p is None else own[at] * one + (1 - own[at]) * p
            p = 0.5 if p is None else p
            out += math.log10(p if bit else 1 - p)
        return out

    return log_p


@pytest.mark.parametrize(("which", "unit", "block"), [("docs", 32_000_000, 2_000_000), ("odd", 3000, 700)])
def test_lm_scores(which, unit, block, cases, request, monkeypatch):
    monkeypatch.setattr(lmscore, "UNIT", unit), monkeypatch.setattr(lmscore, "BLOCK", block)
    monkeypatch.setattr(lmscore, "MOST", 10 * unit // 3)
    df = request.getfixturevalue(which)
    got = lmscore.score(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 1, 3)
    spelt = [(d, [w.encode() for w in words(lower(t or ""))]) for d, t, *_ in cases]
    teaches = lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1
    train = collections.Counter(x for d, w in spelt if teaches(d) for x in (*w, b"\n"))
    n, v = sum(train.values()), len(train)
    streams = [(d, b" ".join(w) + b"\n") for d, w in spelt]
    log_p = brute_tree([s for d, s in streams if teaches(d)], 3)
    want = collections.defaultdict(list)
    for (d, w), (_, s) in zip(spelt, streams, strict=True):
        w = [*w, b"\n"]
        run = b"\n" * 3 + s
        want[d].append((len(w), sum(x in train for x in w), sum(math.log10((train.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(log_p(run[i - 3 : i], run[i]) for i in range(3, len(run)))))
    found = got.collect()
    assert len(found) == len(cases) and {r.train_tokens for r in found} == {n}
    for r in found:
        a = want[r.doc_id][0]
        assert (r.n_tokens, r.n_known) == a[:2]
        assert r.base_score == pytest.approx(a[2], rel=1e-9) and r.score == pytest.approx(a[3], rel=1e-5)
        assert r.held_out == (not teaches(r.doc_id))


def test_order_of_words_counts(spark):
    docs = spark.createDataFrame([(0, "up we go on and up we go on and " * 60, False), (1, "up we go on", True), (2, "go up on we", True)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r.score for r in lmscore.score(docs, F.col("held")).collect()}
    assert got[1] > got[2] + 2


def test_tree_stays_off_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 100), x -> left(md5(string(100 * id + x)), 9)), ' ')").alias("text"))
    codes = 40 * 100 * 5  # at least as many different ones of 5 bytes and the next
    sizes = []
    for name in ("toPandas", "collect"):
        monkeypatch.setattr(DataFrame, name, lambda self, f=getattr(DataFrame, name): (got := f(self), sizes.append(len(got)))[0])
    lmscore.score(docs, F.lit(False)).write.format("noop").mode("overwrite").save()
    assert sizes and max(sizes) < codes / 2


def test_five_bytes_of_context_at_every_size(spark):
    # only the fifth byte back tells what follows "zzzz"
    docs = spark.createDataFrame([(0, "azzzzx bzzzzy " * 200, False), (1, "azzzzx", True), (2, "azzzzy", True)], "doc_id long, text string, held boolean")
    five, four = ({r.doc_id: r.score for r in lmscore.score(docs, F.col("held"), *d).collect()} for d in ((), (4,)))
    assert five[2] < four[2] - 1 and five[1] > four[1]


def codes_of(pieces, depth):
    buf = np.frombuffer(b"".join(b"\n" * depth + x for x in pieces), np.uint8)
    sizes = np.array([len(x) + depth for x in pieces])
    codes = ctw.coded(buf, np.cumsum(sizes) - sizes, sizes, depth)
    return ctw.summed(codes, np.ones(len(codes), np.int64))


def test_tree_in_parts_is_the_tree():
    rng = np.random.default_rng(3)
    u, n = codes_of([bytes(rng.choice(list(b"abc"), 9)) for _ in range(300)], 4)
    whole = ctw.Tree(u, n, 4)
    keys, kt, own, below, level = ctw.levels(u, n, whole.by, 4, 2)
    top = ctw.levels(*level, whole.by, 1, 0, below)
    assert (ctw.Tree.of(whole.by, top[:3], (keys, kt, own)).slow(u) == whole.slow(u)).all()


def test_tree_is_a_distribution():
    rng = np.random.default_rng(2)
    u, n = codes_of([bytes(rng.choice(list(b"abc "), 30)) for _ in range(20)], 2)
    tree = ctw.Tree(u, n, 2)
    for context in np.unique(u >> np.uint64(8))[:10]:
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** tree.slow(every).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    kt = lambda bits: math.exp(sum(math.log((bits[:i].count(b) + 0.5) / (i + 1)) for i, b in enumerate(bits)))
    assert math.exp(ctw.log_kt(np.array([3.0]), np.array([2.0]))[0]) == pytest.approx(kt([0, 0, 1, 0, 1]))
    assert ctw.log_gamma(np.array([0.5, 5.0, 100.5])) == pytest.approx([math.lgamma(0.5), math.lgamma(5), math.lgamma(100.5)])


# mixing
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(which, cases, request):
    got = mixing.mix(request.getfixturevalue(which)).collect()
    same([(r.doc_id, r.source, r.size) for r in got], [(d, s, len(words(t))) for d, t, _, s, _ in cases])
    size = collections.Counter()
    for _, t, _, s, _ in cases:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, sum(size.values()), set(order)
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]
        if not over:
            total = sum(weight[x] for x in free)
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.discard(s)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3 and r.taken == r.copies * r.size + r.extra
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2, 0.05 * target[s]), s


def test_mixing_again_is_equal(docs):
    a, b = (rows(mixing.mix(docs.repartition(n)), "doc_id", "taken") for n in (2, 5))
    assert a == b


def test_one_rule_for_all_sizes_of_cells(spark):
    """Cells of more than CELL documents, a third of all in one; and the rates are the solution of the dual, found by halving."""
    made = spark.range(9000).selectExpr("id as doc_id", "repeat('w ', cast(if(id % 3 = 0, 7, 5 + id % 40) as int)) as text", "'en' as lang", "concat('s', id % 4) as source", "0L as n_chars")
    got = mixing.mix(made).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        sizes, target = np.array([r.size for r in own], float), own[0].target
        low, high = -200.0, 200.0
        for _ in range(200):
            tilt = (low + high) / 2
            rate = np.exp(np.minimum(tilt * sizes / sizes.mean(), math.log(3)))
            low, high = (tilt, high) if (rate * sizes).sum() < target else (low, tilt)
        assert sum(r.taken for r in own) == pytest.approx(target, abs=1)
        want, have = collections.Counter(), collections.Counter()
        for r, x in zip(own, rate, strict=True):
            want[r.size] += x
            have[r.size] += r.copies
        assert all(abs(want[z] - have[z]) <= 1.01 for z in want)


def test_targets_of_many_sources(spark):
    sizes = [(f"s{i:04d}", f"{i:04d}", 1 + (i * 7919) % 1000) for i in range(500)] + [("n", None, 77)]
    got = {r.key: r.target for r in mixing.targets(spark.createDataFrame(sizes, "key string, source string, source_size long")).collect()}
    order = [k for k, *_ in sizes]
    weight, size = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}, {k: n for k, _, n in sizes}
    left, free = sum(size.values()), set(order)
    while over := [k for k in free if left * weight[k] / sum(weight[x] for x in free) > 3 * size[k]]:
        for k in over:
            assert got[k] == pytest.approx(3 * size[k])
            left -= 3 * size[k]
            free.discard(k)
    total = sum(weight[k] for k in free)
    assert all(got[k] == pytest.approx(left * weight[k] / total) for k in free)


def test_rates_are_tilted(spark):
    from tests.llm.conftest import DOCUMENTS, prose

    made = [(i, prose(i, 20 + i % 90), "en", f"s{i % 4}", 0) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(made, DOCUMENTS)).collect()
    big = [r for r in got if r.source == "s2"]  # weight 1: fewer words than it has
    half = sorted(big, key=lambda r: r.size)
    short, long = half[:50], half[-50:]
    rate = lambda x: sum(r.copies for r in x) / len(x)
    assert rate(short) > rate(long)


# vectors
def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 24))
    near = np.repeat(x[:8], 6, 0) + rng.normal(size=(48, 24)) * 0.12
    v = np.concatenate([x, near, x[:3], x[:2] * 2]).astype(np.float32)
    made = [(i, [float(a) for a in row]) for i, row in enumerate(v)]
    made += [(500, None), (501, [0.0] * 24), (502, [float("nan")] * 24), (503, [1.0, None] + [0.0] * 22), (504, [float("inf")] + [0.0] * 23), (505, []), (506, [1.0, 0.0]), (507, [2.0, 0.0])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    ids, rows_ = [m[0] for m in made], [m[1] for m in made]

    def linked(a, b):
        if a is None or b is None or len(a) != len(b) or not a or any(z is None or not math.isfinite(z) for z in (*a, *b)) or not any(a) or not any(b):
            return False
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95

    comp = brute_components(ids, rows_, linked)
    want = [(i, sum(linked(r, q) for j, q in enumerate(rows_) if j != k), c, i == c) for k, (i, r, c) in enumerate(zip(ids, rows_, comp, strict=True))]
    same(rows(embeddings.near_vectors(df), "vec_id", "n_links", "component_id", "kept"), want)
    assert sum(w[1] for w in want) > 100
    keep, embeddings.CELL = embeddings.CELL, 5
    try:
        same(rows(embeddings.near_vectors(df), "vec_id", "n_links", "component_id", "kept"), want)
    finally:
        embeddings.CELL = keep


def test_vectors_in_doubles_and_with_shared_ids(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 10))
    v = np.concatenate([x, x[:15] + rng.normal(size=(15, 10)) * 0.02, x[:5] * 1e-170, x[:5] * 1e160, x[:3]])
    made = [(i % 30 if i % 4 else None if i == 8 else i, [float(a) for a in row]) for i, row in enumerate(v)]
    made += [(200, [1e-60, 0.0]), (201, [1e-60, 0.0]), (202, [1e60, 0.0]), (203, [1.0, 0.0]), (1, [1.0, math.sqrt(1 / 0.95**2 - 1) * (1 + 1e-9)])]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "vector": F.lit(2), "m": F.lit(3), "root": F.lit(4)})

    def linked(a, b):
        (i, a), (j, b) = a, b
        if i is None or j is None or len(a) != len(b):
            return False
        a, b = (np.array(z) / np.abs(z).max() for z in (a, b))
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95

    comp = brute_components([m[0] for m in made], made, linked)
    want = [(m[0], sum(linked(m, q) for j, q in enumerate(made) if j != k), c, m[0] == c) for k, (m, c) in enumerate(zip(made, comp, strict=True))]
    want = [w if w[0] is not None else (None, 0, None, True) for w in want]
    same(rows(embeddings.near_vectors(df), "vec_id", "n_links", "component_id", "kept"), want)
    assert {w[1] for w in want if w[0] in (200, 201, 202, 203)} == {3}


# licences
def test_licences(docs, cases):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(licenses.scan(docs).collect()) == len(cases) and not any(r.licenses for r in got.values())


def test_notices_and_full_texts():
    table = licenses.Rules(licenses.SENTENCES, licenses.RULES)
    found = lambda t: [x[1] for x in table.match(t)[2]]
    assert all(table.match(s)[1] for s in licenses.SENTENCES.values())
    for text, want in {
        "This file is released under the MIT License.": ["MIT"], "The code is licensed under the Apache License, Version 2.0.": ["Apache-2.0"], "Everything else here is prose. These tables are made available under the terms of the GNU GPL v3.": ["GPL-3.0-only"],
        "All of the code in this project is distributed under the Boost Software License 1.0": ["BSL-1.0"], "SPDX-License-Identifier: MIT": ["MIT"], "mit": [],
        "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0-or-later"], "// SPDX-License-Identifier: BSL-1.0\n#include <x>": ["BSL-1.0"], "SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND MIT": ["GPL-2.0-or-later", "MIT"], "SPDX-License-Identifier: LicenseRef-x": [],
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"], "Dual licensed under the MIT and GPL v2 licenses.": ["GPL-2.0-only", "MIT"], "Licensed under MIT supervision.": [], "It is not licensed under the MIT License.": [],
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.": ["EPL-2.0"], "This is distributed under the terms of the GPL version 3 or, at your option, any later version.": ["GPL-3.0-or-later"],
        "The whole of the very large program that we and many other people have been writing for years is licensed under the MIT License.": ["MIT"], "We like the MIT License.": [], "It is licensed under terms that nobody knows.": [],
        licenses.SENTENCES["mit-grant"] + " " * 1800: ["MIT"], " " * 5000 + licenses.SENTENCES["mit-grant"].replace(" ", " " * 20): ["MIT"],
        "        GNU GENERAL PUBLIC LICENSE\n          Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n      Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n": ["GPL-3.0-only"],
    }.items():
        assert found(text) == want, text[:60]


def brute_licences(text):
    """Every rule at every place, longest rules first, by plain recursion over the sentences."""
    table = licenses.Rules(licenses.SENTENCES, licenses.RULES)
    units = [(i, place, table.known.get(s, [])) for i, place, s in table.units(text)]
    known = [u for u in units if u[2]]
    free, out = [True] * len(known), []

    def follow(ids, k, chain):
        if len(chain) == len(ids):
            return chain
        if k == len(known) or chain and known[k][0] - known[chain[-1]][0] > licenses.GAP + 1:
            return None
        if free[k] and ids[len(chain)] in known[k][2]:
            return follow(ids, k + 1, [*chain, k])
        return follow(ids, k + 1, chain) if chain else None

    for name, ids in table.rules:
        for k in range(len(known)):
            chain = follow(ids, k, [])
            if chain:
                for c in chain:
                    free[c] = False
                out.append((known[k][1], name, len(ids)))
    return len(units), [u[2][0] for u in known], sorted(out)


def test_licence_rules_against_brute_force(spark):
    import random

    from tests.llm.conftest import DOCUMENTS, prose

    r, pool = random.Random(1), [*licenses.SENTENCES.values()]
    made = []
    for i in range(60):
        parts = [r.choice(pool) if r.random() < 0.7 else prose(i + k, 6) for k in range(12)]
        for _, ids in r.sample(licenses.RULES, 2):
            at = r.randrange(12)
            parts[at:at] = [x for k in ids for x in (licenses.SENTENCES[k], *([prose(len(k), 5)] * (r.random() < 0.3)))]
        made.append((i, ". ".join(parts) + ".", "en", "s", 0))
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(made, DOCUMENTS)).collect()}
    for i, text, *_ in made:
        n, known, hits = brute_licences(text)
        assert (got[i].n_sentences, got[i].sentence_ids) == (n, known)
        assert list(zip(got[i].starts, got[i].licenses, got[i].rule_sizes, strict=True)) == hits
    assert sum(len(x.licenses) for x in got.values()) > 100


def test_licence_columns(odd, cases):
    got = licenses.scan(odd).collect()
    assert len(got) == len(cases) and not any(x.licenses for x in got) and {x.doc_id: x.n_sentences for x in got}[51] == 0


def test_licence_rules(spark, cases):
    from tests.llm.conftest import DOCUMENTS

    s = licenses.SENTENCES
    mit = f"Widget\n\nMIT License\n\nCopyright (c) 2020 A. Body\n\n{s['mit-grant']}:\n\n{s['mit-notice']}.\n\n{s['mit-warranty']}. {s['mit-liability'].replace(' OR ', chr(10) + 'OR ', 3)}.\n"
    bsd3 = f"{s['bsd-grant']}:\n\n1. {s['bsd-source']}.\n2. {s['bsd-binary']}.\n3. {s['bsd-endorse']}.\n\n{s['bsd-warranty']}."
    bsd2 = f"{s['bsd-grant']}:\n\n * {s['bsd-source']}.\n * {s['bsd-binary']}.\n\n{s['bsd-warranty']}."
    out_of_order = f"{s['bsd-binary']}. {s['bsd-source']}. {s['bsd-grant']}."
    made = [(1, mit), (2, bsd3), (3, bsd2), (4, out_of_order), (5, "text about it.\nReleased under the MIT License.\nmore text"), (6, "Licenced under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0."), (7, "we like the MIT License a lot"), (8, None), (9, "")]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame([(d, t, "en", "s", 0) for d, t in made], DOCUMENTS)).collect()}
    assert got == {1: ["MIT", "MIT"], 2: ["BSD-3-Clause"], 3: ["BSD-2-Clause"], 4: [], 5: ["MIT"], 6: ["CC-BY-NC-4.0", "Apache-2.0"], 7: [], 8: [], 9: []}


# language identification
def test_language_gradients():
    rng = np.random.default_rng(0)
    x, filled, doc = langid.segments([b"abc" * 5, b"hello wor", b"xyz"])
    y = np.array([0, 1, 2])[doc]
    p = {k: v.astype(np.float64) for k, v in langid.initial(3, rng).items()}
    loss, grad = langid.gradients(p, x[:20], np.minimum(filled, 20), y)
    for k in ("fer", "fun", "buz", "bw", "ben", "fur", "b"):
        g = np.argmax(np.abs(grad[k]))
        eps, old = 1e-3, p[k].flat[g]
        p[k].flat[g] = old + eps
        up = langid.gradients(p, x[:20], np.minimum(filled, 20), y)[0]
        p[k].flat[g] = old - eps
        down = langid.gradients(p, x[:20], np.minimum(filled, 20), y)[0]
        p[k].flat[g] = old
        assert (up - down) / (2 * eps) == pytest.approx(grad[k].flat[g], rel=2e-2, abs=1e-4), k


def test_language_probabilities_are_those_of_plain_steps():
    """Byte by byte, unit by unit, against the network's definition; segments start anew, texts of several segments too."""
    rng = np.random.default_rng(5)
    p = langid.initial(3, rng)
    bodies = [b"", b"short", bytes(rng.integers(1, 255, langid.SPAN + 300).astype(np.uint8)), b"another text, a little longer"]
    got = langid.document_probabilities(p, bodies)
    sig = lambda v: 1 / (1 + math.exp(-v))
    q = {k: v.astype(float).tolist() for k, v in p.items()}

    def states(text, d):
        h, out = [0.0] * langid.UNITS, []
        for x in text:
            dot = lambda g: [sum(h[i] * q[f"{d}u{g}"][i][j] for i in range(langid.UNITS)) for j in range(langid.UNITS)]  # noqa: B023, E731
            r, z, m = ([sig(a + b) for a, b in zip(q[f"{d}e{g}"][x], dot(g), strict=True)] if g != "n" else dot("n") for g in "rzn")
            n = [math.tanh(a + b * c) for a, b, c in zip(q[f"{d}en"][x], r, m, strict=True)]
            h = [b + c * (a - b) for a, b, c in zip(h, n, z, strict=True)]
            out.append(h)
        return out

    for i, b in enumerate(bodies):
        total = np.zeros(3)
        for at in range(0, len(b), langid.SPAN):
            part = b[at : at + langid.SPAN]
            for f, g in zip(states(part, "f"), states(part[::-1], "b")[::-1], strict=True):
                e = np.exp(np.array(f) @ p["fw"] + np.array(g) @ p["bw"] + p["b"])
                total += e / e.sum()
        assert got[i] == pytest.approx(total / max(1, len(b)), abs=1e-4)


def test_training_sample_is_of_whole_texts_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANG", 300)
    monkeypatch.setattr(langid, "SAMPLE", 22 * 300)
    text = "".join(chr(97 + i // 1000) for i in range(20000))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.when(F.col("id") < 40, F.concat(F.lit("l"), (F.col("id") % 2).cast("string"))).otherwise(F.concat(F.lit("m"), F.col("id").cast("string"))).alias("lang"))
    bodies, labels = langid.sample(docs, F.lit(True))
    n = collections.Counter(labels)
    assert len(n) == 22 and all(200 < k < 420 for k in n.values())  # two languages of many texts and twenty of one
    assert {b[:1] for b in bodies} == {bytes([97 + i]) for i in range(20)}


def test_language_held_out(spark):
    from tests.conftest import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    crc = F.crc32(F.col("doc_id").cast("string")) % 4
    got = langid.identify(docs, crc != 2).join(docs.select("doc_id", "lang"), "doc_id").where(crc == 2).collect()
    assert len(got) > 30 and sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_cases(odd, cases, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 20)
    got = langid.identify(odd, F.lit(True)).collect()
    assert len(got) == len(cases)
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert found[50] == found[51] == found[52] == found[53] == ("und", 0.0)
    assert found[54][0] in ("en", "de") and found[80][0] in ("en", "de")


# all of them on a table without rows
@pytest.mark.parametrize("f", [
    lambda d: packing.pack_documents(d, tokenizer_path()), quality.quality, lines.dedup_lines, simhash.near_duplicates, substrings.remove_repeats, licenses.scan, mixing.mix,
    lambda d: lmscore.score(d, F.lit(False)), lambda d: langid.identify(d, F.lit(True)),
    lambda d: embeddings.near_vectors(d.select(F.col("doc_id").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"))),
])
def test_empty_table(f, empty):
    assert f(empty).collect() == []


def test_nothing_to_learn_from(docs, cases):
    got = langid.identify(docs, F.lit(False)).collect()
    assert {r.lang_pred for r in got} == {"und"}
    got = lmscore.score(docs, F.lit(True)).collect()
    assert len(got) == len(cases) and {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}
    assert all(math.isfinite(r.score) and abs(r.base_score) < 1e-6 for r in got)
