"""Ranked search, centroid clusters and token counts against brute force, with the odd cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import clusters, search, tokencount

ITEMS = "item_id long, text string, rank int, score double"


def found_terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k):
    held = [(d, found_terms(t)) for d, t in docs]
    held = [(d, len(t), Counter(t)) for d, t in held if t]
    n_docs, n_terms = len(held), sum(n for _, n, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item_id, text in sorted(set(items), key=repr):
        own, scored = set(found_terms(text)), []
        for d, n, c in held:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item_id, r, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark, cases):
    rows = [(i, t[:300] if t else t) for i, (_, t, *_) in enumerate(cases[:12])]
    rows += [(100, None), (101, ""), (102, "... --- !"), (103, "zzqx unheard"), (104, "one"), (104, "漢字 Ünïcödé THE"), (105, "the the of"), (105, "the the of"), (None, "she her of one"), (106, cases[44][1])]
    return rows, spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], ITEMS)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_is_brute_force(spark, cases, odd, items, k):
    rows, df = items
    got = search.ranked_search(odd, df, k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(c[0], c[1]) for c in cases], rows, k)


def test_search_in_blocks(spark, cases, docs, items, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 4000)
    rows, df = items
    assert len(list(search.blocks(df))) > 2
    assert sorted(map(tuple, search.ranked_search(docs, df, 5).collect()), key=repr) == brute([(c[0], c[1]) for c in cases], rows, 5)


def test_search_of_nothing(spark, docs, empty, items):
    assert search.ranked_search(empty, items[1]).count() == 0
    assert search.ranked_search(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert search.ranked_search(docs.where("doc_id IN (50, 51)"), items[1]).count() == 0


def test_tails_make_no_candidates():
    """A common term stays out of the candidates once a rare one is held by k documents, and adds to their scores all the same."""
    p = search.Plan([[0, 1], [1]], np.array([9000, 10]), np.array([100, 100]), np.array([90, 90]))
    assert p.floor.tolist() == [810_000, 900] and p.rest.tolist() == [1000, 0]
    row, term, q = np.array([0, 0, 1]), np.array([0, 1, 1]), np.array([95, 50, 100])
    assert p.sums(p.lead, row, term, q, 2).tolist() == [[855_000, 500], [0, 1000]]
    assert p.sums(p.tail, row, term, q, 2).tolist() == [[500, 0], [1000, 0]]


VECTORS = "vec_id long, embedding array<double>, cluster int, n long"


def lloyd(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * int(v)) if abs(v) > 2**60 else math.floor(1024 * v) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    cent = [x for _, x in first]
    for r in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cent)) for _, x in kept]
        if r < rounds:
            for j in range(len(cent)):
                mine = [x for (_, x), (_, o) in zip(kept, own) if o == j]
                if mine:
                    cent[j] = [sum(col) // len(mine) for col in zip(*mine)]
    most = (1 << 63) - 1
    total = sum(min(d, most) for d, _ in own)
    return sorted(
        ((i, j, min(d, most), min(most, sum(min(e, most) for e, o in own if o == j)), min(most, total), hashlib.sha256(",".join(map(str, cent[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own)),
        key=repr,
    )


@pytest.mark.parametrize("wide", [False, True])
def test_clusters_are_lloyds(spark, wide):
    r = random.Random(5)
    rows = [(i, [r.gauss(3 * (i % 4), 1) for _ in range(4)]) for i in range(60)]
    rows += [(70, None), (71, [1.0, 2.0]), (72, [1.0, None, 0.0, 0.0]), (73, [float("nan")] * 4), (74, [float("inf"), 0.0, 0.0, 0.0]), (75, []), (76, [0.0] * 4), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (80, rows[5][1])]
    if wide:
        rows += [(90, [1e30, -1e30, 2.0**61, 0.5]), (91, [-3e5, 3e5, 1.25, 0.0]), (92, [1.7e305, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], VECTORS).repartition(3)
    got = clusters.clusters(df, k=5, rounds=10, dims=4)
    assert sorted(map(tuple, got.collect()), key=repr) == lloyd(rows, 5, 10, 4)
    assert not [t for t in spark.catalog.listTables() if "round" in t.name or "vectors" in t.name]


def test_clusters_of_few(spark):
    rows = [(i, [float(i), -float(i)]) for i in range(3)] + [(9, [0.0, 0.0]), (10, [0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], VECTORS)
    assert sorted(map(tuple, clusters.clusters(df, dims=2).collect()), key=repr) == lloyd(rows, 8, 10, 2)
    assert clusters.clusters(df.limit(0), dims=2).count() == clusters.clusters(df).count() == 0
    assert clusters.clusters(df.withColumn("vec_id", F.lit(None).cast("long")), dims=2).count() == 0


def test_clusters_of_many_components(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 9) for _ in range(70)]) for i in range(30)]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], VECTORS)
    assert sorted(map(tuple, clusters.clusters(df, k=3, dims=70).collect()), key=repr) == lloyd(rows, 3, 10, 70)


def test_limbs_add_up():
    for v in (0, 1, -1, 1 << 40, -(1 << 200) + 17, (1 << 80) - 1):
        assert sum(d << (clusters.LIMB * i) for i, d in enumerate(clusters.limbs(v))) == v


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_are_the_librarys(spark, cases, odd, model):
    encode = tokencount.Pieces(model).model.encode
    want = sorted(((d, len((t or "").encode()), n := len(encode(t or "")), n > 300) for d, t, *_ in cases), key=repr)
    got = tokencount.count_tokens(odd, model, limit=300)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(w[3] for w in want) and not all(w[3] for w in want)


def test_token_counts_of_nothing(empty, model):
    assert tokencount.count_tokens(empty, model).count() == 0


def test_cuts_are_exact(model, monkeypatch):
    """Texts of signs at which a cut could go wrong, with a cache so small that generations change all the time."""
    monkeypatch.setattr(tokencount, "CACHE", 50)
    monkeypatch.setattr(tokencount, "LONG", 6)
    r, signs = random.Random(2), list(" ▁\n\t\r abcdeABthe  ing.,é漢字'0123<s></s>\x00　 😀<0x0A>")
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(5000)] + ["", " ", "▁", "\n", "x" * 5000, " " * 100, "\n" * 50]
    pieces = tokencount.Pieces(model)
    lookup = tokencount.Lookup(pieces, {" the": 1, "\n": 1})
    assert lookup.counts(texts) == [len(x) for x in pieces.model.encode(texts)]
    assert len(lookup.young) <= 50 and len(lookup.old) <= 50


def test_the_table_holds_frequent_units(spark, docs, model):
    table = tokencount.frequent(docs, model)
    pieces = tokencount.Pieces(model)
    assert " the" in table and all(len(u) <= tokencount.LONG for u in table)
    assert [table[u] for u in list(table)[:200]] == pieces.lengths(list(table)[:200])
