"""The pipeline against its operators' definitions, stage by stage, and on odd and empty tables."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_operators import SPACE, brute_components, lower, words


DONE = {}


def run(spark, docs, n):
    """What the first n stages make of docs; each is run once."""
    made = DONE.setdefault(id(docs), [docs])
    while len(made) <= n:
        made.append(P.STAGES[len(made) - 1][1](spark, made[-1], "").persist())
    return made[n]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_stages_return_documents(spark, odd, n):
    assert run(spark, odd, n).columns == P.COLUMNS


def test_quality_and_lines(spark, docs, cases):
    one = {r.doc_id: r.text for r in run(spark, docs, 1).collect()}
    given = {d: t for d, t, *_ in cases}
    assert all(given[d] == t for d, t in one.items()) and not {50, 51, 52, 53, 82, 83, 84} & set(one)
    two = {r.doc_id: r for r in run(spark, docs, 2).collect()}
    assert set(two) <= set(one) and 70 in two
    for d, r in two.items():
        assert set(r.text.split("\n")) <= set(one[d].split("\n")) and r.n_chars == len(r.text)


def shingled(text):
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset([()])


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_one_of_each_group_stays(spark, docs):
    two, three = run(spark, docs, 2).collect(), run(spark, docs, 3).collect()
    sets = {r.doc_id: shingled(r.text) for r in two}
    left = sorted(r.doc_id for r in three)
    assert len(left) == len(set(left)) and 55 not in left and 54 in left
    for d in set(sets) - set(left):
        assert any(alike(sets[d], sets[k]) for k in sets if k != d)
    assert not any(alike(sets[a], sets[b]) for a in left for b in left if a < b)


def test_near_copies_are_found(spark):
    """Edited copies of 0.8 and more against brute force, in a group of many; one edit in 45 words is the limit."""
    import random

    from tests.llm.conftest import DOCUMENTS, prose
    from tidemill.llm import nearcopies

    r, made = random.Random(4), []
    for i in range(60):
        base = [w + str(r.randrange(50)) for w in prose(2000 + i, 120 + 5 * i).split()]
        for k in range(6 if i else 200):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 40)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            made.append((len(made), " ".join(w), "en", "s", 0))
    got = {x.doc_id: x.component_id for x in nearcopies.near_copies(spark.createDataFrame(made, DOCUMENTS).repartition(7)).collect()}
    sets = [shingled(m[1]) for m in made]
    want = brute_components(list(range(len(made))), sets, alike)
    assert sum(got[i] != c for i, c in enumerate(want)) <= 0.05 * len(made)
    assert all(want[got[i]] == c for i, c in enumerate(want))  # nothing is put together that is not linked


def test_rest_leaves_no_link_between_components(spark):
    """Sets of all sizes, many around one, against all pairs; with nothing linked before, and with some of the links known."""
    import random

    from tidemill.llm import nearcopies

    r, sets = random.Random(5), []
    for k in range(12):
        base = [r.randrange(10**9) for _ in range(r.choice([1, 2, 5, 9, 10, 35, 120]))]
        for _ in range(60 if k == 0 else 9):
            sets.append(sorted({x if r.random() > r.choice([0, 0.05, 0.12, 0.3]) else r.randrange(10**9) for x in base}))
    sets += [sets[0], sets[70], []]
    held = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<long>").repartition(5)
    near = lambda a, b: bool(a or b) and alike(set(a), set(b))
    links = {(a, b) for b in range(len(sets)) for a in range(b) if near(sets[a], sets[b])}
    assert len(links) > 100
    for known in (set(), set(sorted(links)[::3])):
        label = nearcopies.components(spark.createDataFrame(sorted(known), "a long, b long"))
        of = {x.node: x.component for x in label.collect()}
        got = {(x.a, x.b) for x in nearcopies.rest(held, label, 0.8).collect()}
        left = {(a, b) for a, b in links if of.get(a, a) != of.get(b, b)}
        assert left <= got and all(a < b and of.get(a, a) != of.get(b, b) for a, b in got)
        assert {(x.a, x.b) for x in nearcopies.checked(nearcopies.rest(held, label, 0.8), held, 0.8).collect()} == left


def odd_rows():
    from tests.llm.conftest import prose

    made = [(d, prose(900 + k, 80), "en", "s", 0) for k, d in enumerate((None, None, None, 7, 7, 8))]
    return made, [*made, (None, made[3][1], "en", "s", 0), made[0], (9, None, "en", "s", None), (9, "", "en", "s", 0), (8, made[5][1], "de", None, 0)]


def test_rows_without_an_id_of_their_own_stay(spark):
    from tests.llm.conftest import DOCUMENTS

    made, given = odd_rows()
    docs = spark.createDataFrame(given, DOCUMENTS)
    left = [(r.doc_id, r.text) for r in P.near_dedup(spark, docs, "").collect()]
    assert len(left) == 7 and set(left) - {(9, None), (9, "")} == {r[:2] for r in made}
    # one source: every row with words as often as it is there
    mixed = [(r.doc_id, r.text) for r in P.source_mixing(spark, docs.withColumn("source", F.lit("s")), "").collect()]
    assert collections.Counter(mixed) == collections.Counter(r[:2] for r in given if r[1])
    same = lambda rows: collections.Counter((r[0], r[1], r[2]) for r in rows)
    assert same(P.quality_rules(spark, docs, "").collect()) <= same(given)
    assert same(P.line_dedup(spark, docs, "").collect()) <= same(given)


def test_quality_is_a_matter_of_rows(spark):
    """Rows of one id, or none, stay or go by their own text."""
    from tests.llm.conftest import DOCUMENTS, prose

    good, bad = [prose(700 + i, 120) for i in range(60)], "too short"
    given = [(None if i % 2 else 5, t, "en", "s", 0) for i, t in enumerate(good)] + [(None, bad, "en", "s", 0), (5, bad, "en", "s", 0)]
    got = collections.Counter((r.doc_id, r.text) for r in P.quality_rules(spark, spark.createDataFrame(given, DOCUMENTS), "").collect())
    assert got == collections.Counter(r[:2] for r in given[:60])


def test_mixing_and_packing(spark, docs):
    three, four = run(spark, docs, 3).collect(), run(spark, docs, 4).collect()
    size = {r.doc_id: len(words(r.text)) for r in three}
    taken = collections.Counter()
    for r in four:
        taken[r.doc_id] += len(words(r.text))
    assert all(taken[d] <= 3 * size[d] for d in taken)
    assert abs(sum(taken.values()) - sum(size.values())) <= 0.05 * sum(size.values())
    pieces = run(spark, docs, 5).collect()
    assert {r.doc_id for r in pieces} == set(taken)
    assert sum(r.length for r in pieces if r.start == 0) > 0 and re.compile(SPACE)


def test_empty(spark, empty):
    assert run(spark, empty, 5).collect() == []


def test_run_is_the_stages(spark):
    from tests.conftest import DATA

    got = P.run(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = run(spark, docs, 5)
    count = lambda df: collections.Counter((r.doc_id, r.length) for r in df.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "length").collect())
    assert count(got) == count(want)
