import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was that for with as on at by an be this from or which had not are but have were one all they you her she".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS) + r.choice(["", "ing", "ed", "ly", "tion"]) * (r.random() < 0.6)
        out.append(w + ("." if i % 9 == 8 else "") + ("\n" if i % 27 == 26 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def cases():
    """Documents with every odd case: null and empty texts, blanks, a very long text, copies, near copies, repeated rows, null columns, other scripts."""
    long = prose(1, 30000)
    passage = prose(2, 70)
    rows = [(i, prose(100 + i, 40 + 7 * i), "en" if i % 3 else "de", f"src{i % 5}") for i in range(40)]
    rows += [(50, None, "en", "src0"), (51, "", "en", "src0"), (52, " \n\t ", None, "src1"), (53, "...", "fr", None), (54, long, "en", "src1"), (55, long, "en", "src2")]
    rows += [(60 + i, prose(7, 200).replace("the", "teh", i % 2), "en", "src3") for i in range(6)]
    rows += [(70 + i, prose(300 + i, 30) + "\n" + passage + "\n" + prose(400 + i, 30), "en", "src4") for i in range(5)]
    rows += [(80, "Ünïcödé naïve ÀÉ — 漢字 かな 한국어", None, "src0"), (81, "\x1cword\x1d two three four", "en", "src0"), (82, "one", "en", "src0"), (83, "aaaa" * 100, "en", "src0"), (84, "a b " * 100, "en", "src0")]
    rows += [(90, "repeated row " * 20, "en", "src0")] * 2 + [(None, "a row without an id, but with some words", "en", "src0")]
    return [(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame(cases, DOCUMENTS).repartition(3).persist()


@pytest.fixture(scope="session")
def odd(docs):
    """The same with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ["score", "n_words", "kept", "key", "size", "chunk", "fp", "h", "d", "keep", "pos", "line", "leaf", "bucket", "held", "copies", "component_id", "__id", "words", "target"]
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], T.StructType.fromDDL(DOCUMENTS))
