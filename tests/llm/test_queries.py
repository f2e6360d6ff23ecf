"""The registered queries: a row per document or piece, the columns asked for, and SQL where there is some."""

import duckdb
import pytest

from tests.conftest import DATA
from tidemill.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_embeddings": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op3_licenses": {"doc_id": "bigint"},
    "op4_lines": {"doc_id": "bigint"},
    "op5_quality": {"doc_id": "bigint", **dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"), "base_failed": "boolean", "kept": "boolean"},
    "op6_packing": dict.fromkeys(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), "bigint"),
    "op7_substrings": {**dict.fromkeys(("doc_id", "n_bytes", "n_removed", "n_spans"), "bigint"), "kept_sha256": "string"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_lmscore": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op11_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op12_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13_tokens": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}
KEYS = {"op2_embeddings": ("embeddings", "vec_id"), "op11_search": ("benchmark", "item_id"), "op12_clusters": ("embeddings", "vec_id")}


@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark):
    df = QUERIES[name](spark, DATA)
    kinds = dict(df.dtypes)
    assert all(kinds[c] == k for c, k in COLUMNS[name].items())
    of, key = KEYS.get(name, ("documents", "doc_id"))
    want = sorted(r[0] for r in spark.read.parquet(f"{DATA}/{of}.parquet").select(key).collect())
    got = [r[0] for r in df.select(key).collect()]
    assert sorted(set(got) if name in ("op6_packing", "op11_search") else got) == want
    if name == "op8_simhash":
        assert all(len(r.fingerprint) == 16 and int(r.fingerprint, 16) >= 0 and r.fingerprint == r.fingerprint.lower() for r in df.collect())


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_equals_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLE_SQL[name])
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
