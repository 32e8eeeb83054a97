"""The registered queries on the smallest tables: against DuckDB where SQL can express them, and their columns."""

import math
import os

import duckdb
import numpy as np
import pytest

from optrail.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
COLUMNS = {
    "op1_mih": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_chunks": {"doc_id": "bigint"},
    "op3_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_mixing": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_caps": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op11_perplexity": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op12_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13_sweep": {"nation_id": "int", "from_s": "bigint", "to_s": "bigint", "n_open": "bigint", "open_cents": "bigint", "high_open": "bigint", "is_peak": "boolean"},
}


def plain(rows):
    tidy = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x
    return sorted((tuple(map(tidy, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if name not in ORACLES:
        assert df.count() > 0
        return
    con = duckdb.connect()
    for table in os.listdir(DATA):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{table}'")
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.select(columns).collect())) == plain(want)


def test_recall_of_the_search(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = QUERIES["op1_mih"](spark, "/root/testdata/sf0.01").collect()
    hits = wanted = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len({r.vec_id for r in got if r.query_id == q} & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        wanted += 10
    assert hits / wanted >= 0.9
