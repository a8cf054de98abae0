"""The registered queries on the smallest tables against plain versions of their contracts."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from test_dedup_and_join import brute
from test_tokens_and_packing import library

from tidemark.llm import jaccard, queries

DATA = os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet'").fetchall())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, docs):
    rows, encode = queries.op1_packing(spark, DATA).toPandas(), library("word_bpe_49k.json")
    assert set(rows.doc_id) == set(docs)
    for i, pieces in rows.sort_values("start").groupby("doc_id"):
        ids = [*encode(docs[i]), 1]
        assert (pieces.doc_tokens == len(ids)).all() and pieces.start.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]] and pieces.length.sum() == len(ids)
        assert [crc(ids[s : s + n]) for s, n in zip(pieces.start, pieces.length, strict=True)] == pieces.ids_crc32.tolist()
    total = rows.groupby("sequence_id").length.sum()
    assert ((total == 2048) | (total & (total - 1) == 0)).all()


def test_op3(spark, docs):
    rows, encode, at = queries.op3_token_store(spark, DATA).toPandas().sort_values("doc_id"), library("byte_bpe_50k.json"), 0
    assert rows.doc_id.tolist() == sorted(docs)
    for r in rows.itertuples():
        ids = [*encode(docs[r.doc_id]), 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def test_op5(spark, docs):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in queries.op5_jaccard_join(spark, DATA).collect()), key=str)
    assert got == brute(list(docs.items()), jaccard.Similarity())


def test_op9(spark):
    duckdb.sql(f"create or replace view documents as select * from '{DATA}/documents.parquet'")
    want = duckdb.sql(queries.OP9_SQL).df()
    got = queries.op9_exact_dedup(spark, DATA).toPandas()
    order = lambda x: sorted(map(tuple, x[["doc_id", "keep_id", "group_size", "kept", "text_sha256"]].itertuples(index=False)))
    assert order(got) == order(want)


def test_op10(spark, docs):
    for r in queries.op10_media(spark, DATA).collect():
        data = docs[r["doc_id"]].encode()
        payload = data.ljust(192 * max(1, -(-len(data) // 192)))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_bytes"] > r["payload_bytes"] and r["bad_checks"] == 0 and r["n_samples"] == 1152 * r["n_frames"]


@pytest.mark.parametrize("name", ["op2_language_id", "op4_pii", "op6_url_filter", "op7_toxicity", "op8_sentencepiece"])
def test_one_row_for_each(spark, docs, name):
    rows = queries.queries()[name](spark, DATA).toPandas()
    pages = duckdb.sql(f"select count(*) from '{DATA}/pages.parquet'").fetchall()[0][0]
    assert len(rows) == {"op2_language_id": len(docs) + pages, "op6_url_filter": pages}.get(name, len(docs))
    if name == "op8_sentencepiece":
        assert rows.parity.all() and rows.round_trip.all()
    if name == "op7_toxicity":
        assert ((rows.score >= 0.7).astype(int) == rows.predicted).all() and (rows.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in rows.doc_id]).all()
