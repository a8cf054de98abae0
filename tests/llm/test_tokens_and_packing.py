import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from common_rows import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, queries, token_store
from tidemark.llm.segments import _Table, encoder

FILES = [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)]
ALPHABET = "abAB19 .,!'\n\t éÉß×÷ñ‚あ\u00a0\u3000x\x1c\x85ÿ·\u0301sStTre<|>"


def library(name):
    t = Tokenizer.from_file(queries.tokenizer(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ours(name, byte_level, texts):
    out = []
    for _, flat, at in encoder(queries.tokenizer(name), byte_level).columns(pa.array(texts, pa.string())):
        out += [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


@pytest.mark.parametrize(("name", "byte_level"), FILES)
@settings(max_examples=200, deadline=None)
@given(text=st.text(ALPHABET, max_size=40))
def test_parity_on_odd_texts(name, byte_level, text):
    assert ours(name, byte_level, [text, f"a {text} b"]) == [library(name)(text), library(name)(f"a {text} b")]


@pytest.mark.parametrize(("name", "byte_level"), FILES)
def test_parity_on_any_text(name, byte_level):
    rnd = random.Random(0)
    texts = ["".join(chr(rnd.choice([rnd.randint(1, 0xD7FF), rnd.randint(32, 126)])) for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    texts += ["<|endoftext|> a<|endoftext|>b", "don't I'll 's", "  ", "a  b\n\n c", "\r\n"]
    assert ours(name, byte_level, [*texts, None]) == [*map(library(name), texts), []]


def test_table_grows_and_resets():
    t = _Table(bits=8)
    keys = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x0001000000000001)
    t.add(keys, np.arange(60, dtype=np.uint32), np.ones(60, np.int64), np.zeros(60, bool))
    assert t.find(keys).tolist() == list(range(60)) and t.find(np.array([5], np.uint64)).tolist() == [-1]


@given(st.lists(st.integers(0, 70), max_size=60), st.integers(2, 40))
@settings(max_examples=150, deadline=None)
def test_packing_keeps_every_token(sizes, max_open):
    rows = []
    packer = packing.SumOfSquares(32, lambda s, p: rows.append((s, p)), max_open)
    texts = [np.arange(n, dtype=np.uint32) + 1000 * k for k, n in enumerate(sizes)]
    for k, t in enumerate(texts):
        packer.add(k, t)
    packer.close()
    back = {k: np.full(len(t), -1) for k, t in enumerate(texts)}
    for _, pieces in rows:
        n = sum(len(p.ids) for p in pieces)
        assert n == 32 or n & (n - 1) == 0 and n < 32
        for p in pieces:
            assert (back[p.doc_id][p.start : p.start + len(p.ids)] == -1).all()
            back[p.doc_id][p.start : p.start + len(p.ids)] = p.ids
    assert all((back[k] == t).all() for k, t in enumerate(texts))
    assert [s for s, _ in rows] == list(range(len(rows)))


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = packing.SumOfSquares(16, lambda s, p: None)
    for _ in range(300):
        packer.counts[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def after(level):
            c = packer.counts.copy()
            if level:
                c[level] -= 1
            if level + size < 16:
                c[level + size] += 1
            return int((c[1:16] ** 2).sum())

        options = [0] + [h for h in range(1, 17 - size) if packer.counts[h]]
        assert after(packer.level_for(size)) == min(map(after, options))


def test_pack_documents(spark):
    rows = packing.pack_documents(awkward(spark), queries.tokenizer("word_bpe_49k.json"), keep_ids=True).toPandas()
    encode = library("word_bpe_49k.json")
    for r in rows.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    by = rows[rows.doc_id == 4].sort_values("start")
    from common_rows import LONG

    assert [i for ids in by.ids for i in ids] == [*encode(LONG), 1]
    assert rows[rows.doc_id == 2].length.tolist() == [1] and rows[rows.doc_id.isna()].length.sum() == len(encode("nobody's text")) + 1
    assert len(rows[rows.doc_id == 5]) >= 2
    for _, seq in rows.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        n = seq.length.sum()
        assert n == 2048 or n & (n - 1) == 0
    assert packing.pack_documents(empty(spark), queries.tokenizer("word_bpe_49k.json")).count() == 0


def test_token_store(spark, tmp_path):
    import pyarrow.orc as orc

    path, docs = f"file://{tmp_path}/store", awkward(spark)
    token_store.write_token_store(docs, queries.tokenizer("byte_bpe_50k.json"), path, stripe_bytes=1 << 12, row_index_stride=1000)
    stored = token_store.read_token_store(spark, path)
    encode = library("byte_bpe_50k.json")
    got = token_store.token_store_digest(stored).toPandas().sort_values("start")
    assert len(got) == 9 and got.start.tolist() == [0, *got.n_tokens.cumsum().tolist()[:-1]]
    known = got.dropna(subset=["doc_id"])
    assert known.doc_id.tolist() == sorted(known.doc_id) and got.doc_id.isna().tolist().index(True) == 0
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in known.itertuples():
        ids = [*encode(texts[int(r.doc_id)]), 0]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted(r["doc_id"] for r in token_store.read_token_store(spark, path, [4, 8]).collect()) == [4, 8]
    files = [orc.ORCFile(str(p)) for p in (tmp_path / "store").glob("part-*.orc")]
    assert sum(f.nrows for f in files) == 9 and all(f.compression == "SNAPPY" for f in files)
    assert any(b"" != p.read_bytes() and f.nstripes >= 1 for p, f in zip((tmp_path / "store").glob("part-*.orc"), files, strict=True))
    plan = token_store.read_token_store(spark, path, [4])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "doc_id" in plan.split("PushedFilters: [")[1].split("]")[0]
    token_store.write_token_store(empty(spark), queries.tokenizer("byte_bpe_50k.json"), f"{path}-none")
    assert token_store.read_token_store(spark, f"{path}-none").count() == 0


def orc_tail(data):
    """(stripes, stream kinds by column, encodings by column) of an ORC file, from its footers."""
    import pyarrow as pa

    from tidemark.llm.spm import wire_fields

    def plain(block):
        out, at = b"", 0
        while at < len(block):
            head = int.from_bytes(block[at : at + 3], "little")
            chunk, at = block[at + 3 : at + 3 + (head >> 1)], at + 3 + (head >> 1)
            if head & 1:
                out += chunk
                continue
            size, shift, k = 0, 0, 0  # snappy begins with its length
            while True:
                size |= (chunk[k] & 127) << shift
                shift, k = shift + 7, k + 1
                if chunk[k - 1] < 128:
                    break
            out += pa.Codec("snappy").decompress(chunk, decompressed_size=size).to_pybytes()
        return out

    last = data[-1]
    tail = dict(wire_fields(data[-1 - last : -1]))
    footer = plain(data[-1 - last - tail[1] : -1 - last])
    stripes = [dict(wire_fields(v)) for n, v in wire_fields(footer) if n == 3]
    streams, encodings = {}, {}
    for x in stripes:
        at = x[1] + x[2] + x[3]
        column = 0
        for n, v in wire_fields(plain(data[at : at + x[4]])):
            if n == 1:
                told = dict(wire_fields(v))
                streams.setdefault(told.get(2, 0), set()).add(told.get(1, 0))
            elif n == 2:
                encodings.setdefault(column, set()).add(dict(wire_fields(v)).get(1, 0))
                column += 1
    return stripes, streams, encodings


def test_store_metadata_prunes(spark, tmp_path):
    docs = spark.range(0, 80_000, 2).selectExpr("id doc_id", "concat('text ', id) text")
    path = f"file://{tmp_path}/store"
    token_store.write_token_store(docs.coalesce(1), queries.tokenizer("byte_bpe_50k.json"), path, stripe_bytes=1 << 14, row_index_stride=1000)
    tails = [orc_tail(p.read_bytes()) for p in (tmp_path / "store").glob("part-*.orc")]
    assert sum(len(stripes) for stripes, _, _ in tails) > len(tails), "several stripes to a file"
    for _, streams, encodings in tails:
        assert 6 in streams[1] and streams[1] & {7, 8} and not streams[4] & {7, 8}, "a row index, and a Bloom filter on the id alone"
        assert encodings[1] == {2} and encodings[6] == {2}, "run-length encoding, version 2, of id and token ids"

    def rows_read(ids):
        found = token_store.read_token_store(spark, path, ids)
        told = [r["doc_id"] for r in found.collect()]
        leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return told, leaf.metrics().apply("numOutputRows").value()

    assert rows_read([4000])[0] == [4000] and 1 <= rows_read([4000])[1] <= 2000, "row groups without the id are skipped"
    assert rows_read([4001]) == ([], 0), "an id between those there is ruled out by the Bloom filter"
    assert rows_read([90_000]) == ([], 0), "an id beyond the statistics"
