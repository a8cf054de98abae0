import itertools
import random

import pytest
from common_rows import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard


def test_exact_marks(spark):
    rows = exact_dedup.mark_exact_duplicates(awkward(spark)).collect()
    assert len(rows) == 9
    by = {(r["doc_id"], r["kept"]) for r in rows}
    assert (1, False) in by and (5, True) in by and (3, True) in by and (2, False) in by and (None, False) in by or (None, True) in by
    group = [r for r in rows if r["keep_id"] == 5]
    assert len(group) == 3 and {r["group_size"] for r in group} == {3}
    assert {r["keep_id"] for r in rows if r["doc_id"] in (2, 3)} == {3}
    assert exact_dedup.mark_exact_duplicates(empty(spark)).count() == 0


def test_exact_drop_keeps_one_row_and_all_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "7", "8", "None"]
    assert exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket_size", [1, 7, 1000])
def test_directory_splits_only_overfull_buckets(spark, bucket_size):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 150).alias("text"))
    built = exact_dedup.build_index(docs, bucket_size=bucket_size)
    index, known = built.entries.toPandas(), built.directory.toPandas()
    assert known.cell.is_unique and built.chained is None and set(known.bucket) == set(index.bucket)
    assert built.depth == known.depth.max() and len(known) <= 2**built.depth
    assert len(index) == 150 and index.group_size.sum() == 400
    per = index.groupby("bucket").size()
    assert per.max() <= bucket_size or index.depth.max() == exact_dedup._DEPTH
    if bucket_size == 1000:
        assert set(index.depth) == {0} and set(index.bucket) == {0}
    for r in index.itertuples():
        cell = (r.key & (2**64 - 1)) >> (64 - exact_dedup._DEPTH)
        assert cell >> (exact_dedup._DEPTH - r.depth) << (exact_dedup._DEPTH - r.depth) == r.bucket


def test_rows_are_found_through_the_directory(spark, monkeypatch):
    from dataclasses import replace

    monkeypatch.setattr(exact_dedup, "_ROWS", 20)  # buckets are dealt to several tasks
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("text"))
    index = exact_dedup.build_index(docs, bucket_size=7)
    assert index.directory.agg(F.max("spread")).first()[0] > 1
    rows = exact_dedup.look_up(docs, index).collect()
    assert len(rows) == 300 and all(r["keep_id"] == r["doc_id"] + (299 - r["doc_id"]) // 40 * 40 for r in rows)
    broken = replace(index, directory=index.directory.withColumn("bucket", F.col("bucket") + 1))
    assert exact_dedup.look_up(docs, broken).count() == 0
    lost = replace(index, directory=index.directory.where(F.col("bucket") != index.directory.first()["bucket"]))
    assert 0 < exact_dedup.look_up(docs, lost).count() < 300


def test_chains_compare_bytes(spark, monkeypatch):
    """With a key of two values nearly all texts collide; a collision is no copy."""
    monkeypatch.setattr(exact_dedup, "_key", lambda text: F.xxhash64(F.length(text) % 2))
    docs = awkward(spark)
    rows = exact_dedup.mark_exact_duplicates(docs).collect()
    assert len(rows) == 9 and len({r["text_sha256"] for r in rows}) == 6
    assert sorted(r["group_size"] for r in rows) == [1, 1, 1, 1, 2, 2, 3, 3, 3]
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "5", "7", "8", "None"]


def words(text):
    import re

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x20\x09-\x0d]+", low)


def brute(rows, sim):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        sets[k] = frozenset(tuple(w[i : i + sim.k]) for i in range(len(w) - sim.k + 1)) if len(w) >= sim.k else frozenset([tuple(w)] if w else [])
    label, links = {k: k for k in sets}, dict.fromkeys(sets, 0)
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sim.den * len(sets[a] & sets[b]) >= sim.num * len(sets[a] | sets[b]):
            links[a], links[b] = links[a] + 1, links[b] + 1
            old, new = label[a], label[b]
            label = {k: new if v == old else v for k, v in label.items()}
    out = []
    for k, (i, _) in enumerate(rows):
        mates = [rows[j][0] for j in sets if label[j] == label[k] and rows[j][0] is not None]
        out.append((i, len(sets[k]), i if not sets[k] else min(mates, default=None), links[k]))
    return sorted(out, key=str)


def ours(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.near_duplicate_classes(docs, **options).collect()), key=str)


def variants(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = [f"e{rnd.randint(0, 50)}"]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_matches_brute_force(spark, seed, monkeypatch):
    rnd, texts = random.Random(seed), [None, "", " \n", "one", "ONE", "one two", "a b c d", "A b c d"]
    for n in (5, 6, 7, 8, 9, 10, 11, 13, 17, 24, 40, 90, 300):
        base = [f"v{rnd.randint(0, 400)}" for _ in range(n)]
        texts += variants(rnd, base, 9, max(1, n // 12)) + [" ".join(base)]
    passage = [f"p{k}" for k in range(50)]
    texts += [" ".join(passage + [f"q{rnd.randint(0, 9999)}" for _ in range(rnd.randint(2, 60))]) for _ in range(25)]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(0, texts[9]), (None, texts[9]), (9, texts[12])]
    sim = jaccard.Similarity()
    want = brute(rows, sim)
    assert ours(spark, rows) == want
    if not seed:
        assert ours(spark, rows, block=400) == want, "blocks"
        assert ours(spark, rows, known=1, summary=1) == want, "no knowledge of frequencies"
        assert ours(spark, rows, filter_bits=0) == want, "no filter"
        monkeypatch.setattr(jaccard, "_WORTH", 1)
        assert ours(spark, rows) == want, "blocks for balance"


def test_other_thresholds(spark):
    rnd = random.Random(9)
    texts = [t for n in (6, 12, 30, 80) for t in variants(rnd, [f"v{rnd.randint(0, 300)}" for _ in range(n)], 8, max(1, n // 6))]
    rows = list(enumerate(texts))
    for num, den, k in ((9, 10, 3), (1, 2, 2), (60, 100, 5)):
        sim = jaccard.Similarity(num, den, k)
        assert ours(spark, rows, similarity=sim) == brute(rows, sim)


SETS = st.lists(st.frozensets(st.integers(0, 40), max_size=14), max_size=14)


@given(SETS, SETS)
@settings(max_examples=150, deadline=None)
def test_overlaps(left, right):
    import numpy as np

    from tidemark.llm import overlaps

    arrays = lambda sets: [np.array(sorted(s), np.uint64) for s in sets]
    told = lambda found: {(int(a), int(b)): int(n) for x in found for a, b, n in zip(*x, strict=True)}
    before = overlaps._GATHER, overlaps._FREQUENT
    try:
        for overlaps._GATHER, overlaps._FREQUENT in ((1, 2), (1 << 21, 64)):
            assert told(overlaps.overlaps(arrays(left), arrays(right))) == {(i, j): len(a & b) for i, a in enumerate(left) for j, b in enumerate(right) if a & b}
            assert told(overlaps.overlaps(arrays(left))) == {(i, j): len(a & b) for (i, a), (j, b) in itertools.combinations(enumerate(left), 2) if a & b}
    finally:
        overlaps._GATHER, overlaps._FREQUENT = before


def test_groups_that_outgrow_a_batch_are_tied_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "_BATCH", 50)
    none = jaccard.Costs(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    keys = np.repeat([64, 128, 192, 256], [30, 500, 3, 400])
    x, ids = np.full(len(keys), 20), np.concatenate([np.arange(n) for n in (30, 500, 3, 400)])
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + 17]) for c in (keys, x, ids)], ["key", "x", "id"]) for k in range(0, len(keys), 17)]
    found = [r for b in jaccard._group_task(iter(batches), jaccard.Similarity(), none) for r in b.to_pylist()]
    stars = [(r["aid"], r["bid"]) for r in found if r["kind"] == 1]
    assert {b for _, b in stars} >= set(range(500)) - {0} and {a for a, _ in stars} == {0}
    assert sum(b == 399 for _, b in stars) == 2 and sum(b == 29 for _, b in stars) == 3


def test_unsettled_components_are_an_error(spark):
    rows = spark.createDataFrame([((1, k), (1, k + 1)) for k in range(40)], "a struct<x:long,id:long>, b struct<x:long,id:long>")
    with pytest.raises(RuntimeError, match="not settled"):
        jaccard.components(rows, "test", max_rounds=1, few=0)


@given(st.lists(st.lists(st.integers(0, 30), max_size=14), min_size=2, max_size=12))
@settings(max_examples=60, deadline=None)
def test_similar_sets_share_enough_signatures(lists):
    import numpy as np

    from tidemark.llm.shingles import mix

    sim, sets = jaccard.Similarity(), [np.unique(mix(np.array(x, np.uint64) + np.uint64(1))) for x in lists]
    sizes = np.array([len(s) for s in sets])
    none = jaccard.Costs(np.zeros(0, np.uint64), np.zeros(0, np.uint8))
    owner, sig, _ = jaccard.cheapest(np.concatenate(sets), sizes, sim, none)
    by = {k: set(sig[owner == k].tolist()) for k in range(len(sets))}
    for a, b in itertools.combinations(range(len(sets)), 2):
        both, n = len(np.intersect1d(sets[a], sets[b])), sizes[a] + sizes[b]
        if sizes[a] and sizes[b] and sim.den * both >= sim.num * (n - both):
            tiny = max(sizes[a], sizes[b]) <= sim.tiny
            assert len(by[a] & by[b]) >= (1 if tiny else int(jaccard.shared(min(sizes[a], sizes[b]))))


def test_awkward_documents(spark):
    docs = awkward(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_classes(docs).collect()}
    assert got[1] == got[5] == (5, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[7] == (0, 7) and got[None] == (1, None)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "7", "8", "None"]
    assert jaccard.near_duplicate_classes(empty(spark)).count() == 0


def test_one_row_of_each_component_stays(spark):
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(60))
    near = lambda tag: text(tag) + " end"
    rows = [
        (1, text("a"), "stays"), (None, near("a"), "goes"), (None, text("b"), "stays"), (None, text("c"), "stays"),
        (None, text("d"), "one"), (None, near("d"), "one"),
        (5, text("e"), "stays"), (5, text("f"), "goes"), (4, near("f"), "least"),
        (6, text("g"), "two"), (6, near("g"), "two"), (7, text("g") + " of it", "goes"),
        (8, text("h"), "three"), (8, text("h"), "three"), (8, text("h").upper(), "three"),
        (9, "", "stays"), (9, None, "stays"), (None, " ", "stays"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fate string").repartition(3)
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted((r["fate"], (r["text"] or "")[:1].lower()) for r in kept.collect())
    assert got == sorted([("stays", t) for t in ("a", "b", "c", "e", "", "", " ")] + [("least", "f"), ("one", "d"), ("two", "g"), ("three", "h")])


@pytest.mark.parametrize("batch", [20, 1 << 18])
def test_components(spark, batch, monkeypatch):
    rnd = random.Random(4)
    pairs = [(rnd.randint(0, 120), rnd.randint(0, 120)) for _ in range(70)] + [(k, k + 1) for k in range(200, 230)]
    rows = spark.createDataFrame([((1, a), (1, b)) for a, b in pairs], "a struct<x:long,id:long>, b struct<x:long,id:long>")
    label = {v: v for p in pairs for v in p}
    for a, b in pairs:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {k: new if v == old else v for k, v in label.items()}
    want = {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in pairs)}
    monkeypatch.setattr(jaccard, "_BATCH", batch)
    for few in (0, 1000):
        assert {r["node"]["id"]: r["label"]["id"] for r in jaccard.components(rows.repartition(3), "test", few=few).collect()} == want


def passages_in_common(n=240, each=40):
    """Texts that are not similar, tied to one part by passages of which each is in ``each`` of them; and near copies of some."""
    rnd, texts = random.Random(5), []
    for k in range(n):
        own = [f"o{k}x{i}" for i in range(60)]
        for p in (k * each // n, n + k * 7 % (n // each)):
            own += [f"p{p}w{i}" for i in range(12)]
        texts.append(own)
    near = [t for k in range(0, n, 20) for t in variants(rnd, texts[k], 3, 3)]
    return list(enumerate([" ".join(t) for t in texts] + near))


def test_large_parts_are_divided_by_exact_counts(spark, monkeypatch):
    """Summaries that know nothing tie all sets with a passage; exact counts leave near copies together, and few others."""
    rows, parts, joined = passages_in_common(), [], jaccard.joined_parts

    def seen(chosen, given, *more, **options):
        parts.append(max(r["n"] for r in given.groupBy("label").agg(F.count("*").alias("n")).collect()))
        return joined(chosen, given, *more, **options)

    monkeypatch.setattr(jaccard, "joined_parts", seen)
    assert ours(spark, rows, summary=1, block=100) == brute(rows, jaccard.Similarity())
    assert parts[0] < 40, "sets of the largest part"


def test_tasks_in_rounds_lose_nothing(spark, monkeypatch):
    told = []
    monkeypatch.setattr(jaccard, "_FEW_BYTES", 1000, raising=False)
    monkeypatch.setattr(jaccard, "_AT_ONCE", 0, raising=False)
    monkeypatch.setattr(jaccard, "_LARGE", 1 << 30, raising=False)
    settled = jaccard.settle
    monkeypatch.setattr(jaccard, "settle", lambda df, tag, **o: told.append(tag) or settled(df, tag, **o))
    rows = passages_in_common(120)
    assert ours(spark, rows, summary=1, block=400) == brute(rows, jaccard.Similarity())
    assert told.count("jaccard-sets") == 2, "of quarters and of whole sets"


def test_counts_of_signatures_span_batches():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(3)
    sig = np.sort(np.array([rnd.randint(0, 60) for _ in range(700)] + [7] * 50 + [60] * 30))
    for step in (1, 13, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(sig[k : k + step])], ["sig"]) for k in range(0, len(sig), step)]
        got = {r["id"]: r["n"] for b in jaccard._count_task(iter(batches), 12) for r in b.to_pylist()}
        assert got == {int(v): int(n) for v, n in zip(*np.unique(sig, return_counts=True), strict=True) if n >= 12}
    assert not list(jaccard._count_task(iter([]), 12))


def test_numbered_rows_are_compressed(spark, monkeypatch):
    """The copy of the corpus stays on disk beside the index."""
    import os

    tables, settled = {}, jaccard.settle

    def kept(df, tag, **options):
        tables[tag] = settled(df, tag, **options)
        return tables[tag]

    monkeypatch.setattr(jaccard, "settle", kept)
    docs = spark.createDataFrame([(k, f"one two three four five {k}") for k in range(9)], "doc_id long, text string")
    rows = jaccard.drop_near_duplicates(docs)
    assert rows.count() == 9
    names = os.listdir(tables["jaccard-rows"].settled_path.removeprefix("file://"))
    assert any(n.endswith(".zstd.parquet") for n in names) and not any(n.endswith(".snappy.parquet") for n in names)
