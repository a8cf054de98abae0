import random

import pytest
from common_rows import awkward, empty

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rnd, rows, labels = random.Random(2), [], []
    for k in range(700):
        words = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(60, 160))]
        if k % 6 == 0:
            words[10:10] = ["vilethy", "scumish"] * 3
        rows.append([k, " ".join(words), "en", f"s{k % 3}", 0])
        labels.append((k, 1, int(k % 6 == 0)))
    rows.append([1000, rows[1][1], "en", "s1", 0])
    near = rows[2][1].split()
    near[5] = "changed"
    rows.append([1001, " ".join(near), "en", "s1", 0])
    rows.append([1002, "write to ann.lee@example.org " + rows[3][1][::-1], "en", "s1", 0])
    rows.append([1003, None, "en", "s1", 0])
    d = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        now.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        seen[name] = {r["doc_id"]: r for r in now.collect()}
        if name != "packing":
            assert now.columns == docs.columns
    toxic = {k for k, _, t in labels if t}
    assert len(toxic & set(seen["toxicity"])) <= 2 and len(set(seen["toxicity"]) - toxic) >= 580
    assert 1 not in seen["exact_dedup"] and 1000 in seen["exact_dedup"]
    assert 1001 not in seen["near_dedup"] and 2 in seen["near_dedup"] and len(seen["near_dedup"]) == len(seen["exact_dedup"]) - 1
    assert "ann.lee" not in seen["pii"][1002]["text"] and seen["pii"][1002]["n_chars"] == len(seen["pii"][1002]["text"])
    assert {k: v["text"] for k, v in seen["pii"].items() if k != 1002} == {k: v["text"] for k, v in seen["near_dedup"].items() if k != 1002}
    assert set(seen["packing"]) == set(seen["pii"])
    out = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in out.collect()} == set(seen["packing"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_documents_pass_all_stages(spark, tmp_path, make):
    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    now = make(spark)
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, d)
        assert name == "packing" or now.columns == columns
        now.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        kept[name] = sorted(str(r["doc_id"]) for r in now.collect())
    if make is empty:
        assert not any(kept.values())
        return
    assert len(kept["toxicity"]) == 9, "labels of one usable class"
    assert kept["exact_dedup"] == kept["near_dedup"] == kept["pii"] == ["3", "4", "5", "7", "8", "None"] and set(kept["packing"]) == set(kept["pii"])
