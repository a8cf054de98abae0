"""Awkward documents that every operator must take: nulls, empty and long texts, repeated rows, clashing columns."""

LONG = " ".join(f"w{k % 977}" for k in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "src0", 43, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "src0", 0, "x"),
    (4, LONG, "en", "src0", len(LONG), "x"),
    (5, "the quick brown fox jumps over the lazy dog", "en", "src0", 43, "y"),
    (5, "the quick brown fox jumps over the lazy dog", "en", "src0", 43, "y"),
    (None, "nobody's text", "en", "src1", 13, "x"),
    (7, " \t\n ", "en", "src1", 4, "x"),
    (8, "Ünïcödé ßtraße 日本語 \u00a0x", "de", "src1", 20, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string"
EXTRA = ["_text_key", "_gone", "_key", "_row", "x", "id", "members", "kind", "_attempts"]


def awkward(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in EXTRA})


def empty(spark):
    return awkward(spark).where("false")
