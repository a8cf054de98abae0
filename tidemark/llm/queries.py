"""The thin queries of the training-data operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard, language, mpeg, packing, pii, spm, token_store, toxicity, url_filter

#: Where the vocabulary files are; never copied into the repository.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
PII_KEY = os.environ.get("TIDEMARK_PII_KEY", "tidemark-demonstration-key")
RULES = [url_filter.Rule(t, v) for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def tokenizer(name: str) -> str:
    return f"{TOKENIZERS}/{name}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PII_KEY, count_col="n_entities").select("doc_id", "text", "n_entities")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), toxicity.in_fold("doc_id", 1)
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), eligible=~held_out)
    found = toxicity.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_digest(mpeg.store_media(_table(spark, sf_dir, "documents"))).drop("frame_runs")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_language_id, op3_token_store, op4_pii, op5_jaccard_join, op6_url_filter, op7_toxicity, op8_sentencepiece, op9_exact_dedup, op10_media)}


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9_SQL}
