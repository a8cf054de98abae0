"""The corpus pipeline: toxic documents go, then exact and near copies, personal data is replaced, the rest is packed.

Each stage takes all that the one before kept, as a table read back from the shared folder. Every stage takes null and
repeated ids, null, empty and very long texts, repeated rows, empty tables and further columns, whatever their names; all
but the last return the columns they were given. What such rows come to is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard, packing, pii, queries, toxicity
from tidemark.llm.common import discard, settle_alone


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Learns from the labelled documents that are not held out, and drops what it predicts to be toxic.

    Rows are judged by their text alone, equal texts alike; a null or empty text is no evidence and stays. Without
    labels of both classes nothing is dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, eligible=~toxicity.in_fold("doc_id", 1))
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9. Of equal texts the row with the largest doc_id stays.

    A null text equals an empty one. A null id is the least; of rows that repeat the largest id one stays.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Of each group linked by similar shingle sets the document with the least doc_id stays.

    A null id is the greatest; of rows that repeat the least id one stays. Texts without words belong to no group.
    """
    return jaccard.drop_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Texts with surrogates; n_chars follows the new text.

    All rows stay. A null text stays null, and so does its n_chars; equal texts stay equal.
    """
    out = pii.pseudonymise(docs, queries.PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. The pieces of all documents in training sequences.

    Each row is a document of its own, whatever its id; a null or empty text is its end token alone.
    """
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("packing", pack),
]

#: Similarity links, learned scores and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        then = settle_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(docs)
        docs = then
    return STAGES[-1][1](spark, docs, sf_dir)
