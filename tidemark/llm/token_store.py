"""Operator 3, token-id output: documents as integer arrays in ORC files with row indexes and Bloom filters.

Documents are dealt by ranges of their id, sorted, encoded and written by Spark's ORC writer: the integer columns take
run-length encoding (version 2), each stripe has a row index every ``row_index_stride`` rows and a Bloom filter on the
document id. Readers take stripes in parallel and skip files, stripes and row groups by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path, on_workers, partitions, settings
from tidemark.llm.segments import encoder
from tidemark.llm.tokens import crc32_of, with_end

_STORE = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encode_task(batches: Iterator[pa.RecordBatch], path: str, byte_level: bool, end_id: int):
    codec, seen, part_now = encoder(path, byte_level), 0, None
    for batch in batches:
        ids, parts = batch.column(0), batch.column(2)
        for first, flat, bounds in codec.columns(batch.column(1)):
            flat, bounds = with_end(flat, bounds, end_id)
            n = len(bounds) - 1
            part = parts.slice(first, n)
            if part_now != (p := part[0].as_py()):
                part_now, seen = p, 0
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n), part, pa.array(seen + bounds[:-1]), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.view(np.int32)))],
                ["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            seen += int(bounds[-1])


def write_token_store(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    *,
    byte_level: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    stripe_bytes: int = 16 << 20,
    row_index_stride: int = 1000,
    bloom_fpp: float = 0.01,
) -> None:
    """Writes (doc_id, part, local_start, n_tokens, ids) in ascending doc_id order, one file for each id range.

    ``local_start`` counts the ids before a document in its own file. Equal ids are ordered by a hash of their text and
    may span files; a null id comes first. A null or empty text is the end id alone. Equal ids with equal texts are
    interchangeable. An empty table gives a folder without rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    on_workers(spark)
    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = chosen.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    encoded = dealt.select("doc_id", "text", "part").mapInArrow(lambda it: _encode_task(it, tokenizer_path, byte_level, end_id), _STORE)
    options = {
        "compression": "snappy",
        "orc.stripe.size": str(stripe_bytes),
        "orc.create.index": "true",
        "orc.row.index.stride": str(row_index_stride),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(bloom_fpp),
    }
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__orc__columnarWriterBatchSize="256"):
        encoded.write.options(**options).orc(path)


def read_token_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows, or those of ``doc_ids``, for which the reader skips stripes and row groups by their metadata."""
    stored = spark.read.schema(_STORE).orc(path)
    return stored if doc_ids is None else stored.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def file_starts(stored: DataFrame) -> DataFrame:
    """(part, before): the ids in all files before. A file's total is one row, and only totals are summed over files."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def _digest(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = batch.column(4)
        values, offsets = ids.values.to_numpy().view(np.uint32), ids.offsets.to_numpy()
        crc = [crc32_of(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def token_store_digest(stored: DataFrame) -> DataFrame:
    """doc_id, start (the ids of all documents before), n_tokens and the crc32 of the ids, from the files."""
    on_workers(stored.sparkSession)
    rows = stored.select("doc_id", "part", "local_start", "n_tokens", "ids").mapInArrow(_digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    found = rows.join(file_starts(stored), "part")
    return found.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes a store in the shared folder and returns the digest of what it holds."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-store")
    write_token_store(docs, tokenizer_path, path, **options)
    return token_store_digest(read_token_store(spark, path))
