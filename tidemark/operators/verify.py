"""Digests, key checks and array hashes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_sha256(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of whole files."""
    return spark.read.format("binaryFile").load(pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def digest_by(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, digest): an order-free checksum of each group's rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*rows.columns)).alias("digest"))


def key_report(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row: rows and how many of them repeat a key."""
    by = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.lit(name).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated")).select("table_name", "n_rows", "n_repeated")


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def array_hash(arrays: dict[str, np.ndarray]) -> str:
    """A hash of named arrays that does not depend on the platform: little-endian float64 or int64, names in order."""
    h = hashlib.sha256()
    for name in sorted(arrays):
        a = np.asarray(arrays[name])
        a = a.astype("<i8" if a.dtype.kind in "iub" else "<f8")
        h.update(f"{name}:{a.dtype.str}:{a.shape}".encode())
        h.update(np.ascontiguousarray(a).tobytes())
    return h.hexdigest()


def compare_tables(stored: DataFrame, computed: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(column, n, n_only_stored, n_only_computed, n_different, largest): a stored table against its recomputation.

    Numbers differ beyond ``tolerance`` relative to the larger one (or 1); other values if they are not equal; null and
    NaN are equal to themselves alone.
    """
    columns = [c for c in stored.columns if c not in keys]
    a = stored.select(*keys, F.struct(*columns).alias("a"))
    b = computed.select(*keys, F.struct(*columns).alias("b"))
    both = a.join(b, keys, "full")
    kinds = dict(stored.dtypes)
    out = []
    for c in columns:
        x, y = F.col(f"a.`{c}`"), F.col(f"b.`{c}`")
        held = F.col("a").isNotNull() & F.col("b").isNotNull()
        if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal"):
            gap = F.abs(x.cast("double") - y.cast("double"))
            far = F.coalesce(gap > tolerance * F.greatest(F.abs(x.cast("double")), F.abs(y.cast("double")), F.lit(1.0)), ~x.eqNullSafe(y))
        else:
            gap, far = F.lit(None).cast("double"), ~x.eqNullSafe(y)
        out.append(F.struct(F.lit(c).alias("column"), F.count_if(held).alias("n"), F.count_if(F.col("b").isNull()).alias("n_only_stored"), F.count_if(F.col("a").isNull()).alias("n_only_computed"), F.count_if(held & far).alias("n_different"), F.max(F.when(held, gap)).alias("largest")))
    return both.agg(F.array(*out).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def table_cells(lines: DataFrame, columns: list[str], separator: str = "&", line: str = "line") -> DataFrame:
    """(label, column, printed, digits) of the cells of printed table rows: a label, then a number for each column.

    Marks of significance, thousands' commas, percent signs, dollar signs, formatting commands and the end of a row are
    left out; lines with another number of cells are no rows.
    """
    cells = F.transform(F.split(F.regexp_replace(line, r"\\\\\s*$", ""), f"[{separator}]"), lambda c: F.trim(F.regexp_replace(c, r"\\[a-z]+\{|\\[%$&]|[}$*%]|\\[a-z]+|(?<=\d),(?=\d{3})", "")))
    told = lines.select(cells.alias("c")).where(F.size("c") == len(columns) + 1)
    value = lambda k: F.struct(F.lit(columns[k]).alias("column"), F.regexp_extract(F.col("c")[k + 1], r"^[-+]?\d+(?:\.(\d+))?$", 0).alias("text"))
    long = told.select(F.col("c")[0].alias("label"), F.explode(F.array(*(value(k) for k in range(len(columns))))).alias("v")).where("v.text <> ''")
    return long.select("label", "v.column", F.col("v.text").cast("double").alias("printed"), F.length(F.regexp_extract("v.text", r"\.(\d+)$", 1)).alias("digits"))


def compare_cells(cells: DataFrame, results: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, column, printed, digits, value, agrees): printed cells against results, to the digits that are printed."""
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns)))
    long = results.select(F.col(label).alias("label"), told.alias("v")).select("label", "v.*")
    half = 0.5 * F.pow(F.lit(10.0), -F.col("digits").cast("double")) * (1 + 1e-9)
    return cells.join(long, ["label", "column"], "left").withColumn("agrees", F.coalesce(F.abs(F.col("printed") - F.col("value")) <= half, F.lit(False)))
