"""Sinks: CSV for exchange, one or several tables to a file, Parquet with read-back, draw archives, and the record of a run."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ReadBackError(RuntimeError):
    """What was read back is not what was written."""


def write_csv(rows: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header; with ``digits`` doubles are written with that many significant digits (17 round-trip exactly)."""
    if digits:
        rows = rows.select(*(F.format_string(f"%.{digits - 1}e", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Several small tables as one text file: for each a line ``# name``, a header, and its rows in the order of their text.

    It is one file, and so one task: for published tables, not for data.
    """
    lines = None
    for k, (name, rows) in enumerate(sections.items()):
        spark = rows.sparkSession
        head = spark.createDataFrame([(k, 0, f"# {name}"), (k, 1, ",".join(rows.columns))], "section int, part int, value string")
        body = rows.select(F.lit(k).alias("section"), F.lit(2).alias("part"), F.to_csv(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("value"))
        lines = head.unionByName(body) if lines is None else lines.unionByName(head).unionByName(body)
    if lines is None:
        raise ValueError("no section")
    lines.repartition(1).sortWithinPartitions("section", "part", "value").select("value").write.mode("overwrite").text(path)


def checksum(rows: DataFrame) -> tuple[int, int]:
    """(rows, order-free checksum)."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])), F.lit(0)).alias("x")).first()
    return found["n"], found["x"]


def publish(rows: DataFrame, path: str) -> DataFrame:
    """Writes a table to a hidden neighbour, compares it with what it was made of, and only then gives it its name."""
    spark = rows.sparkSession
    temp = f"{path.rstrip('/')}.writing"
    rows.write.mode("overwrite").parquet(temp)
    back = spark.read.schema(rows.schema).parquet(temp)
    if checksum(back) != checksum(rows):
        raise ReadBackError(path)
    _rename(spark, temp, path)
    return spark.read.schema(rows.schema).parquet(path)


_ARCHIVE = "kind string, name string, dtype string, shape array<long>, data binary, note string"


def write_archive(spark: SparkSession, path: str, arrays: dict[str, np.ndarray], notes: dict[str, str] | None = None) -> None:
    """Named arrays, bit by bit, and notes on where they come from, as one table.

    It is read back and compared, NaNs included, before it gets its name; what had the name before is replaced.
    """
    told = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
    rows = [("array", k, v.dtype.str, list(v.shape), bytearray(v.tobytes()), None) for k, v in told.items()]
    rows += [("note", k, None, None, None, v) for k, v in (notes or {}).items()]
    temp = f"{path.rstrip('/')}.writing"
    spark.createDataFrame(rows, _ARCHIVE).repartition(1).write.mode("overwrite").parquet(temp)
    back, said = read_archive(spark, temp)
    same = lambda a, b: (a.dtype, a.shape, a.tobytes()) == (b.dtype, b.shape, b.tobytes())
    if set(back) != set(told) or not all(same(back[k], v) for k, v in told.items()) or said != (notes or {}):
        raise ReadBackError(path)
    _rename(spark, temp, path)


def read_archive(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    """(arrays, notes) of an archive; arrays are small by nature, a number for each draw."""
    rows = spark.read.schema(_ARCHIVE).parquet(path).collect()
    arrays = {r["name"]: np.frombuffer(bytes(r["data"]), np.dtype(r["dtype"])).reshape(r["shape"]).copy() for r in rows if r["kind"] == "array"}
    return arrays, {r["name"]: r["note"] for r in rows if r["kind"] == "note"}


def _rename(spark: SparkSession, temp: str, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = hadoop.Path(temp), hadoop.Path(path)
    files = source.getFileSystem(conf)
    files.delete(target, True)
    if not files.rename(source, target):
        raise ReadBackError(f"{temp} could not be renamed")


def run_record(spark: SparkSession, name: str, parameters: dict, inputs: dict[str, DataFrame]) -> DataFrame:
    """One row that says what a result was made of: parameters, their hash, and a checksum of each input."""
    told = json.dumps(parameters, sort_keys=True, default=str)
    sums = {k: checksum(v) for k, v in sorted(inputs.items())}
    return spark.createDataFrame(
        [(name, told, hashlib.sha256(told.encode()).hexdigest(), json.dumps({k: {"rows": n, "checksum": x} for k, (n, x) in sums.items()}))],
        "name string, parameters string, parameters_sha256 string, inputs string",
    )
