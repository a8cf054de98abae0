"""Shared plumbing of the training-data operators: shared folders, settled intermediates, worker imports."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.workers import on_workers  # noqa: F401  (operators take it from here)

#: Spark deletes the shuffle files of a finished write while this is on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables that this process wrote to the shared folder and has not deleted.
_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where that is unset and the session runs on one machine (tests) a folder of our own is made and remembered in
    the session; a cluster without that setting is an error, because its machines share no temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not found:
        if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    _MADE.add(path)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs inside; dots are written as double underscores."""
    wanted = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settle(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the reread table: a cut of the lineage that outlives executors.

    The shuffle files of the write are freed when it ends. The table itself stays until ``discard`` or ``clear``.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with settings(spark, **{_CLEANUP.replace(".", "__"): "true"}):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(nullable(df.schema)).parquet(path)
    out.settled_path = path  # type: ignore[attr-defined]
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _MADE.discard(path)


def settle_alone(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Settles what ``make`` returns and deletes every table that was settled on the way."""
    before = set(_MADE)
    out = settle(make(), tag)
    for path in sorted(_MADE - before - {out.settled_path}):
        _delete(out.sparkSession, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.settled_path)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this process settled. To be called when the results of all queries are written."""
    for path in sorted(_MADE):
        _delete(spark, path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sets by the size of the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def byte_parts(column: pa.Array, most_bytes: int = 1 << 20, most_rows: int = 512) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of runs of a text or binary column that hold about ``most_bytes``, or one longer row."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(size, dtype=np.int64), 0
    while first < len(size):
        before = int(ends[first - 1]) if first else 0
        last = min(first + most_rows, max(first + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield first, last - first
        first = last


def free_name(taken: list[str], name: str) -> str:
    """``name`` or the first of ``name_1``, ``name_2``... that clashes with no column (case-insensitively)."""
    low, out, k = {c.lower() for c in taken}, name, 0
    while out.lower() in low:
        k += 1
        out = f"{name}_{k}"
    return out
