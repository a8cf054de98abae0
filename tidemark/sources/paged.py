"""A paged quote source: pages of at most 1000 rows by time, with other endpoints where one fails, and a fingerprint.

The transport is a function (endpoint, symbol, start, limit) -> rows of (time in ms, open, high, low, close, volume), so
that the paging can be tested, and run, without a network.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Row = tuple[int, float, float, float, float, float]
Fetch = Callable[[str, str, int, int], list[Row]]
PAGE = 1000
QUOTES = "symbol string, time_ms long, open double, high double, low double, close double, volume double"


class NoEndpoint(RuntimeError):
    """No endpoint gave the page."""


def pages(fetch: Fetch, endpoints: list[str], symbol: str, start: int, stop: int, limit: int = PAGE) -> Iterator[list[Row]]:
    """Pages from ``start`` until before ``stop``, each after the last time of the one before; each endpoint in turn is tried."""
    while start < stop:
        failed = []
        for endpoint in endpoints:
            try:
                found = fetch(endpoint, symbol, start, limit)
                break
            except OSError as e:
                failed.append(f"{endpoint}: {e}")
        else:
            raise NoEndpoint("; ".join(failed) or "no endpoint")
        rows = sorted({r[0]: r for r in found if start <= r[0] < stop}.values())
        if rows:
            yield rows
        if len(found) < limit or not rows:
            return
        start = rows[-1][0] + 1


def fingerprint(rows: list[Row]) -> str:
    """SHA-256 of the rows in order of time, as little-endian numbers."""
    h = hashlib.sha256()
    for r in sorted(rows):
        h.update(struct.pack("<q5d", *r))
    return h.hexdigest()


def read_quotes(spark: SparkSession, fetch: Fetch, endpoints: list[str], symbols: list[str], start: int, stop: int) -> DataFrame:
    """Quotes of all symbols, a task for each; a symbol without quotes has no rows."""

    def task(parts):
        for pdf in parts:
            for symbol in pdf["symbol"]:
                for page in pages(fetch, endpoints, symbol, start, stop):
                    yield pd.DataFrame([(symbol, *r) for r in page], columns=["symbol", "time_ms", "open", "high", "low", "close", "volume"])

    wanted = spark.createDataFrame([(s,) for s in symbols], "symbol string").repartition(max(1, len(symbols)), "symbol")
    return wanted.mapInPandas(task, QUOTES)
