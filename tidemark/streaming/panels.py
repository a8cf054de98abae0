"""Structured Streaming over returns (asset, ts, ret): windowed sums with watermarks, and state for each asset."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def weekly_volatility(stream: DataFrame, late: str = "7 days", offset: str = "4 days") -> DataFrame:
    """(asset, week_start, wk_ret, wk_absvol) for weeks from Monday; rows later than ``late`` behind the newest are dropped."""
    week = F.window("ts", "7 days", startTime=offset)  # the epoch began on a Thursday
    sums = stream.withWatermark("ts", late).groupBy("asset", week).agg(F.sum("ret").alias("wk_ret"), F.sum(F.abs("ret")).alias("wk_absvol"))
    return sums.select("asset", F.to_date("window.start").alias("week_start"), "wk_ret", "wk_absvol")


def _ordered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values("ts", kind="stable")


def rolling_zscore(stream: DataFrame, window: int = 52, least: int = 26) -> DataFrame:
    """(asset, ts, ret, z): rows of an asset in order of arrival by time; the state is its last ``window`` values."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = deque(state.get[0] if state.exists else [], maxlen=window)
        out = []
        for row in _ordered(parts).itertuples(index=False):
            last.append(float(row.ret))
            x = np.fromiter(last, float)
            sd = x.std(ddof=1) if len(x) >= max(least, 2) else 0.0
            out.append((key[0], row.ts, row.ret, (x[-1] - x.mean()) / sd if sd > 0 else None))
        state.update((list(last),))
        yield pd.DataFrame(out, columns=["asset", "ts", "ret", "z"])

    return stream.groupBy("asset").applyInPandasWithState(step, "asset string, ts timestamp, ret double, z double", "last array<double>", "append", GroupStateTimeout.NoTimeout)


def variance_filter(stream: DataFrame, omega: float, alpha: float, gamma: float, beta: float, var0: float, mean: float = 0.0) -> DataFrame:
    """(asset, ts, ret, variance) of the GJR recursion with given parameters; the state is the last variance and residual."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v, e = state.get if state.exists else (None, None)
        out = []
        for row in _ordered(parts).itertuples(index=False):
            v = var0 if v is None else max(omega + (alpha + (gamma if e < 0 else 0.0)) * e * e + beta * v, 1e-8)
            e = float(row.ret) - mean
            out.append((key[0], row.ts, row.ret, v))
        state.update((v, e))
        yield pd.DataFrame(out, columns=["asset", "ts", "ret", "variance"])

    return stream.groupBy("asset").applyInPandasWithState(step, "asset string, ts timestamp, ret double, variance double", "v double, e double", "append", GroupStateTimeout.NoTimeout)
