"""Granger-type and stationarity tests as grouped functions over (asset, series) pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models import regression


def pairs(vol: DataFrame, sentiment: DataFrame, series: list[str], y: str, key: str) -> DataFrame:
    """(asset, sentiment, <key>, y, x): a weekly or daily series of each asset next to each sentiment series."""
    told = F.explode(F.array(*(F.struct(F.lit(c).alias("sentiment"), F.col(c).alias("x")) for c in series)))
    long = sentiment.select(key, told.alias("s")).select(key, "s.*")
    return vol.select("asset", key, F.col(y).alias("y")).join(long, key)


def granger_min_p(rows: DataFrame, key: str, maxlag: int, least: int, both_ways: bool = False) -> DataFrame:
    """(asset, sentiment, direction, f, p, lag, lag_aic, lag_bic, n); pairs below ``least`` rows have nulls."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        base, out = {c: pdf[c].iloc[0] for c in ("asset", "sentiment")}, []
        for name, a, b in (("x_to_y", "y", "x"), ("y_to_x", "x", "y"))[: 1 + both_ways]:
            found = regression.granger(pdf[a], pdf[b], maxlag, least) or {"f": None, "p": None, "lag": None, "lag_aic": None, "lag_bic": None, "n": int(pdf[["x", "y"]].dropna().shape[0])}
            out.append({**base, "direction": name, **found})
        return pd.DataFrame(out)

    return _clean(rows.groupBy("asset", "sentiment").applyInPandas(one, "asset string, sentiment string, direction string, f double, p double, lag long, lag_aic long, lag_bic long, n long"))


def conditional(rows: DataFrame, key: str, controls: list[str], maxlag: int, contemporaneous: bool = False, least: int = 50) -> DataFrame:
    """(asset, sentiment, f, p, lag, n) of x for y given control columns."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        found = regression.conditional_granger(pdf["y"], pdf["x"], [pdf[c] for c in controls], maxlag, least, contemporaneous)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in ("asset", "sentiment")}, **found}])

    return _clean(rows.groupBy("asset", "sentiment").applyInPandas(one, "asset string, sentiment string, f double, p double, lag long, n long"))


def toda_yamamoto(rows: DataFrame, key: str, maxlag: int) -> DataFrame:
    """(asset, sentiment, wald, p, order, lags, n)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in ("asset", "sentiment")}, **regression.toda_yamamoto(pdf["y"], pdf["x"], maxlag)}])

    return _clean(rows.groupBy("asset", "sentiment").applyInPandas(one, "asset string, sentiment string, wald double, p double, order long, lags long, n long"))


def stationarity(rows: DataFrame, key: str, value: str, name: str = "asset") -> DataFrame:
    """(series, n, adf_stat, adf_p, kpss_stat, kpss_p): the two tests of each series; the verdict is a column function."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(key)[value].dropna()
        a, ap, _ = regression.adf(x)
        k, kp, _ = regression.kpss(x)
        return pd.DataFrame([{"series": pdf[name].iloc[0], "n": len(x), "adf_stat": a, "adf_p": ap, "kpss_stat": k, "kpss_p": kp}])

    return rows.groupBy(name).applyInPandas(one, "series string, n long, adf_stat double, adf_p double, kpss_stat double, kpss_p double")


def missingness(rows: DataFrame, key: str, flag: str, value: str) -> DataFrame:
    """(asset, n, n_flagged, slope, p): a logit of a 0/1 flag on the last value; null where the flag is constant."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).dropna(subset=[flag, value]).copy()
        pdf["l"] = pdf[value].shift(1)
        pdf = pdf.dropna(subset=["l"])
        slope, p = regression.logit(pdf[flag], pdf["l"]) if pdf[flag].nunique() > 1 else (None, None)
        return pd.DataFrame([{"asset": pdf["asset"].iloc[0], "n": len(pdf), "n_flagged": int(pdf[flag].sum()), "slope": slope, "p": p}])

    return _clean(rows.groupBy("asset").applyInPandas(one, "asset string, n long, n_flagged long, slope double, p double"))


def adaptive_maxlag(n: int) -> int:
    """Lags for a sub-period of n weeks: a sixth of them, from 2 to 8."""
    return min(8, max(2, n // 6))


def by_period(rows: DataFrame, key: str, periods: dict[str, str], controls: list[str] | None = None, floor: int = 30) -> DataFrame:
    """(period, asset, sentiment, direction, f, p, lag, n): tests in sub-periods given as SQL conditions on the key."""
    label = F.lit(None).cast("string")
    for name, condition in periods.items():
        label = F.when(F.expr(condition), name).otherwise(label)
    cut = rows.withColumn("period", label).where("period is not null")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        base, n = {c: pdf[c].iloc[0] for c in ("period", "asset", "sentiment")}, int(pdf[["x", "y"]].dropna().shape[0])
        out = []
        for name, a, b in (("x_to_y", "y", "x"), ("y_to_x", "x", "y")):
            found = regression.granger(pdf[a], pdf[b], adaptive_maxlag(n), floor) or {}
            out.append({**base, "direction": name, "f": found.get("f"), "p": found.get("p"), "lag": found.get("lag"), "n": n})
        if controls:
            found = regression.conditional_granger(pdf["y"], pdf["x"], [pdf[c] for c in controls], adaptive_maxlag(n), floor)
            out.append({**base, "direction": "x_to_y_controlled", **found})
        return pd.DataFrame(out)

    return _clean(cut.groupBy("period", "asset", "sentiment").applyInPandas(one, "period string, asset string, sentiment string, direction string, f double, p double, lag long, n long"))


def _clean(rows: DataFrame) -> DataFrame:
    """NaN becomes null."""
    return rows.select(*(F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))
