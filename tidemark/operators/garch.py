"""Model fits by asset, specification and model as grouped functions, and the tables made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models import garch as model
from tidemark.models import regression

EXOG = ["d_infrastructure", "d_regulatory", "s_all", "s_reg", "s_infra"]
_FIT = "asset string, spec string, model string, n_obs long, n_exog long, converged boolean, log_lik double, params map<string,double>, std_errors map<string,double>, p_values map<string,double>, k long, aic double, bic double, persistence double"


def design(rets: DataFrame, dummies: DataFrame, daily: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(asset, date, ret, five regressors): event dummies and daily sentiment with zeros where there is none.

    With ``common`` the sentiment is first cut to those days, so that other days get zeros.
    """
    sent = daily if common is None else daily.join(common, "date", "left_semi")
    rows = rets.select("asset", "date", "ret").join(dummies.select("date", "d_infrastructure", "d_regulatory").distinct(), "date", "left").join(sent.select("date", "s_all", "s_reg", "s_infra"), "date", "left")
    return rows.select("asset", "date", "ret", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in EXOG))


def _data(pdf: pd.DataFrame, name: str, exog: list[str]) -> model.Data:
    x = pdf[exog].to_numpy(float) if name not in ("GARCH", "GJR") else np.zeros((len(pdf), 0))
    return model.Data(pdf["ret"].to_numpy(float), x, leverage=name != "GARCH")


def fit_models(rows: DataFrame, exog: list[str], models: tuple[str, ...] = ("GARCH", "GJR", "GJRX"), starts: int = 5, errors: bool = True, least: int = 100, seed: int = 0) -> DataFrame:
    """One fit for each (spec, asset, model): maps of parameters, standard errors and p-values, AIC and BIC.

    ``rows``: asset, date, ret, the regressors and optionally ``spec``. Series below ``least`` rows, and fits that do not
    converge, have ``converged`` false; their numbers are null or those of the best start. NaN becomes null.
    """
    if "spec" not in rows.columns:
        rows = rows.withColumn("spec", F.lit("all"))
    fan = rows.withColumn("model", F.explode(F.array(*map(F.lit, models))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna(subset=["ret"])
        name = pdf["model"].iloc[0] if len(pdf) else models[0]
        base = {"asset": pdf["asset"].iloc[0], "spec": pdf["spec"].iloc[0], "model": name, "n_obs": len(pdf)}
        if len(pdf) < least:
            return pd.DataFrame([{**base, "n_exog": 0, "converged": False, "log_lik": None, "params": {}, "std_errors": {}, "p_values": {}, "k": None, "aic": None, "bic": None, "persistence": None}])
        data = _data(pdf, name, exog)
        fit = model.fit_multistart(data, starts, seed)
        names = [*model.NAMES, *(exog if data.exog.shape[1] else [])]
        k, aic, bic = model.criteria(fit.negll, len(pdf), name, data.exog.shape[1])
        se = model.std_errors(data, fit.params) if errors else np.full(len(names), np.nan)
        p = model.p_values(fit.params, se, len(pdf), k)
        told = lambda v: {n: float(x) for n, x in zip(names, v, strict=True) if np.isfinite(x) and not (n == "gamma" and not data.leverage)}
        out = {**base, "n_exog": data.exog.shape[1], "converged": fit.ok, "log_lik": -fit.negll, "params": told(fit.params), "std_errors": told(se), "p_values": told(p), "k": k, "aic": aic, "bic": bic, "persistence": fit.persistence}
        return pd.DataFrame([out])

    return fan.groupBy("spec", "asset", "model").applyInPandas(one, _FIT)


def variance_paths(rows: DataFrame, fits: DataFrame, exog: list[str]) -> DataFrame:
    """(spec, asset, model, date, variance, resid, z) along each fit's series."""
    if "spec" not in rows.columns:
        rows = rows.withColumn("spec", F.lit("all"))
    joined = rows.join(fits.select("spec", "asset", "model", "params").where(F.size("params") > 0), ["spec", "asset"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna(subset=["ret"])
        told, name = dict(pdf["params"].iloc[0]), pdf["model"].iloc[0]
        data = _data(pdf, name, exog)
        p = np.array([told.get(n, 0.0) for n in [*model.NAMES, *(exog if data.exog.shape[1] else [])]])
        v = model.variance(data, p)
        return pd.DataFrame({"spec": pdf["spec"], "asset": pdf["asset"], "model": name, "date": pdf["date"], "variance": v, "resid": data.resid, "z": data.resid / np.sqrt(v)})

    return joined.groupBy("spec", "asset", "model").applyInPandas(one, "spec string, asset string, model string, date date, variance double, resid double, z double")


def diagnostics(paths: DataFrame) -> DataFrame:
    """Moments of standardised residuals, days on the floor, Ljung-Box and ARCH-LM of their squares at 5 and 10."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.sort_values("date")["z"].to_numpy(float)
        out = {c: pdf[c].iloc[0] for c in ("spec", "asset", "model")} | {"n": len(z), "mean_z": z.mean(), "var_z": z.var(), "floor_hits": int((pdf["variance"] <= model.FLOOR).sum())}
        for lag in (5, 10):
            q = regression.ljung_box(z * z, lag)
            lm, p = regression.arch_lm(z, lag)
            out |= {f"lb_{lag}": q, f"lb_p_{lag}": regression.chi2_sf(q, lag), f"lb_p_adjusted_{lag}": regression.chi2_sf(q, max(lag - 2, 1)), f"lm_{lag}": lm, f"lm_p_{lag}": p}
        return pd.DataFrame([out])

    numbers = ", ".join(f"{c}_{k} double" for k in (5, 10) for c in ("lb", "lb_p", "lb_p_adjusted", "lm", "lm_p"))
    return paths.groupBy("spec", "asset", "model").applyInPandas(one, f"spec string, asset string, model string, n long, mean_z double, var_z double, floor_hits long, {numbers}")


def fit_garch11(rows: DataFrame, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """GARCH(1,1) with its own bounds by group; groups below 100 rows are left out."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna(subset=["ret"])
        fit = model.garch11(pdf["ret"].to_numpy(float))
        if fit is None:
            return pd.DataFrame(columns=[*keys, "omega", "alpha", "beta", "nu", "persistence", "log_lik", "n_obs", "converged"])
        p = fit.params
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "omega": p[0], "alpha": p[1], "beta": p[3], "nu": p[4], "persistence": p[1] + p[3], "log_lik": -fit.negll, "n_obs": len(pdf), "converged": fit.ok}])

    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(one, f"{kinds}, omega double, alpha double, beta double, nu double, persistence double, log_lik double, n_obs long, converged boolean")


def garch11_variance(rows: DataFrame) -> DataFrame:
    """(asset, date, variance) of each asset's GARCH(1,1)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna(subset=["ret"])
        fit = model.garch11(pdf["ret"].to_numpy(float))
        if fit is None:
            return pd.DataFrame({"asset": [], "date": [], "variance": []})
        data = model.Data(pdf["ret"].to_numpy(float), np.zeros((len(pdf), 0)), leverage=False)
        return pd.DataFrame({"asset": pdf["asset"], "date": pdf["date"], "variance": model.variance(data, fit.params)})

    return rows.groupBy("asset").applyInPandas(one, "asset string, date date, variance double")


def detect_breaks(rows: DataFrame, value: str, most: int = 5, reps: int = 200) -> DataFrame:
    """(asset, break_no, break_date, ci_low, ci_high) of the mean of a series by asset, with bootstrap intervals."""
    from tidemark.models import breaks

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna(subset=[value])
        y, days = pdf[value].to_numpy(float), pdf["date"].tolist()
        out = []
        for k, at in enumerate(breaks.detect(y, most), 1):
            low, high = breaks.interval(y, at, reps)
            out.append({"asset": pdf["asset"].iloc[0], "break_no": k, "break_date": days[at], "ci_low": days[low], "ci_high": days[min(high, len(days) - 1)]})
        return pd.DataFrame(out, columns=["asset", "break_no", "break_date", "ci_low", "ci_high"])

    return rows.groupBy("asset").applyInPandas(one, "asset string, break_no int, break_date date, ci_low date, ci_high date")


def variance_fold(rets: DataFrame, omega: float, alpha: float, gamma: float, beta: float) -> DataFrame:
    """(asset, date, variance) of the recursion with fixed parameters, as a fold over each asset's ordered residuals."""
    mean = rets.groupBy("asset").agg(F.avg("ret").alias("m"), F.var_pop("ret").alias("v0"))
    rows = rets.join(mean, "asset").groupBy("asset", "v0").agg(F.sort_array(F.collect_list(F.struct("date", (F.col("ret") - F.col("m")).alias("e")))).alias("s"))

    def step(path, x):
        last = F.element_at(path, -1)
        v = omega + alpha * x.e * x.e + F.when(x.e < 0, gamma * x.e * x.e).otherwise(0.0) + beta * last
        return F.concat(path, F.array(F.greatest(v, F.lit(model.FLOOR))))

    path = F.aggregate(F.slice("s", F.lit(1), F.size("s") - 1), F.array(F.col("v0")), step)
    both = F.arrays_zip(F.col("s.date").alias("date"), path.alias("variance"))
    return rows.select("asset", F.explode(both).alias("r")).select("asset", F.col("r.date").alias("date"), F.col("r.variance").alias("variance"))


def event_impacts(fits: DataFrame, prefix: str, strong: float, weak: float) -> DataFrame:
    """(asset, name, value, flag_05, flag_10): the parameters whose name starts with a prefix, flagged by size."""
    rows = fits.select("asset", F.explode("params").alias("name", "value")).where(F.col("name").startswith(prefix))
    return rows.withColumns({"flag_05": F.abs("value") > strong, "flag_10": F.abs("value") > weak})
