"""Seed-indexed simulations as mapped functions over a table of seeds; a draw depends on its seed alone.

The fitted process is one broadcast object of fixed shape (days by assets); a task returns scalars.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.models import copula, garch, resampling

DELTA_CAP = 50.0
DRAWS = "seed long, dbar double, fits long, rescues long, rescued long, floor_hits long, exploded long"


def grouped_difference(rows: DataFrame, value: str, group: str = "type", first: str = "Infrastructure", reps: int = 5000, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """Bootstrap of the difference of two means, for each key: diff, ci_low, ci_high, p_two, p_one, se."""
    key = list(keys) or ["_all"]
    data = rows if keys else rows.withColumn("_all", F.lit(1))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([group, *sorted(c for c in pdf.columns if c not in (group, value)), value])
        a, b = pdf.loc[pdf[group] == first, value].to_numpy(float), pdf.loc[pdf[group] != first, value].to_numpy(float)
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*key, "diff", "ci_low", "ci_high", "p_two", "p_one", "se"])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in key}, **resampling.difference(a, b, reps, seed)}])

    kinds = ", ".join(f"{k} {dict(data.dtypes)[k]}" for k in key)
    out = data.groupBy(*key).applyInPandas(one, f"{kinds}, diff double, ci_low double, ci_high double, p_two double, p_one double, se double")
    return out if keys else out.drop("_all")


def grouped_bca(rows: DataFrame, value: str, key: str, reps: int = 2000, seed: int = 42, statistic=np.mean) -> DataFrame:
    """BCa interval of a statistic by group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].dropna().to_numpy(float))
        if len(x) < 2:
            return pd.DataFrame(columns=[key, "statistic", "ci_low", "ci_high", "sd", "p", "bias", "acceleration"])
        return pd.DataFrame([{key: pdf[key].iloc[0], **resampling.bca(x, reps, 0.95, seed, statistic)}])

    return rows.groupBy(key).applyInPandas(one, f"{key} {dict(rows.dtypes)[key]}, statistic double, ci_low double, ci_high double, sd double, p double, bias double, acceleration double")


def bootstrap_did(rows: DataFrame, value: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """One row: the difference in differences of (type, post, value) with its bootstrap interval."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = lambda t, p: np.sort(pdf.loc[(pdf["type"] == t) & (pdf["post"] == p), value].to_numpy(float))
        cells = {f"{k}_{n}": cell(t, p) for k, t in (("infra", "Infrastructure"), ("reg", "Regulatory")) for n, p in (("pre", False), ("post", True))}
        return pd.DataFrame([resampling.did(cells, reps, seed)] if all(len(c) for c in cells.values()) else [], columns=["did", "ci_low", "ci_high", "p", "sd"])

    return rows.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(one, "did double, ci_low double, ci_high double, p double, sd double")


@dataclass
class Process:
    """A fitted panel: for each asset its regressors, places on the shared calendar, variance paths and parameters."""

    assets: list[str]
    n_days: int
    place: dict[str, np.ndarray]
    exog: dict[str, np.ndarray]
    mean: dict[str, float]
    var0: dict[str, float]
    null_path: dict[str, np.ndarray]
    free_path: dict[str, np.ndarray]
    null_params: dict[str, np.ndarray]
    free_params: dict[str, np.ndarray]
    resid: dict[str, np.ndarray]
    correlation: np.ndarray

    @property
    def gaps(self) -> np.ndarray:
        return np.array([self.free_params[a][5] - self.free_params[a][6] for a in self.assets])

    @property
    def dbar(self) -> float:
        return float(self.gaps.mean())


def fit_process(rows: DataFrame, exog: list[str], starts: int = 4, seed: int = 0) -> Process:
    """Fits both models to every asset: free (two event terms) and null (their sum), in parallel by asset.

    The result has one number for each asset and day; it is what is broadcast to the draws. ``exog`` begins with the two
    event terms.
    """
    kind = "asset string, date date, place long, var_null double, var_free double, resid double, x array<double>, p_null array<double>, p_free array<double>, mean double, var0 double"
    from tidemark.operators.calendar import positions

    data = rows.join(positions(rows), "date")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").dropna(subset=["ret"])
        x, r = pdf[exog].to_numpy(float), pdf["ret"].to_numpy(float)
        free = garch.Data(r, x)
        null = garch.Data(r, np.column_stack([x[:, 0] + x[:, 1], x[:, 2:]]))
        f, g = garch.fit_multistart(free, starts, seed), garch.fit_multistart(null, starts, seed + 1)
        n = len(pdf)
        first = lambda v: [list(map(float, v))] + [None] * (n - 1)
        return pd.DataFrame({"asset": pdf["asset"], "date": pdf["date"], "place": pdf["position"], "var_null": garch.variance(null, g.params), "var_free": garch.variance(free, f.params), "resid": free.resid, "x": list(x), "p_null": first(g.params), "p_free": first(f.params), "mean": free.mean, "var0": free.var0})

    table = data.groupBy("asset").applyInPandas(one, kind).toPandas().sort_values(["asset", "place"])  # days by assets
    by = {a: g for a, g in table.groupby("asset")}
    assets = sorted(by)
    z = {a: pd.Series((g["resid"] / np.sqrt(g["var_free"])).to_numpy(), index=g["place"].to_numpy()) for a, g in by.items()}
    wide = pd.DataFrame(z).dropna()
    pick = lambda c: {a: by[a][c].to_numpy(float) for a in assets}
    head = lambda c: {a: np.array(by[a][c].iloc[0], float) for a in assets}
    return Process(
        assets, int(table["place"].max()) + 1, {a: by[a]["place"].to_numpy(int) for a in assets}, {a: np.array(by[a]["x"].tolist(), float) for a in assets},
        {a: float(by[a]["mean"].iloc[0]) for a in assets}, {a: float(by[a]["var0"].iloc[0]) for a in assets}, pick("var_null"), pick("var_free"), head("p_null"), head("p_free"), pick("resid"), wide[assets].corr().to_numpy(),
    )


SCHEMES = ("gaussian_null", "gaussian_free", "wild", "student_null", "student_free", "recursive_null")


def simulate(process: Process, scheme: str, seed: int, root: np.ndarray, nu_copula: float | None = 6.0) -> tuple[dict[str, np.ndarray], int, int]:
    """(returns by asset, days on the floor, assets that exploded) of one draw."""
    rng = np.random.default_rng(seed)
    null = scheme.endswith("null")
    if scheme == "wild":
        eta = copula.signs(rng, process.n_days)
        return {a: process.mean[a] + eta[process.place[a]] * process.resid[a] for a in process.assets}, 0, 0
    if scheme.startswith("gaussian"):
        z = copula.gaussian(rng, root, process.n_days)
    else:
        params = process.null_params if null else process.free_params
        z = copula.student(rng, root, np.array([params[a][4] for a in process.assets]), nu_copula, process.n_days)
    out, floor, exploded = {}, 0, 0
    for j, a in enumerate(process.assets):
        own = z[process.place[a], j]
        if scheme == "recursive_null":
            x = process.exog[a]
            r, _, hits, bad = garch.simulate(rng, process.null_params[a], np.column_stack([x[:, 0] + x[:, 1], x[:, 2:]]), process.var0[a], process.mean[a], own)
            out[a], floor, exploded = r, floor + hits, exploded + bad
        else:
            out[a] = process.mean[a] + own * np.sqrt((process.null_path if null else process.free_path)[a])
    return out, floor, exploded


def refit(process: Process, returns: dict[str, np.ndarray], rescue_seed: int = 20260807) -> tuple[np.ndarray | None, int, int, int]:
    """(gap of the two event terms by asset or None, fits made, rescues tried, rescues that worked).

    A fit that does not converge, or whose event terms exceed the cap, is tried again from six starts, once.
    """
    gaps, fits, tried, worked = [], 0, 0, 0
    fine = lambda f: f.ok and abs(f.params[5]) <= DELTA_CAP and abs(f.params[6]) <= DELTA_CAP
    for a in process.assets:
        data = garch.Data(returns[a], process.exog[a])
        found = garch.fit(data)
        fits += 1
        if not fine(found):
            tried += 1
            found = garch.fit_multistart(data, 6, rescue_seed)
            fits += 6
            if not fine(found):
                return None, fits, tried, worked
            worked += 1
        gaps.append(found.params[5] - found.params[6])
    return np.array(gaps), fits, tried, worked


def draw_table(spark: SparkSession, process: Process, scheme: str, n: int, base_seed: int, nu_copula: float | None = 6.0, by_asset: bool = False) -> DataFrame:
    """(seed, dbar, telemetry) of n draws with seeds base_seed + 0..n-1; an excluded draw has a null dbar.

    With ``by_asset`` a further array has each asset's gap. Draws are dealt evenly, whatever the number of tasks.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"scheme is one of {SCHEMES}")
    sent, root = spark.sparkContext.broadcast(process), copula.positive_root(process.correlation)[0]

    def task(parts):
        for pdf in parts:
            rows = []
            for seed in pdf["id"].tolist():
                returns, floor, exploded = simulate(sent.value, scheme, seed, root, nu_copula)
                gaps, fits, tried, worked = (None, 0, 0, 0) if exploded else refit(sent.value, returns)
                rows.append((seed, None if gaps is None else float(gaps.mean()), fits, tried, worked, floor, exploded, None if gaps is None else gaps.tolist()))
            yield pd.DataFrame(rows, columns=["seed", "dbar", "fits", "rescues", "rescued", "floor_hits", "exploded", "gaps"])

    width = max(1, min(n, spark.sparkContext.defaultParallelism * 4))
    out = spark.range(base_seed, base_seed + n, 1, width).mapInPandas(task, f"{DRAWS}, gaps array<double>")
    return out if by_asset else out.drop("gaps")


def panel_table(spark: SparkSession, process: Process, n: int, base_seed: int, nu_copula: float | None = 6.0) -> DataFrame:
    """(seed, dbar, t_naive, rbar) of n null panels: what the four decision rules of a size study need."""
    sent, root = spark.sparkContext.broadcast(process), copula.positive_root(process.correlation)[0]
    m = len(process.assets)
    upper = np.triu_indices(m, 1)

    def task(parts):
        for pdf in parts:
            rows = []
            for seed in pdf["id"].tolist():
                p = sent.value
                returns, _, _ = simulate(p, "student_null", seed, root, nu_copula)
                gaps, *_ = refit(p, returns)
                wide = pd.DataFrame({a: pd.Series(returns[a], index=p.place[a]) for a in p.assets}).dropna()
                rbar = float(wide.corr().to_numpy()[upper].mean())
                t = None if gaps is None or gaps.std(ddof=1) == 0 else float(gaps.mean() / (gaps.std(ddof=1) / np.sqrt(m)))
                rows.append((seed, None if gaps is None else float(gaps.mean()), t, rbar))
            yield pd.DataFrame(rows, columns=["seed", "dbar", "t_naive", "rbar"])

    width = max(1, min(n, spark.sparkContext.defaultParallelism * 4))
    return spark.range(base_seed, base_seed + n, 1, width).mapInPandas(task, "seed long, dbar double, t_naive double, rbar double")


def with_tails(process: Process, nu: float | None) -> Process:
    """The process with ``nu`` degrees of freedom in every margin; None: as fitted."""
    if nu is None:
        return process
    told = lambda params: {a: np.concatenate([v[:4], [nu], v[5:]]) for a, v in params.items()}
    return replace(process, null_params=told(process.null_params), free_params=told(process.free_params))


def decisions(panels: DataFrame, gaussian: DataFrame, student: DataFrame, n_assets: int, t_critical: dict[float, float]) -> DataFrame:
    """(rule, alpha, size, n, se): one-sided rejection rates of the naive t, the deflated t, and two reference laws.

    ``t_critical``: for each level the critical value of t. A law without draws, or no panel at all, gives a null size.
    """
    crit = lambda law, name: law.agg(*(F.percentile("dbar", F.lit(1 - a)).alias(f"{name}_{k}") for k, a in enumerate(t_critical)))
    rows = panels.where("dbar is not null and t_naive is not null")
    deff = F.greatest(1 + (n_assets - 1) * F.col("rbar"), F.lit(1e-9))
    tested = []
    for k, (alpha, t) in enumerate(t_critical.items()):
        rules = {"naive": F.col("t_naive") > t, "design_effect": F.col("t_naive") / F.sqrt(deff) > t, "gaussian": F.col("dbar") > F.col(f"g_{k}"), "t_copula": F.col("dbar") > F.col(f"s_{k}")}
        tested += [F.struct(F.lit(rule).alias("rule"), F.lit(alpha).alias("alpha"), v.cast("double").alias("reject")) for rule, v in rules.items()]
    laws = crit(gaussian, "g").crossJoin(crit(student, "s"))  # one row
    told = laws.join(rows, F.lit(True), "left").select(F.explode(F.array(*tested)).alias("r")).select("r.*")
    out = told.groupBy("rule", "alpha").agg(F.avg("reject").alias("size"), F.count("reject").alias("n"))
    return out.withColumn("se", F.sqrt(F.try_divide(F.col("size") * (1 - F.col("size")), "n")))


def paired(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: draws with both seeds, mean difference, its sd, share in which the other is larger."""
    both = base.select("seed", F.col("dbar").alias("a")).join(other.select("seed", F.col("dbar").alias("b")), "seed").where("a is not null and b is not null")
    return both.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(F.col("b") - F.col("a")).alias("mean_diff"), F.stddev_samp(F.col("b") - F.col("a")).alias("sd_diff"), F.avg((F.col("b") > F.col("a")).cast("double")).alias("share_larger"))
