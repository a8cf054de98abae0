"""Fitted and simulated operators (inventory P rows): tests, fits, change points, bootstraps. Rows-only; tests hold the properties."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import distributions as dist
from tidemark.functions.special import t_ppf
from tidemark.operators import bootstrap as bs
from tidemark.operators import calendar as cal
from tidemark.operators import event_study as es
from tidemark.operators import garch, granger
from tidemark.operators import statistics as st
from tidemark.operators import timeseries as ts
from tidemark.operators import windows as win
from tidemark.plans.registry import BASE, CFG, CUTOFF, candidates, events, query, rets, rounded, weeks
from tidemark.plans.relational import _breaks, _census, integration_verdict
from tidemark.plans.studies import _abnormal, cars, levels
from tidemark.sources import adapters

SERIES = ["s_all", "s_reg", "s_infra"]
#: Draws of a simulated query; a parameter of the operators. Published runs take 500 to 4000: TIDEMARK_DRAWS asks for more.
DRAWS = int(os.environ.get("TIDEMARK_DRAWS", "200"))
#: Panels of the size study and of each of its scenarios, and draws of each reference law there.
PANELS, LAW = max(2, DRAWS // 2), max(2, DRAWS // 2)
#: The daily spread, in percent, that the returns of the simulated panels are brought to: that of the series which the
#: bound on event terms (bootstrap.DELTA_CAP) is meant for. The driver's tables have ten times that.
SPREAD = 4.0


def _weekly(spark, d):
    z = ts.decompose(ts.rolling_zscore(weeks(spark, d), "raw", "week_start"))
    rows = ts.zero_before(z, ["z", "reg", "infra"], CUTOFF, "week_start")
    return rows.select("week_start", F.col("z").alias("s_all"), F.col("reg").alias("s_reg"), F.col("infra").alias("s_infra"))


def _daily(spark, d):
    w = _weekly(spark, d)
    days = ts.daily_calendar(w.select(F.col("week_start").alias("date")), rets(spark, d))
    return ts.fill_zero(ts.carry_forward(w, days, SERIES), SERIES)


def _vol(spark, d):
    return ts.weekly_volatility(rets(spark, d), weeks(spark, d))


def _weekly_pairs(spark, d):
    return granger.pairs(_vol(spark, d), _weekly(spark, d), SERIES, "wk_absvol", "week_start")


def design(spark, d, days=None):
    r = ts.global_winsorise(rets(spark, d)).select("asset", "date", F.col("ret_w").alias("ret"))
    dummies = win.event_dummies(r.select("date").distinct(), events(spark, d) if days is None else days)
    return garch.design(r, dummies, _daily(spark, d), cal.common_calendar(r))


#: The two-sided tail of Student's t for a whole number of degrees of freedom, by its finite series in cos(theta).
T_TAIL = """greatest(0, 1 - CASE WHEN df % 2 = 0
    THEN sin(th) * list_sum(list_transform(range(CAST(df / 2 AS BIGINT)), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)) * power(cos(th), 2 * k)))
    ELSE 2 / pi() * (th + coalesce(sin(th) * list_sum(list_transform(range(CAST((df - 1) / 2 AS BIGINT)), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * power(cos(th), 2 * k + 1))), 0)) END)"""


@query(f"SELECT event_id, asset, round(sar, 6) + 0 AS sar, round({T_TAIL}, 6) + 0 AS p FROM (SELECT *, est_n - 1 AS df, atan(abs(sar) / sqrt(est_n - 1)) AS th FROM cm WHERE status = 'ok')")
def k1_student_t_p(spark, d):
    return rounded(cars(spark, d).where("status = 'ok'").select("event_id", "asset", "sar", dist.t_two_sided(F.col("sar"), (F.col("est_n") - 1).cast("double")).alias("p")))


@query()
def k1_student_t_quantile(spark, d):
    return cars(spark, d).where("status = 'ok'").select("event_id", "asset", dist.t_quantile(F.lit(0.975), (F.col("est_n") - 1).cast("double")).alias("t_crit"))


@query()
def e5_cross_sectional(spark, d):
    kp = es.kolari_pynnonen(_abnormal(spark, d)).withColumn("p", dist.t_two_sided(F.col("t_kp"), F.col("df").cast("double")))
    sums = _abnormal(spark, d).groupBy("event_id", "date").agg(F.avg("ar").alias("aar"))
    ci = bs.grouped_bca(sums, "aar", "event_id", 5000, CFG.seed, np.sum)
    return kp.join(ci.select("event_id", "ci_low", "ci_high", F.col("p").alias("p_bootstrap")), "event_id", "left")


@query()
def e9_gate(spark, d):
    rows, every = None, rets(spark, d, "simple")
    for basis, cut in (("six", every), ("five", every.where("asset <> 'RO'"))):
        lv = es.event_level(es.constant_mean(cut, events(spark, d), CFG))
        one = es.difference_by_type(lv).select("mean_infra", "mean_reg", "diff").crossJoin(bs.grouped_difference(lv, "mean_car").drop("diff")).crossJoin(st.welch(lv, "mean_car").select("t", "df", "mde")).withColumn("basis", F.lit(basis))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("""SELECT asset, n, round((n - 1) * corr(q, q1) * corr(q, q1), 6) + 0 AS lm FROM (
  SELECT asset, count(*) OVER (PARTITION BY asset) AS n, ret * ret AS q, lag(ret * ret) OVER (PARTITION BY asset ORDER BY date) AS q1 FROM ret) WHERE q1 IS NOT NULL GROUP BY 1, 2""")
def k13_arch_lm_one_lag(spark, d):
    """Engle's test at one lag: n R^2 of a line through successive squares."""
    import pandas as pd

    from tidemark.models import regression

    def one(pdf):
        x = pdf.sort_values("date")["ret"].to_numpy(float)
        return pd.DataFrame([{"asset": pdf["asset"].iloc[0], "n": len(x), "lm": regression.arch_lm(x, 1)[0]}])

    return rounded(rets(spark, d).groupBy("asset").applyInPandas(one, "asset string, n long, lm double"))


@query()
def k13_arch_lm(spark, d):
    paths = rets(spark, d).select(F.lit("all").alias("spec"), "asset", F.lit("returns").alias("model"), "date", F.lit(1.0).alias("variance"), F.col("ret").alias("resid"), F.col("ret").alias("z"))
    return garch.diagnostics(paths).select("asset", "n", "lm_5", "lm_p_5", "lm_10", "lm_p_10")


#: F of one lag of x in y's equation with one lag of y, from the partial correlation; its p is that of t = sqrt(F).
_GRANGER = """lagged AS (SELECT v.asset, v.week_start, v.wk_absvol AS y, z.x, z.sentiment FROM wkvol v JOIN ({series}) z USING (week_start) WHERE v.wk_absvol IS NOT NULL AND z.x IS NOT NULL),
l1 AS (SELECT asset, sentiment, y, lag(y) OVER w AS y1, lag(x) OVER w AS x1 FROM lagged WINDOW w AS (PARTITION BY asset, sentiment ORDER BY week_start)),
pc AS (SELECT asset, sentiment, count(*) + 1 AS n, corr(y, x1) AS ryx, corr(y, y1) AS ryy, corr(x1, y1) AS rxy FROM l1 WHERE y1 IS NOT NULL GROUP BY 1, 2),
ft AS (SELECT *, n - 4 AS df, r2 / (1 - r2) * (n - 4) AS f FROM (SELECT *, power(ryx - ryy * rxy, 2) / ((1 - ryy * ryy) * (1 - rxy * rxy)) AS r2 FROM pc))"""
_SENTIMENT = " UNION ALL ".join(f"SELECT week_start, '{n}' AS sentiment, CASE WHEN week_start < DATE '{CUTOFF}' THEN 0 ELSE coalesce({c}, 0) END AS x FROM zs" for n, c in (("s_all", "z"), ("s_reg", "z * reg_proportion"), ("s_infra", "z * infra_proportion")))


@query(BASE.rstrip() + ",\n" + _GRANGER.format(series=_SENTIMENT) + f" SELECT asset, sentiment, 'x_to_y' AS direction, round(f, 6) + 0 AS f, round({T_TAIL}, 6) + 0 AS p, n FROM (SELECT *, atan(sqrt(f / df)) AS th FROM ft)")
def k16_granger_one_lag(spark, d):
    return rounded(granger.granger_min_p(_weekly_pairs(spark, d), "week_start", 1, 40).select("asset", "sentiment", "direction", "f", "p", "n"))


@query()
def k16_granger_weekly(spark, d):
    found = granger.granger_min_p(_weekly_pairs(spark, d), "week_start", 8, 40, both_ways=True)
    return st.benjamini_hochberg(found, "p", ["asset", "sentiment"], ["direction"])


@query()
def k16_granger_daily(spark, d):
    rows = granger.pairs(rets(spark, d), _daily(spark, d), SERIES, "ret", "date")
    return granger.granger_min_p(rows, "date", 10, 100, both_ways=True)


@query()
def k17_conditional_granger(spark, d):
    vol = _vol(spark, d)
    others = es.market_without(vol.select("asset", F.col("week_start").alias("date"), F.col("wk_absvol").alias("ret")), complete=False).select("asset", F.col("date").alias("week_start"), F.col("mkt").alias("control"))
    return granger.conditional(_weekly_pairs(spark, d).join(others, ["asset", "week_start"], "left"), "week_start", ["control"], 8)


@query()
def k18_granger_given_events(spark, d):
    ev = win.events_by_week(weeks(spark, d), events(spark, d)).select("week_start", F.col("ev_infra").cast("double").alias("c1"), F.col("ev_reg").cast("double").alias("c2"))
    return granger.conditional(_weekly_pairs(spark, d).join(ev, "week_start"), "week_start", ["c1", "c2"], 8, contemporaneous=True)


@query()
def k19_toda_yamamoto(spark, d):
    found = granger.toda_yamamoto(_weekly_pairs(spark, d), "week_start", 8)
    return st.benjamini_hochberg(found, "p", ["asset", "sentiment"], [])


@query()
def k20_stationarity(spark, d):
    found = granger.stationarity(_vol(spark, d), "week_start", "wk_absvol")
    return found.withColumn("verdict", integration_verdict(F.col("adf_p") < 0.05, F.col("kpss_p") < 0.05))


@query()
def k21_missingness(spark, d):
    k = weeks(spark, d)
    edge = k.agg(F.date_add(F.min("week_start"), 182).alias("edge"))
    rows = _vol(spark, d).crossJoin(F.broadcast(edge)).withColumn("imputed", (F.col("week_start") < F.col("edge")).cast("int"))
    return granger.missingness(rows, "week_start", "imputed", "wk_absvol")


@query()
def k22_sub_periods(spark, d):
    ev = win.events_by_week(weeks(spark, d), events(spark, d)).select("week_start", F.col("ev_all").cast("double").alias("c1"))
    periods = {"before": "week_start < date'1998-07-01'", "during": "week_start >= date'1998-07-01'"}
    return granger.by_period(_weekly_pairs(spark, d).join(ev, "week_start"), "week_start", periods, ["c1"])


@query()
def f3_gjr_garch_x(spark, d):
    """F2 to F6 and F10: the full model by asset with likelihood, bounds, multistart and standard errors."""
    return garch.fit_models(design(spark, d), garch.EXOG, ("GJRX",), starts=12)


@query()
def f7_garch11(spark, d):
    return garch.fit_garch11(rets(spark, d))


@query()
def f11_model_ladder(spark, d):
    """F8, F9 and F11: three models by asset (gamma left out of the first), AIC, BIC, winner and margin."""
    fits = garch.fit_models(design(spark, d), garch.EXOG, ("GARCH", "GJR", "GJRX"), starts=12, errors=False)
    return fits.join(st.best_model(fits.where("converged"), ["asset"], "model", "aic"), "asset", "left")


@query()
def f12_diagnostics(spark, d):
    rows = design(spark, d)
    return garch.diagnostics(garch.variance_paths(rows, garch.fit_models(rows, garch.EXOG, ("GJRX",), starts=6, errors=False), garch.EXOG))


@query()
def f14_change_points(spark, d):
    """F14 and F15 on absolute returns and on fitted variances."""
    r = rets(spark, d)
    a = garch.detect_breaks(r.withColumn("y", F.abs("ret")), "y").withColumn("series", F.lit("abs_return"))
    b = garch.detect_breaks(garch.garch11_variance(r), "variance").withColumn("series", F.lit("cond_variance"))
    return a.unionByName(b)


@query()
def f16_segment_refits(spark, d):
    rows = win.regime_segments(rets(spark, d), _breaks(spark, d))
    return garch.fit_garch11(rows, ("asset", "segment"))


@query()
def f17_specification_sweep(spark, d):
    """The full model under four event lists, with the cross-asset summary of its event terms."""
    pool = _census(spark, d)
    lists = {"baseline": events(spark, d), "relaxed": pool.where("n_moved >= 1"), "nofilter": pool, "strict": pool.where("n_moved >= 3")}
    rows = None
    for name, days in lists.items():
        part = design(spark, d, days.select("event_id", "type", "date")).withColumn("spec", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return _gaps(rows)


@query()
def f17_break_controls(spark, d):
    """The full model without regimes, with a crisis regressor, and with one for each regime after the first."""
    rows, breaks = design(spark, d), _breaks(spark, d)
    crisis = rows.join(win.crisis_dummy(rows.select("asset", "date"), breaks, 1998), ["asset", "date"])
    regimes = rows.join(win.regime_segments(rows.select("asset", "date"), breaks).select("asset", "date", "segment"), ["asset", "date"])
    most = regimes.agg(F.max("segment")).first()[0] or 0  # an asset has at most a handful of breaks
    names = [f"regime_{k}" for k in range(1, most + 1)]
    regimes = regimes.select("*", *(F.when(F.col("segment") == k, 1.0).otherwise(0.0).alias(n) for k, n in enumerate(names, 1)))
    out = None
    for name, part, more in (("none", rows, []), ("crisis", crisis, ["crisis"]), ("full_regime", regimes, names)):
        fits = garch.fit_models(part, [*garch.EXOG, *more], ("GJRX",), 2, False).withColumn("variant", F.lit(name))
        out = fits if out is None else out.unionByName(fits)
    return out


def _gaps(rows, starts=2):
    """Summary over assets of the two event terms, by spec, of the fits that converged, and how many did not."""
    fits = garch.fit_models(rows, garch.EXOG, ("GJRX",), starts=starts, errors=False)
    coef = fits.where("converged").select("spec", "asset", F.col("params")["d_infrastructure"].alias("a"), F.col("params")["d_regulatory"].alias("b"))
    lost = fits.groupBy("spec").agg(F.count_if(~F.col("converged")).alias("n_not_converged"))
    return st.coefficient_summary(coef, "spec", "a", "b").join(lost, "spec", "right")


@query()
def f17_winsoriser_sweep(spark, d):
    """Two winsorisers by five event lists: those of the four census specs and the baseline without its first year."""
    pool, base, out = _census(spark, d), events(spark, d), None
    lists = {"baseline": base, "relaxed": pool.where("n_moved >= 1"), "nofilter": pool, "strict": pool.where("n_moved >= 3"), "late": base.where(f"date >= date'{CUTOFF}'")}
    r = rets(spark, d)
    for winsoriser, clipped in (("global", ts.global_winsorise(r)), ("rolling", ts.rolling_winsorise(r))):
        clipped = clipped.select("asset", "date", F.col("ret_w").alias("ret")).where("ret is not null")
        for name, days in lists.items():
            dummies = win.event_dummies(clipped.select("date").distinct(), days.select("event_id", "type", "date"))
            part = garch.design(clipped, dummies, _daily(spark, d), cal.common_calendar(clipped)).withColumn("spec", F.lit(f"{winsoriser} {name}"))
            out = part if out is None else out.unionByName(part)
    return _gaps(out, 1)


@query()
def f17_mean_equation(spark, d):
    """The full model on returns less their mean and on what an AR(1) leaves of them."""
    rows = design(spark, d)
    ar1 = st.ar1_filter(rows).select("asset", "date", F.col("residual").alias("ret"), *garch.EXOG)
    return _gaps(rows.withColumn("spec", F.lit("constant")).unionByName(ar1.withColumn("spec", F.lit("ar1"))))


@query()
def f17_pre_window_sweep(spark, d):
    """Regulatory windows of 3, 5, 7 and 10 days before the event."""
    r = ts.global_winsorise(rets(spark, d)).select("asset", "date", F.col("ret_w").alias("ret"))
    rows = None
    for b in (3, 5, 7, 10):
        dummies = win.asymmetric_dummies(r.select("date").distinct(), events(spark, d), {"Infrastructure": (3, 3), "Regulatory": (b, 3)})
        part = garch.design(r, dummies, _daily(spark, d), cal.common_calendar(r)).withColumn("spec", F.lit(f"before_{b}"))
        rows = part if rows is None else rows.unionByName(part)
    return _gaps(rows, 5)


@query()
def b1_bca_interval(spark, d):
    return bs.grouped_bca(levels(spark, d), "mean_car", "type", 5000, CFG.seed)


@query()
def b2_block_bootstrap(spark, d):
    return bs.grouped_difference(levels(spark, d), "mean_car", reps=5000, seed=CFG.seed)


@query()
def b3_pooled_bootstrap(spark, d):
    return bs.grouped_difference(cars(spark, d).where("status = 'ok'").select("event_id", "asset", "type", "car"), "car", reps=5000, seed=CFG.seed)


@query()
def b5_did_bootstrap(spark, d):
    rows = candidates(spark, d).select("type", (F.year("date") >= 1998).alias("post"), "magnitude")
    return bs.bootstrap_did(rows, "magnitude", 5000, CFG.seed)


def _process(spark, d):
    rows = design(spark, d)
    spread = rows.groupBy("asset").agg(F.stddev_samp("ret").alias("sd"))
    rows = rows.join(F.broadcast(spread), "asset").withColumn("ret", F.try_divide(F.col("ret") * SPREAD, "sd")).drop("sd")  # a row for each asset
    return bs.fit_process(rows, garch.EXOG)


def _scheme(spark, d, scheme: str, nu: float | None = 6.0):
    p = _process(spark, d)
    return st.draw_summary(bs.draw_table(spark, p, scheme, DRAWS, 1000, nu), p.dbar, sums=("fits",)).withColumn("observed", F.lit(p.dbar))


@query()
def b6_gaussian_null(spark, d):
    return _scheme(spark, d, "gaussian_null")


def _reflected(draws, p):
    q = draws.agg(F.percentile("dbar", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.count("dbar").alias("n_used"), F.count_if(F.col("dbar").isNull()).alias("n_dropped"))
    return q.select(F.lit(p.dbar).alias("observed"), (2 * F.lit(p.dbar) - F.col("q")[2]).alias("ci_low"), (2 * F.lit(p.dbar) - F.col("q")[0]).alias("ci_high"), (F.col("q")[1] - F.lit(p.dbar)).alias("median_bias"), "n_used", "n_dropped")


@query()
def b7_free_draws(spark, d):
    """Unrestricted draws: the reflected interval of the mean gap and its median bias."""
    p = _process(spark, d)
    return _reflected(bs.draw_table(spark, p, "gaussian_free", DRAWS, 2000), p)


@query()
def b8_wild(spark, d):
    return _scheme(spark, d, "wild")


@query()
def b9_student_copula(spark, d):
    return _scheme(spark, d, "student_null")


@query()
def b10_matched_gaussian_copula(spark, d):
    """Student-t margins under both copulas, paired by seed."""
    p = _process(spark, d)
    return bs.paired(bs.draw_table(spark, p, "student_null", DRAWS, 3000, 6.0), bs.draw_table(spark, p, "student_null", DRAWS, 3000, None))


@query()
def b10_student_free(spark, d):
    """Unrestricted t-copula draws without and with a crisis regressor: reflected interval and median bias of the gap."""
    rows, out = design(spark, d), None
    crisis = rows.join(win.crisis_dummy(rows.select("asset", "date"), _breaks(spark, d), 1998), ["asset", "date"])
    spread = rows.groupBy("asset").agg(F.stddev_samp("ret").alias("sd"))
    for name, part, exog in (("baseline", rows, garch.EXOG), ("crisis", crisis, [*garch.EXOG, "crisis"])):
        scaled = part.join(F.broadcast(spread), "asset").withColumn("ret", F.try_divide(F.col("ret") * SPREAD, "sd")).drop("sd")
        p = bs.fit_process(scaled, exog)
        one = _reflected(bs.draw_table(spark, p, "student_free", PANELS, 3500), p).withColumn("spec", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def b11_recursive_null(spark, d):
    p = _process(spark, d)
    return st.draw_summary(bs.draw_table(spark, p, "recursive_null", DRAWS, 4000), p.dbar, sums=("floor_hits", "exploded"))


@query()
def b12_rescued_refits(spark, d):
    p = _process(spark, d)
    return bs.draw_table(spark, p, "student_null", DRAWS, 5000).agg(F.count(F.lit(1)).alias("n"), F.sum("rescues").alias("rescues"), F.sum("rescued").alias("rescued"), F.count_if(F.col("dbar").isNull()).alias("excluded"))


def _decided(spark, p, panels, gaussian, student):
    critical = {a: float(t_ppf(1 - a, len(p.assets) - 1)) for a in (0.05, 0.10)}
    return bs.decisions(panels, gaussian, student, len(p.assets), critical)


@query()
def b13_size_study(spark, d):
    """One-sided rejection rates of four rules at 0.05 and 0.10 over null panels."""
    p = _process(spark, d)
    law = lambda nu, seed: bs.draw_table(spark, p, "student_null", LAW, seed, nu)
    return _decided(spark, p, bs.panel_table(spark, p, PANELS, 6000), law(None, 7000), law(6.0, 8000))


#: Scenarios of the size study: degrees of freedom of the margins (None: fitted) and of the copula, simulated and calibrated.
SCENARIOS = {
    "S0 baseline": (None, 6.0, None, 6.0),
    "S1 lighter tails": (8.0, 6.0, 8.0, 6.0),
    "S2 heavier tails": (2.5, 6.0, 2.5, 6.0),
    "S3 near-Gaussian copula": (None, 200.0, None, 200.0),
    "S4 calibrated at fitted tails": (2.5, 6.0, None, 6.0),
}


@query()
def b14_perturbed_process(spark, d):
    """The size study under other tails and copulas, on common seeds; a reference law is drawn once for each calibration."""
    p, laws, out = _process(spark, d), {}, None
    n = max(2, PANELS // 2)
    gaussian = bs.draw_table(spark, p, "student_null", n, 9000, None).persist()
    for name, (nu, copula_nu, told_nu, told_copula) in SCENARIOS.items():
        if (told_nu, told_copula) not in laws:
            laws[told_nu, told_copula] = bs.draw_table(spark, bs.with_tails(p, told_nu), "student_null", n, 9500, told_copula).persist()
        panels = bs.panel_table(spark, bs.with_tails(p, nu), n, 6000, copula_nu)
        one = _decided(spark, p, panels, gaussian, laws[told_nu, told_copula]).withColumn("scenario", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def b15_copula_df_grid(spark, d):
    p, base, rows = _process(spark, d), None, None
    for nu in (3.83, 5.9, 8.0):
        draws = bs.draw_table(spark, p, "student_null", PANELS, 10_000, nu).persist()  # a row for each draw
        base = draws if base is None else base
        part = st.draw_summary(draws, p.dbar).crossJoin(bs.paired(base, draws)).withColumn("nu_copula", F.lit(nu))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query()
def b16_asset_gaps(spark, d):
    """Correlation and covariance of the assets' gaps over draws, and the design effect of their mean."""
    p = _process(spark, d)
    draws = bs.draw_table(spark, p, "student_null", DRAWS, 11_000, by_asset=True)
    long = draws.where("gaps is not null").select("seed", F.posexplode("gaps").alias("a", "x"))
    return long.join(long.select("seed", F.col("a").alias("b"), F.col("x").alias("y")), "seed").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"))


@query("""SELECT 'panel, halved' AS matrix, 0e0 AS jitter UNION ALL SELECT 'one series for all', 1e-8""")
def b17_positive_definite(spark, d):
    """Jitter that makes correlations positive definite: none for half the panel's, the least if all series were one."""
    from tidemark.models.copula import positive_root

    rows = st.correlations(rets(spark, d)).select("a", "b", "corr").toPandas()  # assets by assets
    r = rows.pivot(index="a", columns="b", values="corr").to_numpy()
    return spark.createDataFrame([("panel, halved", positive_root((r + np.eye(len(r))) / 2)[1]), ("one series for all", positive_root(np.ones_like(r))[1])], "matrix string, jitter double")


@query()
def g13_heatmap_order(spark, d):
    """Assets in the order of a single-linkage tree on correlation distance (a driver-side step on N by N numbers)."""
    from tidemark.models.ordering import linkage_order

    rows = st.correlations(rets(spark, d)).select("a", "b", "corr").toPandas()
    names = sorted(rows["a"].unique())
    r = rows.pivot(index="a", columns="b", values="corr").loc[names, names].to_numpy()
    return spark.createDataFrame([(k, names[i]) for k, i in enumerate(linkage_order(np.sqrt(np.maximum(0, (1 - r) / 2))))], "place int, asset string")


@query()
def v2_array_hash(spark, d):
    from tidemark.operators.verify import array_hash

    rows = rets(spark, d).select("asset", "date", "ret")

    def one(pdf):
        import pandas as pd

        return pd.DataFrame([{"asset": pdf["asset"].iloc[0], "sha256": array_hash({"ret": pdf.sort_values("date")["ret"].to_numpy()})}])

    return rows.groupBy("asset").applyInPandas(one, "asset string, sha256 string")


@query()
def v3_run_record(spark, d):
    from dataclasses import asdict

    from tidemark.sources.sinks import run_record

    return run_record(spark, "event study", asdict(CFG), {t: adapters.table(spark, d, t) for t in ("orders", "lineitem")})


@query("""SELECT CAST(y AS BIGINT) AS y, round(corr(r, r_next), 6) + 0 AS spearman, count(*) AS n FROM (
  SELECT asset, y, r, lead(r) OVER (PARTITION BY asset ORDER BY y) AS r_next, lead(y) OVER (PARTITION BY asset ORDER BY y) AS y_next FROM (
    SELECT asset, y, rank() OVER (PARTITION BY y ORDER BY vol) AS r FROM (SELECT asset, year(date) AS y, stddev_samp(ret) AS vol FROM ret GROUP BY 1, 2))) WHERE y_next = y + 1 GROUP BY 1""")
def x7_rank_stability(spark, d):
    """Spearman correlation of the assets' volatility ranks between years, and the half-life of their persistence."""
    by = rets(spark, d).groupBy("asset", F.year("date").alias("y")).agg(F.stddev_samp("ret").alias("vol"))
    ranked = by.withColumn("r", F.rank().over(Window.partitionBy("y").orderBy("vol")))
    nxt = ranked.select("asset", (F.col("y") - 1).alias("y"), F.col("r").alias("r_next"))
    return rounded(ranked.join(nxt, ["asset", "y"]).groupBy("y").agg(F.corr("r", "r_next").alias("spearman"), F.count(F.lit(1)).alias("n")))
