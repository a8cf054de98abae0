"""Operators on literal fixtures: edge cases of windows, calendars, returns and tests."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators import bootstrap, calendar, event_study, garch, statistics, timeseries, verify, windows

D0 = dt.date(2020, 1, 1)
day = lambda k: D0 + dt.timedelta(days=k)


def prices(spark, n=300, assets=("a", "b"), skip=None, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for a in assets:
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        rows += [(a, day(k), float(p[k])) for k in range((skip or {}).get(a, 0), n)]
    return spark.createDataFrame(rows, "asset string, date date, price double")


def events_at(spark, rows):
    return spark.createDataFrame([(i, day(k), t) for i, (k, t) in enumerate(rows, 1)], "event_id long, date date, type string")


def test_slice_comes_before_differencing(spark):
    r = timeseries.returns(prices(spark, 20), "simple", str(day(5)), str(day(9)))
    assert sorted({x["date"] for x in r.collect()}) == [day(k) for k in range(6, 10)]


def test_null_and_zero_prices(spark):
    rows = [("a", day(0), 1.0), ("a", day(1), None), ("a", day(2), 0.0), ("a", day(3), 2.0), ("a", day(4), 4.0)]
    p = spark.createDataFrame(rows, "asset string, date date, price double")
    assert [x["ret"] for x in timeseries.returns(p, "simple").orderBy("date").collect()] == [1.0]
    assert timeseries.returns(p, "percent_log").count() == 1


def test_kind_is_required(spark):
    with pytest.raises(ValueError):
        timeseries.returns(prices(spark, 3), "other")


def test_rolling_matches_pandas(spark):
    r = timeseries.returns(prices(spark, 120, ("a",)), "percent_log")
    pdf = r.orderBy("date").toPandas()
    m, s = pdf["ret"].rolling(30, min_periods=1).mean(), pdf["ret"].rolling(30, min_periods=1).std()
    want = pdf["ret"].clip(m - 2 * s, m + 2 * s)
    got = timeseries.rolling_winsorise(r, sds=2.0).orderBy("date").toPandas()["ret_w"]
    assert np.allclose(got, want.where(s.notna(), pdf["ret"]))
    z = timeseries.rolling_zscore(r, "ret", "date").orderBy("date").toPandas()["z"]
    want = (pdf["ret"] - pdf["ret"].rolling(52, min_periods=26).mean()) / pdf["ret"].rolling(52, min_periods=26).std()
    assert np.allclose(z, want, equal_nan=True) and z.isna().sum() == 25


def test_global_winsorise_matches_numpy(spark):
    r = timeseries.returns(prices(spark, 200, ("a",)), "percent_log")
    x = r.toPandas()["ret"].to_numpy()
    got = timeseries.global_winsorise(r).agg(F.min("ret_w").alias("a"), F.max("ret_w").alias("b")).first()
    assert (got["a"], got["b"]) == pytest.approx((np.quantile(x, 0.005), np.quantile(x, 0.995)))


def test_constant_series_has_no_z(spark):
    rows = spark.createDataFrame([(day(k), 1.0) for k in range(40)], "date date, x double")
    assert {x["z"] for x in timeseries.rolling_zscore(rows, "x", "date").collect()} == {None}
    assert {x["z"] for x in timeseries.rolling_zscore(rows, "x", "date", flat=0.001).collect()} == {None, 0.0}


def test_weeks_with_a_hole(spark):
    weeks = spark.createDataFrame([(day(0), 1.0), (day(7), 2.0), (day(28), 3.0)], "week_start date, raw double")
    assert [(r["week_start"], r["week_end"]) for r in timeseries.week_edges(weeks).orderBy("week_start").collect()] == [(day(0), day(7)), (day(7), day(28)), (day(28), day(35))]
    rets = spark.createDataFrame([("a", day(k), 1.0) for k in range(10, 30)], "asset string, date date, ret double")
    out = {r["week_start"]: r["wk_absvol"] for r in timeseries.weekly_volatility(rets, weeks).collect()}
    assert out == {day(0): None, day(7): 18.0, day(28): 2.0}


def test_carry_skips_nulls_and_never_looks_ahead(spark):
    weekly = spark.createDataFrame([(day(0), 1.0), (day(7), None), (day(14), 3.0)], "week_start date, v double")
    cal = spark.createDataFrame([(day(k),) for k in range(17)], "date date")
    got = [r["v"] for r in timeseries.carry_forward(weekly, cal, ["v"]).orderBy("date").collect()]
    assert got == [1.0] * 14 + [3.0] * 3
    left = spark.createDataFrame([(day(k),) for k in (-1, 0, 8, 20)], "date date")
    right = weekly.withColumnRenamed("week_start", "date")
    assert [r["v"] for r in timeseries.as_of(left, right, ["v"], "date").orderBy("date").collect()] == [None, 1.0, 1.0, 3.0]


def test_dummies_by_type_and_overlap(spark):
    cal = spark.createDataFrame([(day(k),) for k in range(30)], "date date")
    ev = events_at(spark, [(5, "Infrastructure"), (7, "Infrastructure"), (7, "Regulatory")])
    rows = {r["date"]: (r["d_infrastructure"], r["d_regulatory"]) for r in windows.event_dummies(cal, ev).collect()}
    assert sum(a for a, _ in rows.values()) == 9 and sum(b for _, b in rows.values()) == 7
    assert set(rows.values()) <= {(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0)}
    over = spark.createDataFrame([(1, None, None, 0.5), (2, None, None, 0.5), (3, day(7), day(8), None)], "event_id long, window_start date, window_end date, weight double")
    half = {r["date"]: (r["d_infrastructure"], r["d_regulatory"]) for r in windows.overridden_dummies(cal, ev, over).collect()}
    assert half[day(6)] == (0.5, 0.0) and half[day(2)] == (1.0, 0.0) and half[day(10)] == (1.0, 0.0)
    assert [d for d, v in sorted(half.items()) if v[1]] == [day(7), day(8)]


def test_regimes_are_half_open(spark):
    cal = spark.createDataFrame([("a", day(k)) for k in range(10)], "asset string, date date")
    brk = spark.createDataFrame([("a", day(3)), ("a", day(7))], "asset string, break_date date")
    assert [r["segment"] for r in windows.regime_segments(cal, brk).orderBy("date").collect()] == [0] * 3 + [1] * 4 + [2] * 3
    none = windows.regime_segments(cal, brk.where("false"))
    assert {r["segment"] for r in none.collect()} == {0}


def test_crisis_fallbacks(spark):
    cal = spark.createDataFrame([(a, dt.date(2019, 1, 1)) for a in "abc"] + [(a, dt.date(2023, 1, 1)) for a in "abc"], "asset string, date date")
    brk = spark.createDataFrame([("a", dt.date(2021, 2, 1)), ("a", dt.date(2022, 5, 1)), ("b", dt.date(2020, 2, 1)), ("b", dt.date(2022, 6, 1))], "asset string, break_date date")
    out = {r["asset"]: (r["lo"], r["hi"]) for r in windows.crisis_window(cal, brk, 2021).collect()}
    assert out == {"a": (dt.date(2021, 2, 1), dt.date(2022, 5, 1)), "b": (dt.date(2020, 2, 1), dt.date(2022, 6, 1)), "c": (dt.date(2019, 1, 1), dt.date(2023, 1, 2))}


def test_late_listing_patterns(spark):
    p = prices(spark, 40, ("a", "b", "c"), {"c": 15})
    got = {r["pattern"]: r["n_days"] for r in calendar.pattern_summary(calendar.union_calendar(p)).collect()}
    assert got == {3: 15, 7: 25}
    assert calendar.common_calendar(p).count() == 25


@pytest.mark.parametrize(("est", "status"), [(119, "insufficient_estimation"), (120, "ok")])
def test_estimation_minimum(spark, est, status):
    n = est + 31 + 6
    rets = spark.createDataFrame([("a", day(k), 0.01 * (k % 7)) for k in range(n)], "asset string, date date, ret double")
    rets = rets.where(~F.col("date").between(F.lit(day(est)), F.lit(day(est + 24))))
    ev = events_at(spark, [(est + 30, "Regulatory")])
    row = event_study.constant_mean(rets, ev, StudyConfig()).first()
    assert (row["est_n"], row["status"]) == (est, status)
    assert (row["car"] is None) == (status != "ok")


@pytest.mark.parametrize(("days", "status"), [(4, "insufficient_event_window"), (5, "ok")])
def test_event_window_minimum(spark, days, status):
    rets = spark.createDataFrame([("a", day(k), 0.01 * (k % 7)) for k in [*range(200), *range(225, 225 + days)]], "asset string, date date, ret double")
    row = event_study.constant_mean(rets, events_at(spark, [(230, "Regulatory")]), StudyConfig()).first()
    assert (row["event_n"], row["status"]) == (days, status)


def test_car_ignores_a_shift_and_partitioning(spark):
    rets = timeseries.returns(prices(spark, 400), "simple")
    ev = events_at(spark, [(330, "Regulatory"), (340, "Infrastructure")])
    told = lambda r: sorted((x["event_id"], x["asset"], round(x["car"], 10)) for x in event_study.constant_mean(r, ev, StudyConfig()).collect())
    assert told(rets) == told(rets.withColumn("ret", F.col("ret") + 0.5)) == told(rets.repartition(7))


def test_market_model_matches_least_squares(spark):
    rets = timeseries.returns(prices(spark, 400), "simple")
    ev = events_at(spark, [(330, "Regulatory")])
    market = rets.where("asset = 'b'").select("date", F.col("ret").alias("mkt"))
    row = event_study.market_model(rets, market, ev, StudyConfig(), proxy="b").where("asset = 'a'").first()
    w = rets.toPandas().pivot(index="date", columns="asset", values="ret")
    est = w[(w.index >= day(330 - 281)) & (w.index <= day(330 - 31))]
    beta, alpha = np.polyfit(est["b"], est["a"], 1)
    window = w[(w.index >= day(325)) & (w.index <= day(360))]
    assert (row["alpha"], row["beta"]) == pytest.approx((alpha, beta))
    assert row["car"] == pytest.approx((window["a"] - alpha - beta * window["b"]).sum())


def test_single_asset_kolari(spark):
    ars = spark.createDataFrame([(1, "t", "a", day(k), 0.1, 200, 0.2) for k in range(6)], "event_id long, type string, asset string, date date, ar double, est_n long, est_sd double")
    row = event_study.kolari_pynnonen(ars).first()
    assert row["car"] is None and row["df"] == 5 and row["t_kp"] == pytest.approx(0.6 / (0.2 * np.sqrt(6)))


def test_coverage_adds_up(spark):
    rets = timeseries.returns(prices(spark, 400, ("a", "b"), {"b": 250}), "simple")
    row = event_study.coverage(event_study.constant_mean(rets, events_at(spark, [(330, "Regulatory"), (380, "Infrastructure")]), StudyConfig()), 36).first()
    assert row["usable"] + row["missing"] == row["total"] == 4
    assert row["missing_cells"].count(":") == row["missing"]


@pytest.mark.parametrize("ps", [[0.01, 0.02, 0.03, 0.04], [0.01, 0.01, None, 0.9], [0.0], [0.5, 0.6], [None]])
def test_benjamini_hochberg(spark, ps):
    rows = spark.createDataFrame([(i, "f", p) for i, p in enumerate(ps)], "i int, f string, p double")
    got = {r["i"]: (r["p_adjusted"], r["reject_005"]) for r in statistics.benjamini_hochberg(rows, "p", ["i"], ["f"]).collect()}
    used = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    m = len(used)
    adjusted = {i: min(min(1.0, q * m / (k + 1)) for k, (q, _) in enumerate(used) if k >= place) for place, (_, i) in enumerate(used)}
    for i, p in enumerate(ps):
        assert got[i] == (None, False) if p is None else got[i][0] == pytest.approx(adjusted[i]) and got[i][1] == (adjusted[i] <= 0.05 + 1e-12)


def test_published_proportions(spark):
    rows = spark.createDataFrame([(1, 1)] * 53 + [(1, 0)] * 29 + [(2, 1)] * 41 + [(2, 0)] * 12, "g int, ok int")
    row = statistics.two_proportions(rows, F.col("g") == 1, F.col("ok") == 1).first()
    assert row["z"] == pytest.approx(-1.5700, abs=1e-3)


def test_permutation_matches_enumeration(spark):
    from itertools import combinations

    a, b = [1.0, 2.5, 4.0], [0.5, 3.0, 1.5, 2.0]
    rows = spark.createDataFrame([("Infrastructure", v) for v in a] + [("Regulatory", v) for v in b], "type string, v double")
    row = statistics.exact_permutation(rows, "v").first()
    pool, gap = a + b, abs(np.mean(a) - np.mean(b))
    hits = sum(abs(np.mean([pool[i] for i in c]) - np.mean([pool[i] for i in range(7) if i not in c])) >= gap - 1e-12 for c in combinations(range(7), 3))
    assert (row["assignments"], row["extreme"]) == (35, hits)


def test_fits_by_asset_and_short_series(spark):
    r = timeseries.returns(prices(spark, 400, ("a", "b"), {"b": 350}), "percent_log").withColumn("d_infrastructure", (F.dayofmonth("date") == 1).cast("double"))
    out = {(x["asset"], x["model"]): x for x in garch.fit_models(r, ["d_infrastructure"], ("GARCH", "GJRX"), 2).collect()}
    assert out["a", "GARCH"]["converged"] and "gamma" not in out["a", "GARCH"]["params"] and "d_infrastructure" in out["a", "GJRX"]["params"]
    assert not out["b", "GARCH"]["converged"] and out["b", "GARCH"]["log_lik"] is None
    assert out["a", "GJRX"]["log_lik"] >= out["a", "GARCH"]["log_lik"] - 1e-3


def test_draws_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(0)
    r = timeseries.returns(prices(spark, 260, ("a", "b")), "percent_log")
    rows = r.withColumn("d1", (F.dayofmonth("date") <= 3).cast("double")).withColumn("d2", (F.dayofmonth("date") >= 27).cast("double"))
    p = bootstrap.fit_process(rows, ["d1", "d2"], starts=1)
    for scheme in bootstrap.SCHEMES:
        a = bootstrap.draw_table(spark, p, scheme, 6, 10).orderBy("seed").toPandas()
        b = bootstrap.draw_table(spark, p, scheme, 3, 13).orderBy("seed").toPandas()
        assert np.allclose(a["dbar"].to_numpy(float)[3:], b["dbar"].to_numpy(float), equal_nan=True)
    panels = bootstrap.panel_table(spark, p, 4, 1)
    law = bootstrap.draw_table(spark, p, "student_null", 6, 10)
    sizes = bootstrap.decisions(panels, law, law, 2, {0.05: 6.3, 0.1: 3.1}).collect()
    assert len(sizes) == 8 and {x["rule"] for x in sizes} == {"naive", "design_effect", "gaussian", "t_copula"} and all(0 <= x["size"] <= 1 for x in sizes)
    assert rng is not None


def test_variance_fold_is_the_recursion(spark):
    from tidemark.models import garch as model

    r = timeseries.returns(prices(spark, 80, ("a",)), "percent_log")
    got = garch.variance_fold(r, 0.1, 0.05, 0.04, 0.85).orderBy("date").toPandas()["variance"].to_numpy()
    x = r.orderBy("date").toPandas()["ret"].to_numpy()
    assert got == pytest.approx(model.variance(model.Data(x, np.zeros((len(x), 0))), np.array([0.1, 0.05, 0.04, 0.85, 5.0])), rel=1e-9)


def test_break_operator(spark):
    rng = np.random.default_rng(0)
    rows = [("a", day(k), float(v)) for k, v in enumerate(np.concatenate([rng.normal(0, 1, 150), rng.normal(5, 1, 150)]))]
    row = garch.detect_breaks(spark.createDataFrame(rows, "asset string, date date, y double"), "y", reps=50).first()
    assert abs((row["break_date"] - day(150)).days) <= 2 and row["ci_low"] <= row["break_date"] <= row["ci_high"]


def test_verification(spark, tmp_path):
    p = tmp_path / "x.txt"
    p.write_bytes(b"abc")
    assert verify.file_sha256(spark, f"file://{p}").first()["sha256"].startswith("ba7816bf")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert verify.repeated_keys(rows, ["k"]).first()["n"] == 2
    assert verify.key_report(rows, ["k"], "t").first()["n_repeated"] == 1
    assert verify.array_hash({"b": np.arange(3), "a": np.ones(2)}) == verify.array_hash({"a": np.ones(2, np.float32), "b": np.arange(3, dtype=np.int32)})


def test_empty_inputs(spark):
    none = prices(spark, 5).where("false")
    r = timeseries.returns(none, "simple")
    ev = events_at(spark, [(1, "Regulatory")])
    assert r.count() == 0 and event_study.constant_mean(r, ev, StudyConfig()).count() == 0
    assert windows.event_dummies(none.select("date"), ev).count() == 0
    assert statistics.welch(event_study.event_level(event_study.constant_mean(r, ev, StudyConfig())), "mean_car").first()["t"] is None
    assert isinstance(r.toPandas(), pd.DataFrame)


def test_mann_whitney_by_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [("Infrastructure" if k % 3 else "Regulatory", float(v)) for k, v in enumerate(rng.integers(0, 25, 400))] + [("Regulatory", None)]
    table = spark.createDataFrame(rows, "type string, v double")
    a, b = (np.array([v for t, v in rows if t == name and v is not None]) for name in ("Infrastructure", "Regulatory"))
    u = (a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()
    for ranges in (2, 64):
        row = statistics.mann_whitney(table, "v", ranges=ranges).first()
        assert (row["u"], row["n1"], row["n2"]) == (u, len(a), len(b))
    assert statistics.mann_whitney(table.where("false"), "v").first()["z"] is None


def test_no_draws_have_no_tail(spark):
    row = statistics.draw_summary(spark.createDataFrame([(None,), (None,)], "dbar double"), 1.0).first()
    assert row["p_one"] is None and row["p_abs"] is None and row["share_dropped"] == 1.0


def test_too_many_labelings_are_an_error(spark):
    rows = spark.range(40).selectExpr("if(id % 2 = 0, 'Infrastructure', 'Regulatory') type", "cast(id as double) v")
    with pytest.raises(Exception, match="more than 20 observations"):
        statistics.exact_permutation(rows, "v").collect()


def test_stored_tables_against_recomputation(spark):
    stored = spark.createDataFrame([("a", 1.0, 5, "x"), ("b", 2.0, 6, None), ("c", None, 7, "z"), ("d", 4.0, 8, "w")], "k string, v double, n int, t string")
    computed = spark.createDataFrame([("a", 1.0 + 1e-9, 5, "x"), ("b", 2.1, 6, None), ("c", None, 9, "y"), ("e", 4.0, 8, "w")], "k string, v double, n int, t string")
    rows = {r["column"]: r for r in verify.compare_tables(stored, computed, ["k"]).collect()}
    assert {c: (r["n"], r["n_only_stored"], r["n_only_computed"], r["n_different"]) for c, r in rows.items()} == {"v": (3, 1, 1, 1), "n": (3, 1, 1, 1), "t": (3, 1, 1, 1)}
    assert rows["v"]["largest"] == pytest.approx(0.1)


def test_printed_cells(spark):
    lines = ["Asset & mean & sd \\\\", r"BTC & 0.123*** & \textbf{4,321.5} \\", r"ETH & $-0.20$ & 3.0\% \\", "ADA & n/a & 7", "too & few"]
    cells = verify.table_cells(spark.createDataFrame([(x,) for x in lines], "line string"), ["mean", "sd"])
    results = spark.createDataFrame([("BTC", 0.12345, 4321.46), ("ETH", -0.2049, 3.06), ("ADA", 1.0, 7.4)], "asset string, mean double, sd double")
    got = {(r["label"], r["column"]): (r["printed"], r["digits"], r["agrees"]) for r in verify.compare_cells(cells, results, "asset", ["mean", "sd"]).collect()}
    assert got == {("BTC", "mean"): (0.123, 3, True), ("BTC", "sd"): (4321.5, 1, True), ("ETH", "mean"): (-0.2, 2, True), ("ETH", "sd"): (3.0, 1, False), ("ADA", "sd"): (7.0, 0, True)}
