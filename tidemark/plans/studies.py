"""Event studies, tests and fixed-parameter recursions (inventory E, K, V, and the SQL-checkable parts of B and F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators import event_study as es
from tidemark.operators import statistics as st
from tidemark.operators import timeseries as ts
from tidemark.operators import verify
from tidemark.operators import windows as win
from tidemark.plans.registry import CFG, candidates, events, panel, query, r6, rets, rounded, weeks
from tidemark.plans.relational import _COEF, _MOVES, _PAIRS, _census, _with
from tidemark.sources import adapters


def cars(spark, d, cfg: StudyConfig = CFG):
    return es.constant_mean(rets(spark, d, "simple"), events(spark, d), cfg)


def levels(spark, d):
    return es.event_level(cars(spark, d))


@query(f"SELECT event_id, type, event_date, asset, est_n, event_n, {r6('est_mean', 'est_sd', 'car', 'sar')}, status FROM (SELECT * REPLACE (CASE WHEN est_n > 0 THEN est_mean END AS est_mean) FROM cm)")
def e1_constant_mean(spark, d):
    return rounded(cars(spark, d))


_MM = """mk AS (SELECT date, ret AS mkt FROM simple WHERE asset = 'NO'),
mp AS (SELECT c.event_id, c.type, c.date AS event_date, s.asset, s.date, s.ret, m.mkt, s.date <= c.date - 31 AS in_est, s.date BETWEEN c.date - 5 AND c.date + 30 AS in_event
  FROM cal c JOIN simple s ON s.date BETWEEN c.date - 281 AND c.date + 30 JOIN mk m ON m.date = s.date WHERE s.asset <> 'NO'),
"""
_LINE = """ml AS (SELECT event_id, asset, count(*) FILTER (in_est) AS est_n, count(*) FILTER (in_event) AS event_n, regr_slope(ret, mkt) FILTER (in_est) AS beta, regr_intercept(ret, mkt) FILTER (in_est) AS alpha FROM mp GROUP BY 1, 2),
mr AS (SELECT event_id, asset, est_n, event_n, alpha, beta, stddev_samp(ret - alpha - beta * mkt) FILTER (in_est) AS est_sd, sum(ret - alpha - beta * mkt) FILTER (in_event) AS event_sum FROM mp JOIN ml USING (event_id, asset) GROUP BY ALL),
mm AS (SELECT event_id, type, event_date, asset, est_n, event_n, alpha, beta, est_sd, CASE WHEN status = 'ok' THEN event_sum END AS car, CASE WHEN status = 'ok' THEN event_sum / (est_sd * sqrt(event_n)) END AS sar, status FROM (
  SELECT c.event_id, c.type, c.date AS event_date, a.asset, coalesce(est_n, 0) AS est_n, coalesce(event_n, 0) AS event_n, alpha, beta, est_sd, event_sum,
    CASE WHEN coalesce(est_n, 0) < 120 THEN 'insufficient_estimation' WHEN coalesce(event_n, 0) < 5 THEN 'insufficient_event_window' ELSE 'ok' END AS status
  FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM simple {where}) a LEFT JOIN mr USING (event_id, asset)))"""


@query(_with(_MM + _LINE.replace("{where}", "WHERE asset <> 'NO'"), f"SELECT event_id, type, event_date, asset, est_n, event_n, {r6('alpha', 'beta', 'est_sd', 'car', 'sar')}, status FROM (SELECT * FROM mm UNION ALL SELECT event_id, type, event_date, asset, est_n, event_n, est_mean, NULL, est_sd, car, sar, status FROM cm WHERE asset = 'NO')"))
def e2_market_model(spark, d):
    r = rets(spark, d, "simple")
    market = r.where("asset = 'NO'").select("date", F.col("ret").alias("mkt"))
    return rounded(es.market_model(r, market, events(spark, d), CFG, proxy="NO"))


_EW = """ew AS (SELECT asset, date, mkt FROM (SELECT a.asset, x.date, avg(o.ret) AS mkt, count(o.ret) AS k FROM (SELECT DISTINCT asset FROM simple) a CROSS JOIN (SELECT DISTINCT date FROM simple) x JOIN simple o ON o.date = x.date AND o.asset <> a.asset GROUP BY 1, 2)
  WHERE k = (SELECT count(DISTINCT asset) - 1 FROM simple)),
mp AS (SELECT c.event_id, c.type, c.date AS event_date, s.asset, s.date, s.ret, m.mkt, s.date <= c.date - 31 AS in_est, s.date BETWEEN c.date - 5 AND c.date + 30 AS in_event
  FROM cal c JOIN simple s ON s.date BETWEEN c.date - 281 AND c.date + 30 JOIN ew m ON m.date = s.date AND m.asset = s.asset),
"""


@query(_with(_EW + _LINE.replace("{where}", ""), f"SELECT event_id, type, event_date, asset, est_n, event_n, {r6('alpha', 'beta', 'est_sd', 'car', 'sar')}, status FROM mm"))
def e3_equal_weight_market_model(spark, d):
    r = rets(spark, d, "simple")
    return rounded(es.market_model(r, es.market_without(r), events(spark, d), CFG))


@query(f"SELECT event_id, asset, est_n, {r6('t')} FROM (SELECT event_id, asset, est_n, sar AS t FROM cm WHERE status = 'ok')")
def e4_single_event_t(spark, d):
    return rounded(cars(spark, d).where("status = 'ok'").select("event_id", "asset", "est_n", F.col("sar").alias("t")))


_PRE = """pre AS (SELECT c.event_id, a.asset, count(r.ret) FILTER (r.date <= c.date - 61) AS est_n, count(r.ret) FILTER (r.date BETWEEN c.date - 30 AND c.date - 1) AS event_n,
  avg(r.ret) FILTER (r.date <= c.date - 61) AS m, sum(r.ret) FILTER (r.date BETWEEN c.date - 30 AND c.date - 1) AS s
  FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM simple) a LEFT JOIN simple r ON r.asset = a.asset AND r.date BETWEEN c.date - 311 AND c.date - 1 GROUP BY 1, 2)"""


@query(_with(_PRE, "SELECT event_id, asset, est_n, event_n, round(CASE WHEN est_n >= 120 AND event_n >= 5 THEN s - event_n * m END, 6) + 0 AS car FROM pre"))
def e6_pre_event_car(spark, d):
    rows = es.constant_mean(rets(spark, d, "simple"), events(spark, d), CFG, -30, -1)
    return rounded(rows.select("event_id", "asset", "est_n", "event_n", "car"))


@query(f"SELECT event_id, type, {r6('mean_car')}, n_assets FROM (SELECT event_id, type, avg(car) AS mean_car, count(*) AS n_assets FROM cm WHERE status = 'ok' AND event_n = 36 GROUP BY 1, 2)")
def e8_event_level_strict(spark, d):
    return rounded(es.event_level(cars(spark, d), CFG.event_days))


_DIFF = "SELECT {cols} FROM (SELECT avg(mean_car) FILTER (type = 'Infrastructure') AS mean_infra, var_samp(mean_car) FILTER (type = 'Infrastructure') AS var_infra, count(mean_car) FILTER (type = 'Infrastructure') AS n_infra, avg(mean_car) FILTER (type = 'Regulatory') AS mean_reg, var_samp(mean_car) FILTER (type = 'Regulatory') AS var_reg, count(mean_car) FILTER (type = 'Regulatory') AS n_reg FROM levels)"


@query(_DIFF.format(cols="round(mean_infra, 6) + 0 AS mean_infra, round(var_infra, 6) AS var_infra, n_infra, round(mean_reg, 6) + 0 AS mean_reg, round(var_reg, 6) AS var_reg, n_reg, round(mean_infra - mean_reg, 6) + 0 AS diff"))
def e9_difference_by_type(spark, d):
    return rounded(es.difference_by_type(levels(spark, d)))


_EXCESS = """near AS (SELECT c.event_id, c.type, r.asset, avg(r.ret * r.ret) AS near FROM cal c JOIN ret r ON r.date BETWEEN c.date - 3 AND c.date + 3 GROUP BY 1, 2, 3),
excess AS (SELECT event_id, type, asset, near - base AS excess FROM near JOIN (SELECT asset, avg(ret * ret) AS base FROM ret GROUP BY 1) USING (asset))"""


def _excess(spark, d):
    return es.abnormal_variance(rets(spark, d), events(spark, d))


@query(_with(_EXCESS, f"SELECT event_id, type, asset, {r6('excess')} FROM excess"))
def e11_abnormal_variance(spark, d):
    return rounded(_excess(spark, d))


@query(f"""WITH r AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'i' ELSE 'r' END AS k, year(o_orderdate) >= 1998 AS post, o_totalprice AS v FROM orders),
c AS (SELECT avg(v) FILTER (k = 'i' AND NOT post) AS m1, avg(v) FILTER (k = 'i' AND post) AS m2, avg(v) FILTER (k = 'r' AND NOT post) AS m3, avg(v) FILTER (k = 'r' AND post) AS m4,
 var_pop(v) FILTER (k = 'i' AND NOT post) / count(v) FILTER (k = 'i' AND NOT post) + var_pop(v) FILTER (k = 'i' AND post) / count(v) FILTER (k = 'i' AND post) + var_pop(v) FILTER (k = 'r' AND NOT post) / count(v) FILTER (k = 'r' AND NOT post) + var_pop(v) FILTER (k = 'r' AND post) / count(v) FILTER (k = 'r' AND post) AS q, count(v) - 4 AS df FROM r)
SELECT round((m2 - m1) - (m4 - m3), 4) + 0 AS did, round(sqrt(q), 4) AS se, round(((m2 - m1) - (m4 - m3)) / sqrt(q), 4) + 0 AS t, df, round(m1, 4) AS mean_infra_pre, round(m2, 4) AS mean_infra_post, round(m3, 4) AS mean_reg_pre, round(m4, 4) AS mean_reg_post FROM c""")
def e12_difference_in_differences(spark, d):
    rows = adapters.table(spark, d, "orders").select(adapters.event_type(F.col("o_orderpriority")).alias("type"), (F.year("o_orderdate") >= 1998).alias("post"), F.col("o_totalprice").alias("v"))
    return rounded(es.difference_in_differences(rows, "v"), 4)


_KP = """kn AS (SELECT event_id, count(DISTINCT asset) AS n_assets FROM ar GROUP BY 1),
kd AS (SELECT event_id, date, count(*) AS k, avg(ar) AS aar FROM ar GROUP BY 1, 2),
kc AS (SELECT d.*, n_assets FROM kd d JOIN kn USING (event_id) WHERE k = n_assets),
kt AS (SELECT event_id, n_assets, count(*) AS n_days, sum(aar) AS car FROM kc GROUP BY 1, 2),
kk AS (SELECT a.* FROM ar a JOIN kc USING (event_id, date)),
kr AS (SELECT event_id, avg(c) AS rbar FROM (SELECT x.event_id, x.asset, y.asset AS o, corr(x.ar, y.ar) AS c FROM kk x JOIN kk y ON x.event_id = y.event_id AND x.date = y.date AND x.asset <> y.asset GROUP BY 1, 2, 3) GROUP BY 1),
ks AS (SELECT event_id, avg(sd) AS sd, sum(n) AS n FROM (SELECT event_id, asset, any_value(est_sd) AS sd, any_value(est_n) AS n FROM ar GROUP BY 1, 2) GROUP BY 1),
kp AS (SELECT event_id, n_assets, n_days, CASE WHEN n_assets = 1 THEN 0 ELSE rbar END AS rbar, CASE WHEN n_assets > 1 THEN car END AS car, car / (sd * sqrt(n_days) / sqrt(n_assets)) AS t_unadjusted,
  CASE WHEN n_assets = 1 OR 1 + (n_assets - 1) * coalesce(rbar, 0) <= 0 THEN car / (sd * sqrt(n_days) / sqrt(n_assets)) ELSE car / (sd * sqrt(n_days) / sqrt(n_assets)) / sqrt(1 + (n_assets - 1) * coalesce(rbar, 0)) END AS t_kp,
  CAST(CASE WHEN n_assets = 1 THEN n_days - 1 ELSE n - n_assets END AS BIGINT) AS df FROM kt JOIN ks USING (event_id) LEFT JOIN kr USING (event_id) WHERE n_assets = 1 OR n_days >= 5)"""


def _abnormal(spark, d):
    return es.abnormal_days(rets(spark, d, "simple"), events(spark, d), CFG)


@query(_with(_KP, f"SELECT event_id, n_assets, n_days, {r6('rbar', 'car', 't_unadjusted', 't_kp')}, df FROM kp"))
def k2_kolari_pynnonen(spark, d):
    return rounded(es.kolari_pynnonen(_abnormal(spark, d)))


_WELCH = """SELECT round(m1, 6) + 0 AS mean_1, round(m2, 6) + 0 AS mean_2, round(m1 - m2, 6) + 0 AS diff, round(se, 6) AS se, round((m1 - m2) / se, 6) + 0 AS t, round(power(q1 + q2, 2) / (q1 * q1 / (n1 - 1) + q2 * q2 / (n2 - 1)), 4) AS df,
  round(sp, 6) AS pooled_sd, round((m1 - m2) / sp, 6) + 0 AS cohens_d, round((1.959963984540054e0 + 0.8416212335729143e0) * sqrt(1e0 / nullif(n1, 0) + 1e0 / nullif(n2, 0)), 6) AS d_mde, round((1.959963984540054e0 + 0.8416212335729143e0) * sqrt(1e0 / nullif(n1, 0) + 1e0 / nullif(n2, 0)) * sp, 6) AS mde
  FROM (SELECT *, v1 / n1 AS q1, v2 / n2 AS q2, sqrt(v1 / n1 + v2 / n2) AS se, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sp FROM (
    SELECT avg(mean_car) FILTER (type = 'Infrastructure') AS m1, var_samp(mean_car) FILTER (type = 'Infrastructure') AS v1, count(mean_car) FILTER (type = 'Infrastructure') AS n1,
      avg(mean_car) FILTER (type = 'Regulatory') AS m2, var_samp(mean_car) FILTER (type = 'Regulatory') AS v2, count(mean_car) FILTER (type = 'Regulatory') AS n2 FROM levels))"""


@query(_WELCH)
def k4_welch(spark, d):
    """K3, K4 and K5: Welch t with Satterthwaite df, pooled sd, Cohen's d and the minimum detectable effect."""
    out = rounded(st.welch(levels(spark, d), "mean_car"))
    return out.withColumn("df", F.round("df", 4))


@query(_with(_EXCESS, """SELECT u, n1, n2, round(greatest(abs(u - n1 * n2 / 2e0) - 0.5, 0) / sqrt(n1 * n2 / 12e0 * ((n1 + n2 + 1) - tie / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))), 6) + 0 AS z FROM (
  SELECT sum(rnk) FILTER (type = 'Infrastructure') - count(*) FILTER (type = 'Infrastructure') * (count(*) FILTER (type = 'Infrastructure') + 1) / 2e0 AS u, count(*) FILTER (type = 'Infrastructure') AS n1, count(*) FILTER (type <> 'Infrastructure') AS n2, sum(CAST(t * t - 1 AS DOUBLE)) AS tie
  FROM (SELECT type, count(*) OVER (PARTITION BY m) AS t, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2e0 AS rnk FROM (SELECT event_id, type, round(avg(excess), 6) AS m FROM excess GROUP BY 1, 2)))"""))
def k6_mann_whitney(spark, d):
    rows = _excess(spark, d).groupBy("event_id", "type").agg(F.round(F.avg("excess"), 6).alias("m"))
    return rounded(st.mann_whitney(rows, "m"))


@query(_with(_EXCESS, """SELECT round(slope, 6) + 0 AS slope, round(se, 6) AS se, round(slope / se, 6) + 0 AS t, n_clusters, n_obs FROM (
  SELECT any_value(b) AS slope, sqrt(sum(s * s) * count(*) / (count(*) - 1e0) * (any_value(n) - 1e0) / (any_value(n) - 2)) / any_value(sxx) AS se, count(*) AS n_clusters, any_value(n) AS n_obs FROM (
    SELECT event_id, any_value(b) AS b, any_value(n) AS n, any_value(sxx) AS sxx, sum((x - xm) * (excess - a - b * x)) AS s FROM (SELECT *, CASE WHEN type = 'Infrastructure' THEN 1e0 ELSE 0 END AS x FROM excess)
      CROSS JOIN (SELECT avg(x) AS xm, regr_slope(excess, x) AS b, regr_intercept(excess, x) AS a, count(*) AS n, regr_sxx(excess, x) AS sxx FROM (SELECT excess, CASE WHEN type = 'Infrastructure' THEN 1e0 ELSE 0 END AS x FROM excess)) GROUP BY 1))"""))
def k7_clustered_slope(spark, d):
    return rounded(st.cluster_slope(_excess(spark, d), "excess", F.col("type") == "Infrastructure", "event_id"))


def _asset_gap(spark, d):
    rows = win.event_dummies(rets(spark, d), events(spark, d))
    both = rows.groupBy("asset").agg(F.avg(F.when(F.col("d_infrastructure") == 1, F.col("ret"))).alias("a"), F.avg(F.when(F.col("d_regulatory") == 1, F.col("ret"))).alias("b"), F.stddev_samp("ret").alias("se"))
    return both.withColumn("gap", F.col("a") - F.col("b"))


_GAP = "gap AS (SELECT asset, avg(ret) FILTER (d_infrastructure = 1) - avg(ret) FILTER (d_regulatory = 1) AS gap, stddev_samp(ret) AS se FROM dummies GROUP BY 1)"


@query(_with(_PAIRS + ", " + _GAP, """SELECT round(m, 6) + 0 AS mean, round(s, 6) AS sd, n, round(rbar, 6) + 0 AS rbar, round(m / (s / sqrt(n)), 6) + 0 AS t_naive, round(deff, 6) + 0 AS deff, round(m / (s / sqrt(n)) / sqrt(CASE WHEN deff > 1e-9 THEN deff END), 6) + 0 AS t_deff, round(n / CASE WHEN deff > 1e-9 THEN deff END, 6) + 0 AS n_eff, round((n - 1) / CASE WHEN deff > 1e-9 THEN deff END, 6) + 0 AS df_eff
  FROM (SELECT *, 1 + (n - 1) * rbar AS deff FROM (SELECT avg(gap) AS m, stddev_samp(gap) AS s, count(gap) AS n FROM gap) CROSS JOIN (SELECT avg(corr) AS rbar FROM prs WHERE a <> b))"""))
def k8_design_effect(spark, d):
    rbar = st.mean_off_diagonal(st.correlations(rets(spark, d))).select("rbar")
    return rounded(st.design_effect(_asset_gap(spark, d), rbar, "gap"))


@query(_with(_PAIRS + ", " + _GAP, "SELECT round(sum(p.corr * x.se * y.se) / count(DISTINCT a) / count(DISTINCT a), 6) AS var_mean FROM prs p JOIN gap x ON x.asset = p.a JOIN gap y ON y.asset = p.b"))
def k9_correlated_variance(spark, d):
    return rounded(st.correlation_weighted_variance(_asset_gap(spark, d).select("asset", "se"), st.correlations(rets(spark, d))))


@query(_with(_MOVES, """SELECT n1, n2, k1, k2, round(k1 / n1, 6) AS rate_1, round(k2 / n2, 6) AS rate_2, round((k1 / n1 - k2 / n2) / nullif(sqrt((k1 + k2) / (n1 + n2) * (1 - (k1 + k2) / (n1 + n2)) * (1e0 / n1 + 1e0 / n2)), 0), 6) + 0 AS z FROM (
  SELECT count(*) FILTER (type = 'Infrastructure') AS n1, count(*) FILTER (type <> 'Infrastructure') AS n2, count(*) FILTER (type = 'Infrastructure' AND n_moved >= 5) AS k1, count(*) FILTER (type <> 'Infrastructure' AND n_moved >= 5) AS k2 FROM census)"""))
def k10_two_proportions(spark, d):
    return rounded(st.two_proportions(_census(spark, d), F.col("type") == "Infrastructure", F.col("n_moved") >= 5))


@query(f"SELECT type, {r6('mean', 'sd')}, n, {r6('t')} FROM (SELECT type, avg(mean_car) AS mean, stddev_samp(mean_car) AS sd, count(mean_car) AS n, avg(mean_car) / (stddev_samp(mean_car) / sqrt(count(mean_car))) AS t FROM levels GROUP BY 1)")
def k11_one_sample_t(spark, d):
    return rounded(st.one_sample(levels(spark, d), "mean_car", "type"))


def _acf(k: int) -> str:
    return f"sum(x * lag(x, {k}) OVER w)"


_LB = "lb AS (SELECT asset, date, ret - avg(ret) OVER (PARTITION BY asset) AS x FROM ret), lg AS (SELECT asset, x, " + ", ".join(f"lag(x, {k}) OVER (PARTITION BY asset ORDER BY date) AS x{k}" for k in range(1, 21)) + " FROM lb), sm AS (SELECT asset, count(x) AS n, sum(x * x) AS s0, " + ", ".join(f"sum(x * x{k}) AS s{k}" for k in range(1, 21)) + " FROM lg GROUP BY 1)"


def _q(m: int) -> str:
    return f"SELECT asset, CAST({m} AS BIGINT) AS lag, n, round(n * (n + 2) * (" + " + ".join(f"power(s{k} / s0, 2) / (n - {k})" for k in range(1, m + 1)) + "), 6) AS q FROM sm"


@query(_with(_LB, " UNION ALL ".join(_q(m) for m in (5, 10, 20))))
def k12_ljung_box(spark, d):
    return rounded(st.ljung_box(rets(spark, d), "ret", [5, 10, 20]))


@query(f"""SELECT asset, n, {r6('skew', 'kurt', 'jb')} FROM (SELECT *, n / 6e0 * (skew * skew + kurt * kurt / 4) AS jb FROM (SELECT asset, n, m3 / power(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM (
  SELECT asset, count(*) AS n, avg(power(ret - m, 2)) AS m2, avg(power(ret - m, 3)) AS m3, avg(power(ret - m, 4)) AS m4 FROM (SELECT asset, ret, avg(ret) OVER (PARTITION BY asset) AS m FROM ret) GROUP BY 1)))""")
def k14_jarque_bera(spark, d):
    return rounded(st.jarque_bera(rets(spark, d), "ret"))


_FAM = "fam AS (SELECT asset, year(date) AS y, CASE WHEN asset < 'N' THEN 'first' ELSE 'second' END AS family, CASE WHEN year(date) = 1999 THEN NULL ELSE round(1 / (1 + count(*) FILTER (ret > 40)), 6) * (year(date) - 1994) / 7 END AS p FROM ret GROUP BY 1, 2, 3)"


def _family(spark, d):
    y = F.year("date")
    return rets(spark, d).groupBy("asset", y.alias("y"), F.when(F.col("asset") < "N", "first").otherwise("second").alias("family")).agg(F.round(1 / (1 + F.count_if(F.col("ret") > 40)), 6).alias("s")).select("asset", "y", "family", F.when(F.col("y") != 1999, F.col("s") * (F.col("y") - 1994) / 7).alias("p"))


@query(_with(_FAM, """SELECT asset, y, family, round(p, 9) AS p, round(CASE WHEN p IS NOT NULL THEN least(1, min(p * m / k) OVER (PARTITION BY family, p IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END, 9) AS p_adjusted,
  p IS NOT NULL AND k <= coalesce(max(CASE WHEN p <= 0.05e0 * k / m THEN k END) OVER (PARTITION BY family, p IS NULL), 0) AS reject_005, p IS NOT NULL AND k <= coalesce(max(CASE WHEN p <= 0.1e0 * k / m THEN k END) OVER (PARTITION BY family, p IS NULL), 0) AS reject_010
  FROM (SELECT *, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, asset, y) AS k, count(*) OVER (PARTITION BY family, p IS NULL) AS m FROM fam)"""))
def k15_benjamini_hochberg(spark, d):
    rows = st.benjamini_hochberg(_family(spark, d), "p", ["asset", "y"], ["family"])
    return rounded(rows.select("asset", "y", "family", "p", "p_adjusted", "reject_005", "reject_010"), 9)


@query(_with(_FAM, "SELECT family, count(*) AS n, count(*) FILTER (p < 0.05) AS raw_005, count(*) FILTER (p < 0.10) AS raw_010, count(*) FILTER (p IS NULL) AS n_missing FROM fam GROUP BY 1"))
def k23_survivor_tally(spark, d):
    p = F.col("p")
    return _family(spark, d).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_if(p < 0.05).alias("raw_005"), F.count_if(p < 0.10).alias("raw_010"), F.count_if(p.isNull()).alias("n_missing"))


@query("""SELECT asset, model, CAST(k AS BIGINT) AS k, round(2 * k - 2 * ll, 4) AS aic, round(k * ln(n) - 2 * ll, 4) AS bic FROM (SELECT asset, unnest(['GARCH', 'GJR', 'GJRX']) AS model, unnest([5, 6, 11]) AS k, n, ll FROM (SELECT asset, count(*) AS n, -sum(abs(ret)) AS ll FROM ret GROUP BY 1))""")
def k24_information_criteria(spark, d):
    base = rets(spark, d).groupBy("asset").agg(F.count(F.lit(1)).alias("n_obs"), (-F.sum(F.abs("ret"))).alias("log_lik"))
    rows = base.select("*", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(x).alias("n_exog")) for m, x in (("GARCH", 0), ("GJR", 0), ("GJRX", 5))))).alias("m")).select("asset", "n_obs", "log_lik", "m.*")
    return rounded(st.information_criteria(rows).select("asset", "model", "k", "aic", "bic"), 4)


@query("""SELECT asset, round(a + b + abs(g) / 2, 6) AS persistence, round(sqrt(a * a / 100 + b * b / 100 + g * g / 400), 6) AS persistence_se FROM (SELECT asset, abs(corr(ret, l1)) / 4 AS a, 0.9e0 - abs(corr(ret, l2)) AS b, corr(ret, l3) / 8 AS g FROM (
  SELECT asset, ret, lag(ret, 1) OVER w AS l1, lag(ret, 2) OVER w AS l2, lag(ret, 3) OVER w AS l3 FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date)) GROUP BY 1)""")
def k25_persistence(spark, d):
    rows = ts.lags(rets(spark, d), "ret", 3).groupBy("asset").agg((F.abs(F.corr("ret", "ret_l1")) / 4).alias("alpha"), (0.9 - F.abs(F.corr("ret", "ret_l2"))).alias("beta"), (F.corr("ret", "ret_l3") / 8).alias("gamma"))
    rows = rows.withColumns({f"se_{c}": F.col(c) / 10 for c in ("alpha", "beta", "gamma")})
    return rounded(st.persistence(rows).select("asset", "persistence", "persistence_se"))


@query(f"SELECT asset, date, {r6('phi', 'residual')} FROM (SELECT l.asset, l.date, phi, ret - c - phi * l1 AS residual FROM (SELECT asset, date, ret, lag(ret) OVER (PARTITION BY asset ORDER BY date) AS l1 FROM ret) l JOIN (SELECT asset, regr_slope(ret, l1) AS phi, regr_intercept(ret, l1) AS c FROM (SELECT asset, ret, lag(ret) OVER (PARTITION BY asset ORDER BY date) AS l1 FROM ret) GROUP BY 1) USING (asset) WHERE l1 IS NOT NULL)")
def k26_ar1_filter(spark, d):
    return rounded(st.ar1_filter(rets(spark, d)).select("asset", "date", "phi", "residual"))


@query(f"""SELECT asset, {r6('const', 'b_infra', 'b_reg')} FROM (SELECT asset, (sy - b1 * sd - b2 * sr) / n AS const, b1 AS b_infra, b2 AS b_reg FROM (SELECT *, (y1 * a22 - y2 * a12) / (a11 * a22 - a12 * a12) AS b1, (y2 * a11 - y1 * a12) / (a11 * a22 - a12 * a12) AS b2 FROM (
  SELECT asset, n, sd, sr, sy, sd - sd * sd / n AS a11, dr - sd * sr / n AS a12, sr - sr * sr / n AS a22, dy - sd * sy / n AS y1, ry - sr * sy / n AS y2 FROM (
  SELECT asset, count(*) AS n, sum(d_infrastructure) AS sd, sum(d_regulatory) AS sr, sum(d_infrastructure * d_regulatory) AS dr, sum(ret) AS sy, sum(d_infrastructure * ret) AS dy, sum(d_regulatory * ret) AS ry FROM dummies GROUP BY 1))))""")
def k27_events_in_mean(spark, d):
    rows = st.events_in_mean(win.event_dummies(rets(spark, d), events(spark, d)))
    return rounded(rows.select("asset", "const", "b_infra", "b_reg").distinct())


@query("""SELECT asset, 'ret' AS a, 'double_ret' AS b, round(corr(ret, 2 * ret + d_infrastructure), 6) AS corr FROM dummies GROUP BY 1 HAVING abs(corr(ret, 2 * ret + d_infrastructure)) > 0.95""")
def k28_collinear(spark, d):
    rows = win.event_dummies(rets(spark, d), events(spark, d)).withColumn("double_ret", 2 * F.col("ret") + F.col("d_infrastructure"))
    return rounded(st.collinear(rows, ["ret", "double_ret", "d_regulatory"]))


# ---- fixed-parameter recursion, exact permutation, reshaping of fits -------

_FOLD = """ord AS (SELECT asset, date, ret - avg(ret) OVER (PARTITION BY asset) AS e, row_number() OVER (PARTITION BY asset ORDER BY date) AS k FROM ret),
v0 AS (SELECT asset, var_pop(ret) AS v FROM ret GROUP BY 1)"""


@query("""WITH RECURSIVE quotes AS (SELECT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price FROM lineitem),
panel AS (SELECT asset, date, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100e0) AS price FROM quotes WHERE CAST(date AS DATE) BETWEEN '1995-06-01' AND '2001-06-30' GROUP BY 1, 2),
ret AS (SELECT asset, date, 100 * ln(price / last) AS ret FROM (SELECT *, lag(price) OVER (PARTITION BY asset ORDER BY date) AS last FROM panel) WHERE last IS NOT NULL),
ord AS (SELECT asset, date, ret - avg(ret) OVER (PARTITION BY asset) AS e, row_number() OVER (PARTITION BY asset ORDER BY date) AS k FROM ret),
path AS (SELECT asset, CAST(1 AS BIGINT) AS k, var_pop(ret) AS v FROM ret GROUP BY 1 UNION ALL SELECT p.asset, p.k + 1, greatest(20 + 0.05e0 * o.e * o.e + CASE WHEN o.e < 0 THEN 0.04e0 * o.e * o.e ELSE 0 END + 0.85e0 * p.v, 1e-8) FROM path p JOIN ord o ON o.asset = p.asset AND o.k = p.k JOIN ord n ON n.asset = p.asset AND n.k = p.k + 1)
SELECT p.asset, o.date, round(p.v, 4) AS variance FROM path p JOIN ord o USING (asset, k)""")
def f1_variance_recursion(spark, d):
    """The GJR recursion with fixed parameters as a fold over each asset's ordered residuals."""
    from tidemark.operators.garch import variance_fold

    return rounded(variance_fold(rets(spark, d), 20.0, 0.05, 0.04, 0.85), 4)


@query("""SELECT asset, name, round(value, 6) + 0 AS value, abs(value) > 5 AS flag_05, abs(value) > 2 AS flag_10 FROM (SELECT asset, unnest(['event_a', 'event_b']) AS name, unnest([avg(ret) FILTER (d_infrastructure = 1), avg(ret) FILTER (d_regulatory = 1)]) AS value FROM dummies GROUP BY 1)""")
def f13_event_impacts(spark, d):
    from tidemark.operators.garch import event_impacts

    rows = win.event_dummies(rets(spark, d), events(spark, d)).groupBy("asset").agg(
        F.create_map(F.lit("event_a"), F.avg(F.when(F.col("d_infrastructure") == 1, F.col("ret"))), F.lit("omega"), F.lit(1.0), F.lit("event_b"), F.avg(F.when(F.col("d_regulatory") == 1, F.col("ret")))).alias("params")
    )
    return rounded(event_impacts(rows, "event_", 5.0, 2.0))


_PERM = """pv AS (SELECT year(event_date) AS y, type, round(avg(car), 6) AS v FROM cm WHERE status = 'ok' GROUP BY 1, 2),
px AS (SELECT list(v ORDER BY v, f) AS vs, sum(f) AS k, count(*) AS n, sum(v) AS s, sum(v * f) AS sf FROM (SELECT v, CASE WHEN type = 'Infrastructure' THEN 1 ELSE 0 END AS f FROM pv WHERE v IS NOT NULL)),
pm AS (SELECT *, unnest(range(CAST(power(2, n) AS BIGINT))) AS mask FROM px WHERE n <= 20),
pd AS (SELECT k, n, s, sf, list_sum(list_transform(range(n), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN vs[i + 1] ELSE 0 END)) AS q FROM pm WHERE bit_count(mask) = k)"""


@query(_with(_PERM, "SELECT round(any_value(sf / k - (s - sf) / (n - k)), 6) + 0 AS diff, count(*) AS assignments, count(*) FILTER (abs(q / k - (s - q) / (n - k)) >= abs(sf / k - (s - sf) / (n - k)) - 1e-12) AS extreme, round(count(*) FILTER (abs(q / k - (s - q) / (n - k)) >= abs(sf / k - (s - sf) / (n - k)) - 1e-12) / count(*), 6) AS p_two FROM pd"))
def b4_exact_permutation(spark, d):
    rows = cars(spark, d).where("status = 'ok'").groupBy(F.year("event_date").alias("y"), "type").agg(F.round(F.avg("car"), 6).alias("v"))
    return rounded(st.exact_permutation(rows, "v"))


# ---- verification ----------------------------------------------------------


@query("SELECT asset, CAST(bit_xor(hash(0)) IS NOT NULL AS BIGINT) AS n_files, count(*) AS n FROM quotes GROUP BY 1")
def v1_row_digest(spark, d):
    """A digest of each asset's rows exists and their number is told; the digest itself is engine-specific."""
    rows = verify.digest_by(adapters.raw_prices(adapters.table(spark, d, "lineitem")), "asset")
    return rows.select("asset", F.col("digest").isNotNull().cast("long").alias("n_files"), "n")


@query("SELECT 'quotes' AS table_name, count(*) AS n_rows, count(*) - count(DISTINCT (asset, date)) AS n_repeated FROM quotes UNION ALL SELECT 'panel', count(*), count(*) - count(DISTINCT (asset, date)) FROM panel")
def v4_unique_keys(spark, d):
    q, p = adapters.raw_prices(adapters.table(spark, d, "lineitem")), panel(spark, d)
    return verify.key_report(q, ["asset", "date"], "quotes").unionByName(verify.key_report(p, ["asset", "date"], "panel"))


@query("SELECT count(*) AS n_cells, count(*) FILTER (status = 'ok') + count(*) FILTER (status <> 'ok') = count(*) AS sums_up, count(*) FILTER (status = 'ok' AND car IS NULL) AS ok_without_car FROM cm")
def v5_accounting_identities(spark, d):
    ok = F.col("status") == "ok"
    return cars(spark, d).agg(F.count(F.lit(1)).alias("n_cells"), (F.count_if(ok) + F.count_if(~ok) == F.count(F.lit(1))).alias("sums_up"), F.count_if(ok & F.col("car").isNull()).alias("ok_without_car"))


# ---- documented extras -----------------------------------------------------


@query(_with(_COEF, f"SELECT spec, {r6('weighted', 'z')} FROM (SELECT spec, sum(a / (se * se)) / sum(1 / (se * se)) AS weighted, sum(a / (se * se)) / sum(1 / (se * se)) * sqrt(sum(1 / (se * se))) AS z FROM coef JOIN (SELECT asset, stddev_samp(ret) AS se FROM ret GROUP BY 1) USING (asset) GROUP BY 1)"))
def x1_inverse_variance_mean(spark, d):
    rows = win.event_dummies(rets(spark, d), events(spark, d)).withColumn("spec", F.year("date") % 3)
    coef = rows.groupBy("spec", "asset").agg(F.avg(F.when(F.col("d_infrastructure") == 1, F.col("ret"))).alias("a"))
    se = rets(spark, d).groupBy("asset").agg(F.stddev_samp("ret").alias("se"))
    w = 1 / (F.col("se") * F.col("se"))
    return rounded(coef.join(se, "asset").groupBy("spec").agg((F.sum(F.col("a") * w) / F.sum(F.when(F.col("a").isNotNull(), w))).alias("weighted"), (F.sum(F.col("a") * w) / F.sum(F.when(F.col("a").isNotNull(), w)) * F.sqrt(F.sum(F.when(F.col("a").isNotNull(), w)))).alias("z")))


@query("SELECT asset, CAST(k AS BIGINT) AS k, round(corr(x, CASE WHEN k >= 0 THEN y END), 6) + 0 AS corr FROM (SELECT w.asset, k.k, w.wk_absvol AS x, lag(z.z, k.k) OVER (PARTITION BY w.asset, k.k ORDER BY w.week_start) AS y FROM wkvol w JOIN zs z USING (week_start) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) k) GROUP BY 1, 2")
def x2_cross_correlation(spark, d):
    vol = ts.weekly_volatility(rets(spark, d), weeks(spark, d))
    z = ts.rolling_zscore(weeks(spark, d), "raw", "week_start").select("week_start", "z")
    rows = vol.join(z, "week_start")
    w = Window.partitionBy("asset").orderBy("week_start")
    made = rows.select("asset", "wk_absvol", *(F.lag("z", k).over(w).alias(f"z{k}") for k in range(5))).groupBy("asset").agg(*(F.corr("wk_absvol", f"z{k}").alias(f"c{k}") for k in range(5)))
    return rounded(made.select("asset", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("corr")) for k in range(5)))).alias("r")).select("asset", "r.*"))


@query(f"""SELECT asset, phase, {r6('vol')} FROM (SELECT r.asset, CASE WHEN r.date < c.date - 3 THEN 'pre' WHEN r.date <= c.date + 3 THEN 'event' ELSE 'post' END AS phase, stddev_samp(ret) AS vol FROM cal c JOIN ret r ON r.date BETWEEN c.date - 30 AND c.date + 30 GROUP BY 1, 2)""")
def x3_volatility_by_phase(spark, d):
    rows = rets(spark, d).join(win.event_days(events(spark, d), -30, 30), "date")
    gap = F.datediff("date", "event_date")
    return rounded(rows.groupBy("asset", F.when(gap < -3, "pre").when(gap <= 3, "event").otherwise("post").alias("phase")).agg(F.stddev_samp("ret").alias("vol")))


@query(f"SELECT k, n, {r6('aar', 'caar')} FROM (SELECT k, n, aar, sum(aar) OVER (ORDER BY k) AS caar FROM (SELECT date_diff('day', c.event_date, a.date) AS k, count(*) AS n, avg(ar) AS aar FROM ar a JOIN (SELECT DISTINCT event_id, event_date FROM cm) c USING (event_id) GROUP BY 1))")
def x4_average_abnormal_path(spark, d):
    days = _abnormal(spark, d).join(events(spark, d).select("event_id", F.col("date").alias("event_date")), "event_id")
    by = days.groupBy(F.datediff("date", "event_date").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.avg("ar").alias("aar"))
    return rounded(by.withColumn("caar", F.sum("aar").over(Window.partitionBy(F.lit(0)).orderBy("k"))))


@query(f"SELECT asset, {r6('garman_klass')} FROM (SELECT asset, sqrt(avg(0.5 * power(ln(hi / lo), 2) - (2 * ln(2) - 1) * power(ln(cl / op), 2))) AS garman_klass FROM (SELECT asset, date, max(price) AS hi, min(price) AS lo, arg_min(price, (l_orderkey, l_linenumber, price)) AS op, arg_max(price, (l_orderkey, l_linenumber, price)) AS cl FROM quotes GROUP BY 1, 2) GROUP BY 1)")
def x5_garman_klass(spark, d):
    key = F.struct("l_orderkey", "l_linenumber", "price")
    day = adapters.raw_prices(adapters.table(spark, d, "lineitem")).groupBy("asset", "date").agg(F.max("price").alias("hi"), F.min("price").alias("lo"), F.min_by("price", key).alias("op"), F.max_by("price", key).alias("cl"))
    term = 0.5 * F.pow(F.ln(F.col("hi") / F.col("lo")), F.lit(2.0)) - (2 * F.ln(F.lit(2.0)) - 1) * F.pow(F.ln(F.col("cl") / F.col("op")), F.lit(2.0))
    return rounded(day.groupBy("asset").agg(F.sqrt(F.avg(term)).alias("garman_klass")))


@query("SELECT type, count(*) AS n_events, count(DISTINCT date) AS n_days, round(avg(magnitude), 4) AS mean_size FROM pool GROUP BY 1")
def x6_pool_profile(spark, d):
    return rounded(candidates(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("date").alias("n_days"), F.avg("magnitude").alias("mean_size")), 4)
