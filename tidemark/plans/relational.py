"""Scans, transforms, joins, aggregations, windows and set operations (inventory IO, T, J, G, W, O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.labels import DIRECTION, DISPOSITION, INTEGRATION
from tidemark.operators import calendar as cal
from tidemark.operators import statistics as st
from tidemark.operators import timeseries as ts
from tidemark.operators import windows as win
from tidemark.plans.registry import CUTOFF, END, START, candidates, events, panel, query, r6, rets, rounded, weeks
from tidemark.sources import adapters, readers


# ---- scans -----------------------------------------------------------------


@query(f"SELECT asset, date, price FROM quotes WHERE date BETWEEN '{START}' AND '{END}' QUALIFY row_number() OVER (PARTITION BY asset, date ORDER BY l_orderkey, l_linenumber, price) = 1")
def io1_price_scan(spark, d):
    rows = readers.first_of_day(ts.between(adapters.raw_prices(adapters.table(spark, d, "lineitem")), START, END), ["l_orderkey", "l_linenumber", "price"])
    return rows.select("asset", "date", "price")


@query("""SELECT asset, date, round(ret, 9) + 0 AS ret FROM (SELECT asset, date, ln(price) - lag(ln(price)) OVER (PARTITION BY asset ORDER BY date) AS ret FROM (
  SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY asset, date ORDER BY l_orderkey, l_linenumber, price) = 1)) WHERE ret IS NOT NULL""")
def io2_log_returns_unsliced(spark, d):
    rows = readers.first_of_day(adapters.raw_prices(adapters.table(spark, d, "lineitem")), ["l_orderkey", "l_linenumber", "price"])
    return rounded(ts.returns(rows, "log"), 9)


_CLIPPED = "clipped AS (SELECT asset, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM ret GROUP BY 1)"


@query(f"SELECT asset, date, {r6('ret', 'ret_w')} FROM (SELECT r.asset, r.date, r.ret, least(greatest(r.ret, lo), hi) AS ret_w FROM ret r JOIN (SELECT asset, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM ret GROUP BY 1) q USING (asset))")
def io3_returns_panel(spark, d):
    return rounded(ts.global_winsorise(rets(spark, d)).select("asset", "date", "ret", "ret_w"))


@query(f"SELECT asset, date, {r6('ret')} FROM simple")
def io4_simple_returns(spark, d):
    return rounded(rets(spark, d, "simple"))


@query("SELECT event_id, date, type, label, magnitude FROM cal")
def io5_event_scan(spark, d):
    return events(spark, d)


@query("SELECT type, count(*) AS n, min(date) AS first_day, max(date) AS last_day, string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY date, event_id) AS ids FROM cal GROUP BY 1")
def io6_events_by_type(spark, d):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("date", "event_id"))), lambda x: x.event_id.cast("string")), ";")
    return events(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"), ids.alias("ids"))


@query(f"""SELECT week_start, raw, {r6('z', 'reg', 'infra')} FROM (SELECT week_start, raw, CASE WHEN week_start < '{CUTOFF}' THEN 0 ELSE z END AS z,
  CASE WHEN week_start < '{CUTOFF}' THEN 0 ELSE z * reg_proportion END AS reg, CASE WHEN week_start < '{CUTOFF}' THEN 0 ELSE z * infra_proportion END AS infra FROM zs)""")
def io7_sentiment_stages(spark, d):
    rows = ts.decompose(ts.rolling_zscore(weeks(spark, d), "raw", "week_start"))
    return rounded(ts.zero_before(rows, ["z", "reg", "infra"], CUTOFF, "week_start").select("week_start", "raw", "z", "reg", "infra"), keep=("raw",))


@query("""WITH p AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_type, count(*) AS n, count(k) AS with_k, min(k) AS first_k, max(k) AS last_k FROM p GROUP BY 1""")
def io8_json_scan(spark, d):
    rows = adapters.table(spark, d, "events").select("event_type", F.from_json("props", "k string").getField("k").alias("k"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("with_k"), F.min("k").alias("first_k"), F.max("k").alias("last_k"))


@query("SELECT asset, count(*) AS n, round(sum(price), 4) AS total FROM panel GROUP BY 1")
def io15_view_of_result(spark, d):
    name = "io15_result"
    panel(spark, d).createOrReplaceTempView(name)
    return spark.table(name).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))


# ---- transforms ------------------------------------------------------------


@query(f"SELECT asset, date, {r6('ret')} FROM ret")
def t1_percent_log_return(spark, d):
    return rounded(rets(spark, d))


@query("SELECT asset, date, round(ret, 9) + 0 AS ret FROM logret")
def t2_log_difference(spark, d):
    return rounded(rets(spark, d, "log"), 9)


@query(f"SELECT asset, date, {r6('ret')} FROM (SELECT asset, date, price / lag(price) OVER (PARTITION BY asset ORDER BY date) - 1 AS ret FROM panel) WHERE ret IS NOT NULL")
def t3_simple_return_unsliced(spark, d):
    return rounded(ts.returns(panel(spark, d), "simple"))


@query(f"SELECT asset, date, {r6('size', 'square')} FROM (SELECT asset, date, abs(ret) AS size, ret * ret AS square FROM ret)")
def t4_size_and_square(spark, d):
    return rounded(rets(spark, d).select("asset", "date", F.abs("ret").alias("size"), (F.col("ret") * F.col("ret")).alias("square")))


@query(f"SELECT asset, date, {r6('ret_w')} FROM (SELECT asset, date, least(greatest(ret, avg(ret) OVER w - 5 * stddev_samp(ret) OVER w), avg(ret) OVER w + 5 * stddev_samp(ret) OVER w) AS ret_w FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 29 PRECEDING))")
def t5_rolling_winsorise(spark, d):
    return rounded(ts.rolling_winsorise(rets(spark, d)).select("asset", "date", "ret_w"))


@query(f"SELECT asset, {r6('lo', 'hi')}, n_low, n_high FROM (SELECT q.asset, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (ret < lo) AS n_low, count(*) FILTER (ret > hi) AS n_high FROM ret r JOIN (SELECT asset, quantile_cont(ret, 0.005) AS lo, quantile_cont(ret, 0.995) AS hi FROM ret GROUP BY 1) q USING (asset) GROUP BY 1)")
def t6_global_winsorise(spark, d):
    rows = ts.global_winsorise(rets(spark, d))
    return rounded(rows.groupBy("asset").agg(F.min("ret_w").alias("lo"), F.max("ret_w").alias("hi"), F.count_if(F.col("ret") < F.col("ret_w")).alias("n_low"), F.count_if(F.col("ret") > F.col("ret_w")).alias("n_high")))


@query("WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type FROM events) SELECT day, event_type, count(*) AS n FROM e GROUP BY 1, 2")
def t7_utc_day(spark, d):
    return adapters.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT week_start, {r6('z')} FROM zs")
def t8_rolling_zscore(spark, d):
    return rounded(ts.rolling_zscore(weeks(spark, d), "raw", "week_start").select("week_start", "z"))


@query(f"""SELECT week_start, {r6('z')} FROM (SELECT week_start, CASE WHEN count(x) OVER w >= 26 THEN CASE WHEN stddev_samp(x) OVER w < 0.001 THEN 0 ELSE (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END END AS z
  FROM (SELECT week_start, least(raw, 1e3) AS x FROM wk) WINDOW w AS (ORDER BY week_start ROWS 51 PRECEDING))""")
def t9_flat_series_guard(spark, d):
    rows = weeks(spark, d).select("week_start", F.least("raw", F.lit(1e3)).alias("x"))
    return rounded(ts.rolling_zscore(rows, "x", "week_start", flat=0.001).select("week_start", "z"))


@query(f"SELECT week_start, {r6('reg', 'infra')} FROM (SELECT week_start, z * reg_proportion AS reg, z * infra_proportion AS infra FROM zs)")
def t10_theme_shares(spark, d):
    return rounded(ts.decompose(ts.rolling_zscore(weeks(spark, d), "raw", "week_start")).select("week_start", "reg", "infra"))


@query(f"SELECT week_start, {r6('z')} FROM (SELECT week_start, coalesce(CASE WHEN week_start < '{CUTOFF}' THEN 0 ELSE z END, 0) AS z FROM zs)")
def t11_zero_before_cutoff(spark, d):
    rows = ts.rolling_zscore(weeks(spark, d), "raw", "week_start")
    return rounded(ts.fill_zero(ts.zero_before(rows, ["z"], CUTOFF, "week_start"), ["z"]).select("week_start", "z"))


@query(f"SELECT asset, count(*) AS n, min(date) AS first_day, max(date) AS last_day FROM panel WHERE date BETWEEN '{START}' AND '{END}' GROUP BY 1")
def t12_date_slice(spark, d):
    return ts.between(panel(spark, d), START, END).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query("SELECT asset, count(*) AS n FROM panel WHERE asset IN ('AF', 'NO', 'RF') GROUP BY 1")
def t13_set_membership(spark, d):
    return panel(spark, d).where(F.col("asset").isin("AF", "NO", "RF")).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))


_MOVES = """sds AS (SELECT asset, stddev_samp(ret) AS sd FROM logret WHERE date BETWEEN '1995-06-01' AND '2001-01-01' GROUP BY 1),
big AS (SELECT p.event_id, r.asset, max(abs(r.ret)) AS m FROM pool p JOIN logret r ON r.date BETWEEN p.date - 1 AND p.date + 1 GROUP BY 1, 2),
census AS (SELECT p.event_id, p.date, p.type, p.magnitude, count(*) FILTER (b.m > s.sd) AS n_moved FROM pool p LEFT JOIN big b USING (event_id) LEFT JOIN sds s USING (asset) GROUP BY 1, 2, 3, 4)
"""


def _census(spark, d):
    """The candidates with the number of assets that moved by more than one sd on a day from -1 to +1."""
    r = rets(spark, d, "log")
    sds = ts.between(r, "1995-06-01", "2001-01-01").groupBy("asset").agg(F.stddev_samp("ret").alias("sd"))
    pool = candidates(spark, d)
    big = win.event_days(pool, -1, 1).join(r, "date").groupBy("event_id", "asset").agg(F.max(F.abs("ret")).alias("m"))
    moved = big.join(sds, "asset").groupBy("event_id").agg(F.count_if(F.col("m") > F.col("sd")).alias("n_moved"))
    return pool.join(moved, "event_id", "left").withColumn("n_moved", F.coalesce("n_moved", F.lit(0)))


def _with(extra: str, select: str) -> str:
    from tidemark.plans.registry import BASE

    return f"{BASE}, {extra} {select}"


@query(_with(_MOVES, "SELECT spec, type, count(*) AS n FROM (SELECT type, unnest(['relaxed', 'std', 'strict', 'nofilter']) AS spec, unnest([n_moved >= 1, n_moved >= 2, n_moved >= 3, true]) AS ok FROM census) WHERE ok GROUP BY 1, 2"))
def t14_spec_filter(spark, d):
    flags = {"relaxed": F.col("n_moved") >= 1, "std": F.col("n_moved") >= 2, "strict": F.col("n_moved") >= 3, "nofilter": F.lit(True)}
    rows = _census(spark, d).select("type", F.explode(F.array(*(F.struct(F.lit(k).alias("spec"), c.alias("ok")) for k, c in flags.items()))).alias("x"))
    return rows.where("x.ok").groupBy("x.spec", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT upper(c_mktsegment) AS segment, count(*) AS n, count(*) FILTER (lower(c_name) LIKE 'customer%') AS named, min(replace(c_name, '#', '-')) AS first_name, max(strftime(DATE '1995-01-01' + c_nationkey, '%Y-%m-%d')) AS last_day FROM customer GROUP BY 1")
def t15_text_functions(spark, d):
    rows = adapters.table(spark, d, "customer")
    day = F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), F.col("c_nationkey")), "yyyy-MM-dd")
    return rows.groupBy(F.upper("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.lower("c_name").startswith("customer")).alias("named"), F.min(F.replace(F.col("c_name"), F.lit("#"), F.lit("-"))).alias("first_name"), F.max(day).alias("last_day")
    )


@query("SELECT asset, round(avg(ret), 3) + 0 AS mean_ret, round(max(price), 2) AS top FROM ret JOIN panel USING (asset, date) GROUP BY 1")
def t16_publication_rounding(spark, d):
    return rets(spark, d).join(panel(spark, d), ["asset", "date"]).groupBy("asset").agg(F.round(F.avg("ret"), 3).alias("mean_ret"), F.round(F.max("price"), 2).alias("top"))


@query(_with(_MOVES, """SELECT event_id, CASE WHEN kept THEN 'RETAINED' WHEN n_moved < 2 THEN 'DROPPED_STAGE2' ELSE 'DROPPED_STAGE34' END AS disposition,
  CASE WHEN kept THEN '' WHEN n_moved = 0 THEN 'no asset moved by more than one sd' WHEN n_moved < 2 THEN format('only {} asset moved by more than one sd; two are needed', n_moved) ELSE 'passes the screen; left out later' END AS reason
  FROM (SELECT *, event_id IN (SELECT event_id FROM cal) AS kept FROM census)"""))
def t17_disposition(spark, d):
    rows = _census(spark, d).join(events(spark, d).select("event_id", F.lit(True).alias("kept")), "event_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    what = F.when(F.col("kept"), DISPOSITION[0]).when(F.col("n_moved") < 2, DISPOSITION[1]).otherwise(DISPOSITION[2])
    why = F.when(F.col("kept"), "").when(F.col("n_moved") == 0, "no asset moved by more than one sd").when(F.col("n_moved") < 2, F.format_string("only %d asset moved by more than one sd; two are needed", "n_moved")).otherwise("passes the screen; left out later")
    return rows.select("event_id", what.alias("disposition"), why.alias("reason"))


@query("""SELECT asset, CASE WHEN u AND NOT k THEN 'I(0)' WHEN NOT u AND k THEN 'I(1)' WHEN u AND k THEN 'ambiguous/near-I(1)' ELSE 'ambiguous (neither rejects)' END AS verdict
  FROM (SELECT asset, corr(ret, lag1) < -0.45 AS u, avg(ret) > 0 AS k FROM (SELECT asset, ret, lag(ret) OVER (PARTITION BY asset ORDER BY date) AS lag1 FROM ret) GROUP BY 1)""")
def t18_integration_verdict(spark, d):
    rows = ts.lags(rets(spark, d), "ret", 1).groupBy("asset").agg((F.corr("ret", "ret_l1") < -0.45).alias("u"), (F.avg("ret") > 0).alias("k"))
    return rows.select("asset", integration_verdict(F.col("u"), F.col("k")).alias("verdict"))


def integration_verdict(unit_root_rejected, stationary_rejected):
    u, k = unit_root_rejected, stationary_rejected
    return F.when(u & ~k, INTEGRATION[0]).when(~u & k, INTEGRATION[1]).when(u & k, INTEGRATION[2]).otherwise(INTEGRATION[3])


def direction_label(p_forward, p_back, level: float = 0.05):
    a, b = p_forward < level, p_back < level
    return F.when(a & ~b, DIRECTION[0]).when(b & ~a, DIRECTION[1]).when(a & b, DIRECTION[2]).otherwise(DIRECTION[3])


_PS = "ps AS (SELECT asset, count(*) FILTER (ret > 0) / count(*) - 0.45 AS p1, count(*) FILTER (ret < -20) / count(*) * 0.25 AS p2 FROM ret GROUP BY 1)"


def _shares(spark, d):
    r = F.col("ret")
    return rets(spark, d).groupBy("asset").agg((F.count_if(r > 0) / F.count(r) - 0.45).alias("p1"), (F.count_if(r < -20) / F.count(r) * 0.25).alias("p2"))


@query(_with(_PS, "SELECT asset, CASE WHEN p1 < 0.05 AND p2 >= 0.05 THEN 'Sentiment LEADS' WHEN p2 < 0.05 AND p1 >= 0.05 THEN 'Returns LEAD' WHEN p1 < 0.05 AND p2 < 0.05 THEN 'Bidirectional' ELSE 'Neither (independent)' END AS direction FROM ps"))
def t19_direction_label(spark, d):
    return _shares(spark, d).select("asset", direction_label(F.col("p1"), F.col("p2")).alias("direction"))


def significance(p):
    return F.when(p.isNull(), "n/a").when(p < 0.01, "strong").when(p < 0.05, "significant").when(p < 0.10, "weak").otherwise("none")


@query(_with(_PS, "SELECT asset, CASE WHEN p1 IS NULL THEN 'n/a' WHEN p1 < 0.01 THEN 'strong' WHEN p1 < 0.05 THEN 'significant' WHEN p1 < 0.10 THEN 'weak' ELSE 'none' END AS verdict FROM ps"))
def t20_cutoff_label(spark, d):
    return _shares(spark, d).select("asset", significance(F.col("p1")).alias("verdict"))


@query(f"""SELECT asset, count(*) AS n_rows, count(*) FILTER (ret IS NULL) AS n_null, count(*) FILTER (isinf(ret)) AS n_infinite, date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS missing_days,
  round(min(ret), 6) AS lowest, round(max(ret), 6) AS highest, CAST(sum(d_infrastructure) AS BIGINT) AS days_d_infrastructure, CAST(sum(d_regulatory) AS BIGINT) AS days_d_regulatory FROM dummies GROUP BY 1""")
def t21_quality_report(spark, d):
    rows = win.event_dummies(rets(spark, d), events(spark, d))
    return rounded(ts.quality(rows, "ret", ["d_infrastructure", "d_regulatory"]))


@query(f"SELECT asset, {r6('annual_vol')} FROM (SELECT asset, stddev_samp(ret) * sqrt(252) AS annual_vol FROM ret GROUP BY 1)")
def t22_annual_volatility(spark, d):
    return rounded(st.moments(rets(spark, d)).select("asset", "annual_vol"))


# ---- joins -----------------------------------------------------------------


@query("SELECT asset, date, round(ret, 6) + 0 AS ret, round(coalesce(z, 0), 6) + 0 AS z FROM ret LEFT JOIN zs ON zs.week_start = ret.date")
def j1_left_join_zero_fill(spark, d):
    z = ts.rolling_zscore(weeks(spark, d), "raw", "week_start").select(F.col("week_start").alias("date"), "z")
    return rounded(cal.reindex(rets(spark, d), z, ["z"]))


_DAILY = f"""days AS (SELECT CAST(unnest(generate_series((SELECT min(week_start) FROM wk), (SELECT max(date) FROM ret), INTERVAL 1 DAY)) AS DATE) AS date),
daily AS (SELECT d.date, last_value(z.z IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS z, last_value(z.raw IGNORE NULLS) OVER (ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS raw FROM days d LEFT JOIN zs z ON z.week_start = d.date)"""


def _daily(spark, d):
    z = ts.rolling_zscore(weeks(spark, d), "raw", "week_start")
    days = ts.daily_calendar(z.select(F.col("week_start").alias("date")), rets(spark, d))
    return ts.carry_forward(z, days, ["z", "raw"])


@query(_with(_DAILY, "SELECT asset, date, round(z, 6) + 0 AS z FROM (SELECT DISTINCT asset, date FROM ret) LEFT JOIN daily USING (date)"))
def j2_left_index_join(spark, d):
    return rounded(cal.reindex(rets(spark, d).select("asset", "date").distinct(), _daily(spark, d), ["z"], fill=None))


@query(_with(_DAILY, "SELECT date, round(z, 6) + 0 AS z, raw FROM daily"))
def j3_carry_forward(spark, d):
    return rounded(_daily(spark, d), keep=("raw",))


@query("SELECT r.asset, r.date, k.week_start, k.raw FROM ret r ASOF LEFT JOIN wk k ON r.date >= k.week_start")
def j3_as_of_join(spark, d):
    right = weeks(spark, d).select(F.col("week_start").alias("date"), "week_start", "raw")
    return ts.as_of(rets(spark, d).select("asset", "date"), right, ["week_start", "raw"], "date")


@query("SELECT asset, date, d_infrastructure, d_regulatory FROM dummies")
def j4_event_dummies(spark, d):
    return win.event_dummies(rets(spark, d).select("asset", "date"), events(spark, d))


_OVERRIDES = """ranked AS (SELECT *, row_number() OVER (ORDER BY date, event_id) AS k FROM cal),
ov AS (SELECT event_id, type, date AS event_date, CASE WHEN k IN (1, 2) THEN (SELECT min(date) - 3 FROM ranked WHERE k IN (1, 2)) WHEN k = 4 THEN date - 1 ELSE date - 3 END AS a,
  CASE WHEN k IN (1, 2) THEN (SELECT max(date) + 3 FROM ranked WHERE k IN (1, 2)) WHEN k = 3 THEN date + 1 ELSE date + 3 END AS b, CASE WHEN k BETWEEN 5 AND 12 THEN 0.5e0 END AS half FROM ranked),
ovd AS (SELECT o.event_id, o.type, o.half, r.date FROM ov o JOIN (SELECT DISTINCT date FROM ret) r ON r.date BETWEEN o.a AND o.b),
ovn AS (SELECT date, count(DISTINCT event_id) AS n FROM ovd WHERE half IS NOT NULL GROUP BY 1),
ovw AS (SELECT date, type, max(CASE WHEN half IS NOT NULL AND n > 1 THEN half ELSE 1e0 END) AS w FROM ovd LEFT JOIN ovn USING (date) GROUP BY 1, 2)
"""


@query(_with(_OVERRIDES, "SELECT r.date, coalesce(max(w) FILTER (type = 'Infrastructure'), 0) AS d_infrastructure, coalesce(max(w) FILTER (type = 'Regulatory'), 0) AS d_regulatory FROM (SELECT DISTINCT date FROM ret) r LEFT JOIN ovw USING (date) GROUP BY 1"))
def j5_overridden_windows(spark, d):
    """The first two events share one window, the third ends early, the fourth starts late, the next eight weigh half where they overlap."""
    cal_ = events(spark, d)
    ranked = cal_.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date", "event_id")))
    both = ranked.where("k <= 2").agg(F.date_sub(F.min("date"), 3).alias("a"), F.date_add(F.max("date"), 3).alias("b"))
    none = F.lit(None).cast("date")
    start = F.when(F.col("k") <= 2, F.col("a")).when(F.col("k") == 3, F.date_sub("date", 3)).when(F.col("k") == 4, F.date_sub("date", 1)).otherwise(none)
    end = F.when(F.col("k") <= 2, F.col("b")).when(F.col("k") == 3, F.date_add("date", 1)).when(F.col("k") == 4, F.date_add("date", 3)).otherwise(none)
    over = ranked.crossJoin(F.broadcast(both)).select("event_id", start.alias("window_start"), end.alias("window_end"), F.when(F.col("k").between(5, 12), 0.5).alias("weight"))
    return win.overridden_dummies(rets(spark, d).select("date").distinct(), cal_, over)


@query("""SELECT r.date, CAST(b AS BIGINT) AS before, CAST(max(CASE WHEN c.type = 'Infrastructure' AND r.date BETWEEN c.date - 3 AND c.date + 3 THEN 1 ELSE 0 END) AS DOUBLE) AS d_infrastructure,
  CAST(max(CASE WHEN c.type = 'Regulatory' AND r.date BETWEEN c.date - b AND c.date + 3 THEN 1 ELSE 0 END) AS DOUBLE) AS d_regulatory
  FROM (SELECT DISTINCT date FROM ret) r CROSS JOIN (SELECT unnest([3, 5, 7, 10]) AS b) CROSS JOIN cal c GROUP BY 1, 2""")
def j6_asymmetric_windows(spark, d):
    days, cal_, parts = rets(spark, d).select("date").distinct(), events(spark, d), None
    for b in (3, 5, 7, 10):
        part = win.asymmetric_dummies(days, cal_, {"Infrastructure": (3, 3), "Regulatory": (b, 3)}).withColumn("before", F.lit(b))
        parts = part if parts is None else parts.unionByName(part)
    return rounded(parts.select("date", "before", "d_infrastructure", "d_regulatory"))


@query("""SELECT r.date, CAST(max(CASE WHEN c.type = 'Infrastructure' AND r.date BETWEEN c.date - 10 AND c.date - 4 THEN 1 ELSE 0 END) AS DOUBLE) AS d_infrastructure,
  CAST(max(CASE WHEN c.type = 'Regulatory' AND r.date BETWEEN c.date - 10 AND c.date - 4 THEN 1 ELSE 0 END) AS DOUBLE) AS d_regulatory FROM (SELECT DISTINCT date FROM ret) r CROSS JOIN cal c GROUP BY 1""")
def j7_offset_windows(spark, d):
    return win.offset_dummies(rets(spark, d).select("date").distinct(), events(spark, d), -10, -4)


@query("SELECT event_id, type, date AS event_date, CAST(unnest(generate_series(date - INTERVAL 3 DAY, date + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM cal")
def j8_window_days(spark, d):
    return win.event_days(events(spark, d), -3, 3)


_BREAKS = "brk AS (SELECT a.asset, c.break_date FROM (SELECT DISTINCT asset FROM ret) a CROSS JOIN (SELECT min(date) AS break_date FROM cal WHERE type = 'Regulatory' GROUP BY year(date)) c WHERE a.asset < 'N' OR year(break_date) <> 1998)"


def _breaks(spark, d):
    by_year = events(spark, d).where("type = 'Regulatory'").groupBy(F.year("date").alias("y")).agg(F.min("date").alias("break_date"))
    return rets(spark, d).select("asset").distinct().crossJoin(F.broadcast(by_year)).where("asset < 'N' or y <> 1998").select("asset", "break_date")


@query(_with(_BREAKS, "SELECT r.asset, r.date, count(b.break_date) AS segment FROM ret r LEFT JOIN brk b ON b.asset = r.asset AND b.break_date <= r.date GROUP BY 1, 2"))
def j9_regime_segments(spark, d):
    return rounded(win.regime_segments(rets(spark, d).select("asset", "date"), _breaks(spark, d)))


@query(_with(_BREAKS, """SELECT r.asset, r.date, CAST(r.date >= lo AND r.date < hi AS DOUBLE) AS crisis FROM ret r JOIN (
  SELECT s.asset, CASE WHEN e IS NULL THEN first ELSE coalesce(st, (SELECT max(break_date) FROM brk b WHERE b.asset = s.asset AND b.break_date < e), first) END AS lo, coalesce(e, last + 1) AS hi
  FROM (SELECT asset, min(date) AS first, max(date) AS last FROM ret GROUP BY 1) s LEFT JOIN (SELECT asset, max(break_date) FILTER (year(break_date) = 1998) AS st, min(break_date) FILTER (year(break_date) > 1998) AS e FROM brk GROUP BY 1) m USING (asset)) w USING (asset)"""))
def j9_crisis_segment(spark, d):
    return win.crisis_dummy(rets(spark, d).select("asset", "date"), _breaks(spark, d), 1998)


@query("""SELECT e.week_start, count(c.event_id) AS ev_all, count(c.event_id) FILTER (lower(c.type) LIKE 'infra%') AS ev_infra, count(c.event_id) FILTER (lower(c.type) LIKE 'reg%') AS ev_reg
  FROM edges e LEFT JOIN cal c ON c.date >= e.week_start AND c.date < e.week_end GROUP BY 1""")
def j10_events_by_week(spark, d):
    return win.events_by_week(weeks(spark, d), events(spark, d))


@query("SELECT date FROM ret GROUP BY 1 HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM ret)")
def j11_common_calendar(spark, d):
    return cal.common_calendar(rets(spark, d))


_UNION = """bits AS (SELECT asset, row_number() OVER (ORDER BY asset) - 1 AS bit FROM (SELECT DISTINCT asset FROM ret)),
uni AS (SELECT date, CAST(sum(CAST(1 AS BIGINT) << CAST(bit AS BIGINT)) AS BIGINT) AS pattern, row_number() OVER (ORDER BY date) - 1 AS position FROM ret JOIN bits USING (asset) GROUP BY date)"""


@query(_with(_UNION, "SELECT date, position, pattern FROM uni"))
def j12_union_calendar(spark, d):
    return rounded(cal.union_calendar(rets(spark, d)))


@query(_with(_UNION, "SELECT pattern, count(*) AS n_days, min(date) AS first_day, max(date) AS last_day FROM uni GROUP BY 1"))
def j12_availability_patterns(spark, d):
    return cal.pattern_summary(cal.union_calendar(rets(spark, d)))


@query(f"SELECT asset, date, {r6('ret')} FROM ret WHERE date IN (SELECT date FROM ret GROUP BY 1 HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM ret))")
def j13_complete_cases(spark, d):
    return rounded(cal.complete_cases(rets(spark, d)).select("asset", "date", "ret"))


@query("SELECT a.asset, c.date, round(coalesce(r.ret, 0), 6) + 0 AS ret FROM (SELECT DISTINCT asset FROM ret) a CROSS JOIN (SELECT DISTINCT date FROM ret) c LEFT JOIN ret r USING (asset, date)")
def j14_reindex_zero(spark, d):
    r = rets(spark, d)
    grid = r.select("asset").distinct().crossJoin(r.select("date").distinct())
    return rounded(cal.reindex(grid, r, ["ret"], keys=("asset", "date")).select("asset", "date", "ret"))


@query(_with(_UNION, "SELECT asset, date, position FROM ret JOIN uni USING (date)"))
def j15_positions(spark, d):
    r = rets(spark, d)
    return rounded(r.select("asset", "date").join(cal.positions(r), "date").select("asset", "date", "position"))


@query(_with(_UNION, "SELECT asset, date, position, CAST(position * 10 + bit AS DOUBLE) AS draw FROM ret JOIN uni USING (date) JOIN bits USING (asset)"))
def j16_scatter(spark, d):
    r = rets(spark, d)
    order = r.select("asset").distinct().withColumn("bit", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("asset")) - 1)
    draws = cal.positions(r).crossJoin(order).select("position", "asset", (F.col("position") * 10 + F.col("bit")).cast("double").alias("draw"))
    return rounded(cal.scatter(draws, r).select("asset", "date", "position", "draw"))


@query("""WITH big AS (SELECT CAST(o_orderdate AS DATE) AS crisis_day, o_orderkey AS k FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.999) FROM orders)),
brk AS (SELECT DISTINCT CAST(date_trunc('year', o_orderdate) AS DATE) AS break_day FROM orders)
SELECT b.break_day, count(c.k) AS n_near, coalesce(string_agg(CAST(c.k AS VARCHAR), ';' ORDER BY abs(date_diff('day', b.break_day, c.crisis_day)), c.k), '') AS near FROM brk b LEFT JOIN big c ON abs(date_diff('day', b.break_day, c.crisis_day)) <= 60 GROUP BY 1""")
def j17_nearest_dates(spark, d):
    orders = adapters.table(spark, d, "orders")
    edge = orders.agg(F.percentile("o_totalprice", F.lit(0.999)).alias("q"))
    big = orders.crossJoin(F.broadcast(edge)).where("o_totalprice > q").select(F.to_date("o_orderdate").alias("crisis_day"), F.col("o_orderkey").alias("k"))
    breaks = orders.select(F.to_date(F.date_trunc("year", "o_orderdate")).alias("break_day")).distinct()
    return rounded(cal.nearest(breaks, big, 60, "break_day", "crisis_day", "k"))


@query(_with(_MOVES, "SELECT type, count(*) AS n, count(*) FILTER (event_id IN (SELECT event_id FROM cal)) AS also_in_calendar FROM census GROUP BY 1"))
def j18_key_lookup(spark, d):
    pool, kept = _census(spark, d), events(spark, d).select("event_id")
    hit = pool.join(kept, "event_id", "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("also_in_calendar"))
    return pool.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(hit, "type", "left").select("type", "n", F.coalesce("also_in_calendar", F.lit(0)).alias("also_in_calendar"))


@query("SELECT n.n_name AS label, r.r_name AS region, count(c.c_custkey) AS n FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2")
def j19_label_lookup(spark, d):
    nation, region, customer = (adapters.table(spark, d, t) for t in ("nation", "region", "customer"))
    counts = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).join(counts, "n_nationkey", "left")
    return rows.select(F.col("n_name").alias("label"), F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- aggregations ----------------------------------------------------------


@query(f"SELECT event_id, type, {r6('mean_car')}, n_assets FROM levels")
def g1_event_mean(spark, d):
    from tidemark.plans.studies import levels

    return rounded(levels(spark, d))


@query(f"SELECT type, {r6('mean_of_means', 'first_mean')} FROM (SELECT type, avg(m) AS mean_of_means, arg_min(m, asset) AS first_mean FROM (SELECT type, asset, avg(car) AS m FROM cm WHERE status = 'ok' GROUP BY 1, 2) GROUP BY 1)")
def g2_nested_mean(spark, d):
    from tidemark.plans.studies import cars

    by = cars(spark, d).where("status = 'ok'").groupBy("type", "asset").agg(F.avg("car").alias("m"))
    return rounded(by.groupBy("type").agg(F.avg("m").alias("mean_of_means"), F.min_by("m", "asset").alias("first_mean")))


@query(f"SELECT asset, n, {r6('mean', 'sd', 'skew', 'kurtosis', 'annual_vol')} FROM (SELECT asset, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, skewness(ret) AS skew, kurtosis(ret) AS kurtosis, stddev_samp(ret) * sqrt(252) AS annual_vol FROM ret GROUP BY 1)")
def g3_moments(spark, d):
    return rounded(st.moments(rets(spark, d)))


@query(f"SELECT asset, {r6('sd')} FROM (SELECT asset, stddev_samp(ret) AS sd FROM logret WHERE date BETWEEN '1995-06-01' AND '2001-01-01' GROUP BY 1)")
def g4_window_sd(spark, d):
    return rounded(ts.between(rets(spark, d, "log"), "1995-06-01", "2001-01-01").groupBy("asset").agg(F.stddev_samp("ret").alias("sd")))


@query(_with(_MOVES, "SELECT event_id, date, type, n_moved, n_moved >= 2 AS pass_std, n_moved >= 1 AS pass_relaxed, n_moved >= 3 AS pass_strict FROM census"))
def g5_impact_screen(spark, d):
    n = F.col("n_moved")
    return rounded(_census(spark, d).select("event_id", "date", "type", "n_moved", (n >= 2).alias("pass_std"), (n >= 1).alias("pass_relaxed"), (n >= 3).alias("pass_strict")))


@query(_with(_MOVES, "SELECT type, count(*) AS n, count(*) FILTER (n_moved >= 2) AS n_pass, round(count(*) FILTER (n_moved >= 2) / count(*), 6) AS rate FROM census GROUP BY 1"))
def g6_rates(spark, d):
    return rounded(_census(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_moved") >= 2).alias("n_pass"), (F.count_if(F.col("n_moved") >= 2) / F.count(F.lit(1))).alias("rate")))


@query(f"SELECT asset, week_start, {r6('wk_ret', 'wk_absvol')} FROM wkvol")
def g7_weekly_volatility(spark, d):
    return rounded(ts.weekly_volatility(rets(spark, d), weeks(spark, d)))


@query("SELECT week_start, " + ", ".join(f"round(max(wk_absvol) FILTER (asset = '{a}'), 6) AS {a}" for a in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM wkvol GROUP BY 1")
def g8_weekly_pivot(spark, d):
    return rounded(cal.wide(ts.weekly_volatility(rets(spark, d), weeks(spark, d)), ["AF", "AO", "NF", "NO", "RF", "RO"], "wk_absvol", "week_start"))


_COEF = """coef AS (SELECT k AS spec, asset, avg(ret) FILTER (d_infrastructure = 1) AS a, avg(ret) FILTER (d_regulatory = 1) AS b FROM (SELECT *, year(date) % 3 AS k FROM dummies) GROUP BY 1, 2)"""


@query(_with(_COEF, f"""SELECT spec, {r6('mean_a', 'median_a', 'var_a')}, n_a, {r6('mean_b', 'median_b', 'var_b')}, n_b, {r6('multiplier', 'welch_t', 'cohens_d')} FROM (SELECT spec, avg(a) AS mean_a, median(a) AS median_a, var_samp(a) AS var_a, count(a) AS n_a,
  avg(b) AS mean_b, median(b) AS median_b, var_samp(b) AS var_b, count(b) AS n_b, avg(a) / nullif(avg(b), 0) AS multiplier, (avg(a) - avg(b)) / sqrt(var_samp(a) / count(a) + var_samp(b) / count(b)) AS welch_t,
  (avg(a) - avg(b)) / sqrt((var_samp(a) + var_samp(b)) / 2) AS cohens_d FROM coef GROUP BY 1)"""))
def g9_coefficient_summary(spark, d):
    rows = win.event_dummies(rets(spark, d), events(spark, d)).withColumn("spec", F.year("date") % 3)
    coef = rows.groupBy("spec", "asset").agg(F.avg(F.when(F.col("d_infrastructure") == 1, F.col("ret"))).alias("a"), F.avg(F.when(F.col("d_regulatory") == 1, F.col("ret"))).alias("b"))
    return rounded(st.coefficient_summary(coef, "spec", "a", "b"))


@query(f"""SELECT asset, date, {r6('mkt')} FROM (SELECT a.asset, x.date, avg(o.ret) AS mkt, count(o.ret) AS k FROM (SELECT DISTINCT asset FROM simple) a CROSS JOIN (SELECT DISTINCT date FROM simple) x JOIN simple o ON o.date = x.date AND o.asset <> a.asset GROUP BY 1, 2)
  WHERE k = (SELECT count(DISTINCT asset) - 1 FROM simple)""")
def g10_market_without_asset(spark, d):
    from tidemark.operators.event_study import market_without

    return rounded(market_without(rets(spark, d, "simple")))


@query(f"SELECT asset, week_start, {r6('others')} FROM (SELECT a.asset, a.week_start, avg(o.wk_absvol) AS others FROM wkvol a JOIN wkvol o ON o.week_start = a.week_start AND o.asset <> a.asset GROUP BY 1, 2) WHERE others IS NOT NULL")
def g11_other_volatility(spark, d):
    from tidemark.operators.event_study import market_without

    vol = ts.weekly_volatility(rets(spark, d), weeks(spark, d)).select("asset", F.col("week_start").alias("date"), F.col("wk_absvol").alias("ret"))
    return rounded(market_without(vol, complete=False).select("asset", F.col("date").alias("week_start"), F.col("mkt").alias("others")))


_PAIRS = """cc AS (SELECT * FROM ret WHERE date IN (SELECT date FROM ret GROUP BY 1 HAVING count(DISTINCT asset) = (SELECT count(DISTINCT asset) FROM ret))),
prs AS (SELECT x.asset AS a, y.asset AS b, corr(x.ret, y.ret) AS corr, covar_samp(x.ret, y.ret) AS cov, count(*) AS n FROM cc x JOIN cc y USING (date) GROUP BY 1, 2)"""


@query(_with(_PAIRS, f"SELECT a, b, {r6('corr', 'cov')}, n FROM prs"))
def g12_correlation_matrix(spark, d):
    return rounded(st.correlations(rets(spark, d)))


@query(_with(_PAIRS, f"SELECT {r6('rbar', 'highest')} FROM (SELECT avg(corr) AS rbar, max(abs(corr)) AS highest FROM prs WHERE a <> b)"))
def g12_mean_correlation(spark, d):
    return rounded(st.mean_off_diagonal(st.correlations(rets(spark, d))))


@query(_with(_PAIRS, "SELECT round(total / own, 6) AS design_effect, round(own, 6) AS variances FROM (SELECT sum(cov) AS total, sum(cov) FILTER (a = b) AS own FROM prs)"))
def g14_covariance_ratio(spark, d):
    p = st.correlations(rets(spark, d))
    own = F.sum(F.when(F.col("a") == F.col("b"), F.col("cov")))
    return rounded(p.agg((F.sum("cov") / own).alias("design_effect"), own.alias("variances")))


_WARM = "warm AS (SELECT asset, CASE WHEN week_start < (SELECT min(week_start) + 182 FROM wk) THEN 1 ELSE 0 END AS imputed, lag(wk_absvol) OVER (PARTITION BY asset ORDER BY week_start) AS vol_l1 FROM wkvol)"


@query(_with(_WARM, f"""SELECT asset, n00, n01, n10, n11, round((n00 + n01 + n10 + n11) * power(greatest(abs(n00 * n11 - n01 * n10) - (n00 + n01 + n10 + n11) / 2, 0), 2) / nullif(CAST(n00 + n01 AS DOUBLE) * (n10 + n11) * (n00 + n10) * (n01 + n11), 0), 6) + 0 AS chi2_yates FROM (
  SELECT asset, count(*) FILTER (imputed = 0 AND NOT hi) AS n00, count(*) FILTER (imputed = 0 AND hi) AS n01, count(*) FILTER (imputed = 1 AND NOT hi) AS n10, count(*) FILTER (imputed = 1 AND hi) AS n11 FROM (
    SELECT asset, imputed, vol_l1 > median(vol_l1) OVER (PARTITION BY asset) AS hi FROM warm WHERE vol_l1 IS NOT NULL) GROUP BY 1)"""))
def g15_contingency(spark, d):
    k = weeks(spark, d)
    first = k.agg(F.date_add(F.min("week_start"), 182).alias("edge"))
    vol = ts.weekly_volatility(rets(spark, d), k).withColumn("vol_l1", F.lag("wk_absvol").over(Window.partitionBy("asset").orderBy("week_start")))
    rows = vol.crossJoin(F.broadcast(first)).withColumn("imputed", (F.col("week_start") < F.col("edge")).cast("int"))
    return rounded(st.contingency(rows, "imputed", "vol_l1"))


_MODELS = "mdl AS (SELECT asset, 'm' || (year(date) % 4) AS model, stddev_samp(ret) AS aic FROM ret GROUP BY 1, 2)"


def _models(spark, d):
    return rets(spark, d).groupBy("asset", F.concat(F.lit("m"), (F.year("date") % 4).cast("string")).alias("model")).agg(F.stddev_samp("ret").alias("aic"))


@query(_with(_MODELS, "SELECT asset, arg_min(model, aic) AS winner, round(min(aic), 6) AS best, round(CASE WHEN count(*) > 1 THEN list_sort(list(aic))[2] - min(aic) END, 6) AS margin FROM mdl GROUP BY 1"))
def g16_arg_min(spark, d):
    return rounded(st.best_model(_models(spark, d), ["asset"], "model", "aic"))


@query("SELECT type, count(DISTINCT date) AS n_days, count(DISTINCT year(date)) AS n_years, count(*) AS n FROM pool GROUP BY 1")
def g17_distinct_counts(spark, d):
    return candidates(spark, d).groupBy("type").agg(F.count_distinct("date").alias("n_days"), F.count_distinct(F.year("date")).alias("n_years"), F.count(F.lit(1)).alias("n"))


def _coverage_sql(strict: bool) -> str:
    short = "status = 'ok' AND event_n <> 36" if strict else "false"
    return f"""SELECT count(*) AS total, count(*) FILTER (why IS NULL) AS usable, count(*) FILTER (why IS NOT NULL) AS missing, count(*) FILTER (why = 'estimation') AS missing_estimation, count(*) FILTER (why = 'event_window') AS missing_event_window,
  coalesce(string_agg(event_id || ':' || asset, ';' ORDER BY event_id, asset) FILTER (why IS NOT NULL), '') AS missing_cells FROM (SELECT *, CASE WHEN status = 'insufficient_estimation' THEN 'estimation' WHEN status = 'insufficient_event_window' OR {short} THEN 'event_window' END AS why FROM cm)"""


@query(_coverage_sql(False))
def g18_coverage(spark, d):
    from tidemark.operators.event_study import coverage
    from tidemark.plans.studies import cars

    return coverage(cars(spark, d))


@query(_coverage_sql(True))
def g18_coverage_strict(spark, d):
    from tidemark.operators.event_study import coverage
    from tidemark.plans.studies import cars

    return coverage(cars(spark, d), 36)


@query(f"""SELECT count(x) AS n_used, count(*) FILTER (x >= 1.5) AS hits, round((count(*) FILTER (x >= 1.5) + 1) / (count(x) + 1), 6) AS p_one, round((count(*) FILTER (abs(x) >= 1.5) + 1) / (count(x) + 1), 6) AS p_abs,
  round(avg(x), 6) + 0 AS mean, round(stddev_samp(x), 6) AS sd, round(1 - count(x) / count(*), 6) AS share_dropped FROM (SELECT CASE WHEN abs(ret) < 80 THEN ret END AS x FROM ret)""")
def g19_draw_summary(spark, d):
    return rounded(st.draw_summary(rets(spark, d).select(F.when(F.abs("ret") < 80, F.col("ret")).alias("dbar")), 1.5))


@query("SELECT asset, round(quantile_cont(ret, 0.9), 6) AS crit_90, round(quantile_cont(ret, 0.95), 6) AS crit_95 FROM ret GROUP BY 1")
def g20_critical_values(spark, d):
    rows = rets(spark, d).groupBy("asset").agg(F.percentile("ret", F.array(F.lit(0.9), F.lit(0.95))).alias("q"))
    return rounded(rows.select("asset", F.col("q")[0].alias("crit_90"), F.col("q")[1].alias("crit_95")))


@query("SELECT asset, round(s, 6) AS size, n, round(sqrt(s * (1 - s) / n), 6) AS se FROM (SELECT asset, avg(CASE WHEN abs(ret) > 40 THEN 1e0 ELSE 0 END) AS s, count(ret) AS n FROM ret GROUP BY 1)")
def g21_rejection_rate(spark, d):
    return rounded(st.rejection_rate(rets(spark, d), F.abs("ret") > 40, "asset"))


# ---- windows, sorts, set operations ---------------------------------------


@query("SELECT asset, date, " + ", ".join(f"round(lag(ret, {k}) OVER w, 6) + 0 AS ret_l{k}" for k in range(1, 10)) + ", round(ret, 6) + 0 AS ret FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date)")
def w1_lags(spark, d):
    return rounded(ts.lags(rets(spark, d), "ret", 9))


@query("SELECT asset, date, round(avg(ret) OVER w, 6) + 0 AS mean, round(stddev_samp(ret) OVER w, 6) AS sd, count(ret) OVER w AS n FROM ret WINDOW w AS (PARTITION BY asset ORDER BY date ROWS 29 PRECEDING)")
def w3_rolling(spark, d):
    w = ts.by_asset().rowsBetween(-29, 0)
    return rounded(rets(spark, d).select("asset", "date", F.avg("ret").over(w).alias("mean"), F.stddev_samp("ret").over(w).alias("sd"), F.count("ret").over(w).alias("n")))


@query("SELECT week_start, week_end FROM edges")
def w6_next_edge(spark, d):
    return ts.week_edges(weeks(spark, d))


@query(_with(_MODELS, "SELECT asset, model, round(aic, 6) AS aic, row_number() OVER (PARTITION BY asset ORDER BY aic, model) AS place FROM mdl"))
def o1_sorted_models(spark, d):
    return rounded(_models(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("asset").orderBy("aic", "model"))))


@query("""SELECT asset, model, round(negll, 6) AS negll FROM (SELECT asset, year(date) AS model, count(*) >= 300 AS ok, stddev_samp(ret) AS negll FROM ret GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY asset ORDER BY NOT ok, negll, model) = 1""")
def o3_best_fit(spark, d):
    fits = rets(spark, d).groupBy("asset", F.year("date").alias("model")).agg((F.count(F.lit(1)) >= 300).alias("ok"), F.stddev_samp("ret").alias("negll"))
    best = fits.groupBy("asset").agg(F.min(F.struct((~F.col("ok")).alias("bad"), "negll", "model")).alias("b"))
    return rounded(best.select("asset", "b.model", "b.negll"))


@query("SELECT 'calendar' AS origin, type, count(*) AS n FROM cal GROUP BY 2 UNION ALL SELECT 'pool', type, count(*) FROM pool GROUP BY 2")
def o4_union(spark, d):
    a, b = (f(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")) for f in (events, candidates))
    return a.select(F.lit("calendar").alias("origin"), "type", "n").unionByName(b.select(F.lit("pool").alias("origin"), "type", "n"))


@query("SELECT event_id, type FROM cal INTERSECT SELECT event_id, type FROM pool")
def o5_intersection(spark, d):
    return events(spark, d).select("event_id", "type").intersect(candidates(spark, d).select("event_id", "type"))


@query(f"SELECT asset, date, d_infrastructure, d_regulatory, round(z, 6) + 0 AS z FROM dummies LEFT JOIN (SELECT week_start AS date, z FROM zs) USING (date)")
def o6_column_concat(spark, d):
    z = ts.rolling_zscore(weeks(spark, d), "raw", "week_start").select(F.col("week_start").alias("date"), "z")
    rows = win.event_dummies(rets(spark, d).select("asset", "date"), events(spark, d))
    return rounded(rows.join(z, "date", "left").select("asset", "date", "d_infrastructure", "d_regulatory", "z"))
