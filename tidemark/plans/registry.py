"""The registry of queries and the common parts of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import StudyConfig
from tidemark.operators import timeseries as ts
from tidemark.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CFG = StudyConfig()
START, END = "1995-06-01", "2001-06-30"
CUTOFF = "1996-06-01"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql if sql.lstrip().upper().startswith("WITH") else BASE + sql
        return f

    return keep


def rounded(rows: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show, but for exact ones in ``keep``; integers as long."""
    cast = {"double": lambda c: F.round(c, digits), "float": lambda c: F.round(c.cast("double"), digits), "int": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long")}
    return rows.select(*(F.col(f"`{c}`") if c in keep else cast.get(t, lambda c: c)(F.col(f"`{c}`")).alias(c) for c, t in rows.dtypes))


def panel(spark: SparkSession, d: str) -> DataFrame:
    return adapters.price_panel(adapters.table(spark, d, "lineitem"))


def rets(spark: SparkSession, d: str, kind: str = "percent_log") -> DataFrame:
    return ts.returns(panel(spark, d), kind, START, END)


def events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.event_calendar(adapters.table(spark, d, "orders"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return adapters.candidate_pool(adapters.table(spark, d, "orders"))


def weeks(spark: SparkSession, d: str) -> DataFrame:
    return adapters.weekly_sentiment(adapters.table(spark, d, "orders"))


def _calendar_sql(name: str, unit: str) -> str:
    return f"""{name} AS (SELECT event_id, date, type, 'order ' || event_id AS label, magnitude FROM (
  SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Infrastructure' ELSE 'Regulatory' END AS type,
    o_totalprice AS magnitude, row_number() OVER (PARTITION BY date_trunc('{unit}', o_orderdate), CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) WHERE rn = 1)"""


#: Common table expressions: panel, returns of each kind, event calendars, weeks and their days.
BASE = f"""WITH quotes AS (SELECT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price, l_orderkey, l_linenumber FROM lineitem),
panel AS (SELECT asset, date, CAST(sum(CAST(round(price * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100e0) AS price FROM quotes GROUP BY 1, 2),
sliced AS (SELECT * FROM panel WHERE date BETWEEN '{START}' AND '{END}'),
moved AS (SELECT asset, date, price, lag(price) OVER (PARTITION BY asset ORDER BY date) AS last FROM sliced),
ret AS (SELECT asset, date, 100 * ln(price / last) AS ret FROM moved WHERE last IS NOT NULL),
logret AS (SELECT asset, date, ln(price) - ln(last) AS ret FROM moved WHERE last IS NOT NULL),
simple AS (SELECT asset, date, price / last - 1 AS ret FROM moved WHERE last IS NOT NULL),
{_calendar_sql("cal", "quarter")},
{_calendar_sql("pool", "month")},
wk AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100e0) AS raw,
  count(*) FILTER (o_orderpriority NOT IN ('1-URGENT','2-HIGH')) / count(*) AS reg_proportion, count(*) FILTER (o_orderpriority IN ('1-URGENT','2-HIGH')) / count(*) AS infra_proportion FROM orders GROUP BY 1),
edges AS (SELECT week_start, coalesce(lead(week_start) OVER (ORDER BY week_start), week_start + 7) AS week_end FROM wk),
wkvol AS (SELECT a.asset, e.week_start, sum(r.ret) AS wk_ret, sum(abs(r.ret)) AS wk_absvol FROM (SELECT DISTINCT asset FROM ret) a CROSS JOIN edges e
  LEFT JOIN ret r ON r.asset = a.asset AND r.date >= e.week_start AND r.date < e.week_end GROUP BY 1, 2),
zs AS (SELECT week_start, raw, reg_proportion, infra_proportion, CASE WHEN count(raw) OVER w >= 26 THEN (raw - avg(raw) OVER w) / stddev_samp(raw) OVER w END AS z FROM wk WINDOW w AS (ORDER BY week_start ROWS 51 PRECEDING)),
evdays AS (SELECT DISTINCT c.type, p.date FROM cal c JOIN (SELECT DISTINCT date FROM ret) p ON p.date BETWEEN c.date - 3 AND c.date + 3),
dummies AS (SELECT r.asset, r.date, r.ret, CASE WHEN i.date IS NULL THEN 0e0 ELSE 1e0 END AS d_infrastructure, CASE WHEN g.date IS NULL THEN 0e0 ELSE 1e0 END AS d_regulatory FROM ret r
  LEFT JOIN evdays i ON i.date = r.date AND i.type = 'Infrastructure' LEFT JOIN evdays g ON g.date = r.date AND g.type = 'Regulatory'),
sw AS (SELECT *, c.date - 31 AS est_end, c.date - 281 AS est_start FROM cal c),
cm0 AS (SELECT c.event_id, c.type, c.date AS event_date, a.asset,
    count(r.ret) FILTER (r.date <= c.date - 31) AS est_n, count(r.ret) FILTER (r.date BETWEEN c.date - 5 AND c.date + 30) AS event_n,
    avg(r.ret) FILTER (r.date <= c.date - 31) AS est_mean, stddev_samp(r.ret) FILTER (r.date <= c.date - 31) AS est_sd, sum(r.ret) FILTER (r.date BETWEEN c.date - 5 AND c.date + 30) AS event_sum
  FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM simple) a LEFT JOIN simple r ON r.asset = a.asset AND r.date BETWEEN c.date - 281 AND c.date + 30 GROUP BY 1, 2, 3, 4),
cm AS (SELECT *, CASE WHEN status = 'ok' THEN event_sum - event_n * est_mean END AS car, CASE WHEN status = 'ok' THEN (event_sum - event_n * est_mean) / (est_sd * sqrt(event_n)) END AS sar FROM (
  SELECT *, CASE WHEN est_n < 120 THEN 'insufficient_estimation' WHEN event_n < 5 THEN 'insufficient_event_window' ELSE 'ok' END AS status FROM cm0)),
levels AS (SELECT event_id, type, avg(car) AS mean_car, count(*) AS n_assets FROM cm WHERE status = 'ok' GROUP BY 1, 2),
ar AS (SELECT c.event_id, c.type, c.asset, r.date, r.ret - c.est_mean AS ar, c.est_n, c.est_sd FROM cm c JOIN simple r ON r.asset = c.asset AND r.date BETWEEN c.event_date - 5 AND c.event_date + 30 WHERE c.status = 'ok')
"""


def r6(*columns: str) -> str:
    """SQL that rounds columns as ``rounded`` does (and makes a negative zero zero)."""
    return ", ".join(f"round({c}, 6) + 0 AS {c}" for c in columns)
