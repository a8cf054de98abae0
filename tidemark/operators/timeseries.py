"""Returns, clipping, rolling statistics, carry-forward and weekly buckets over long tables (asset, date, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("percent_log", "log", "simple")


def by_asset(order: str = "date", keys: tuple[str, ...] = ("asset",)):
    return Window.partitionBy(*keys).orderBy(order)


def between(rows: DataFrame, start: str | None, end: str | None, date: str = "date") -> DataFrame:
    """Rows from start to end, both included."""
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is not None:
            rows = rows.where(f"{date} {op} date'{bound}'")
    return rows


def returns(panel: DataFrame, kind: str, start: str | None = None, end: str | None = None, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """(asset, date, ret). The slice is taken before differencing, so its first day has no return and is dropped.

    ``kind``: percent_log 100 ln(p / p'), log ln p - ln p', simple p / p' - 1. Rows with a null or non-positive price give
    null returns, which are dropped with the first.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    rows = between(panel, start, end)
    w = by_asset(keys=keys)
    price, last = F.col("price"), F.lag("price").over(w)
    made = {"percent_log": 100 * F.ln(F.try_divide(price, last)), "log": F.ln(price) - F.lag(F.ln(price)).over(w), "simple": F.try_divide(price, last) - 1}[kind]
    return rows.withColumn("ret", made).where("ret is not null").select(*keys, "date", "ret")


def clip(value: Column, low: Column, high: Column) -> Column:
    """The value within the bounds; a null bound does not bind."""
    return F.least(F.greatest(value, low), high)


def rolling_winsorise(rows: DataFrame, column: str = "ret", window: int = 30, sds: float = 5.0) -> DataFrame:
    """Adds ``<column>_w``: clipped to rolling mean plus or minus ``sds`` rolling standard deviations (row windows)."""
    w = by_asset().rowsBetween(1 - window, 0)
    mean, sd = F.avg(column).over(w), F.stddev_samp(column).over(w)
    return rows.withColumn(f"{column}_w", clip(F.col(column), mean - sds * sd, mean + sds * sd))


def global_winsorise(rows: DataFrame, column: str = "ret", low: float = 0.005, high: float = 0.995, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Adds ``<column>_w``: clipped to exact interpolated quantiles of its asset."""
    q = rows.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("_q"))
    return rows.join(q, list(keys)).withColumn(f"{column}_w", clip(F.col(column), F.col("_q")[0], F.col("_q")[1])).drop("_q")


def rolling_zscore(rows: DataFrame, column: str, order: str, window: int = 52, least: int = 26, flat: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``z``: (x - rolling mean) / rolling sd, null below ``least`` observations; 0 where the sd is below ``flat``."""
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(order).rowsBetween(1 - window, 0)
    mean, sd, n = F.avg(column).over(w), F.stddev_samp(column).over(w), F.count(column).over(w)
    z = F.try_divide(F.col(column) - mean, sd)
    if flat is not None:
        z = F.when(sd < flat, 0.0).otherwise(z)
    return rows.withColumn("z", F.when(n >= least, z))


def decompose(rows: DataFrame, z: str = "z") -> DataFrame:
    """Adds the theme shares of a z-score."""
    return rows.withColumns({"reg": F.col(z) * F.col("reg_proportion"), "infra": F.col(z) * F.col("infra_proportion")})


def zero_before(rows: DataFrame, columns: list[str], cutoff: str, date: str = "date") -> DataFrame:
    """Columns are 0 before the cutoff day; later nulls stay."""
    return rows.withColumns({c: F.when(F.col(date) < F.to_date(F.lit(cutoff)), 0.0).otherwise(F.col(c)) for c in columns})


def fill_zero(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def daily_calendar(first: DataFrame, last: DataFrame) -> DataFrame:
    """Every day from the least ``date`` of one table to the greatest of the other."""
    a, b = first.agg(F.min("date").alias("a")), last.agg(F.max("date").alias("b"))
    return a.crossJoin(b).select(F.explode(F.sequence("a", "b")).alias("date"))


def carry_forward(weekly: DataFrame, calendar: DataFrame, columns: list[str], key: str = "week_start") -> DataFrame:
    """Weekly values on every day of a calendar: the last value that was not null, never one from a later day."""
    rows = calendar.join(weekly.select(F.col(key).alias("date"), *columns), "date", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("date", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns))


def as_of(left: DataFrame, right: DataFrame, columns: list[str], on: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each left row with the right values last known at its time: union and carry, no range join.

    Only the distinct (keys, time) of the left side are ordered; its rows then take the values by an equi-join.
    """
    names = [f"_r_{c}" for c in columns]
    a = left.select(*keys, on).distinct().select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in zip(columns, names, strict=True)), F.lit(1).alias("_side"))
    b = right.select(*keys, on, *(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.lit(0).alias("_side"))
    w = Window.partitionBy(*(keys or (F.lit(0),))).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = a.unionByName(b).withColumns({n: F.last(n, ignorenulls=True).over(w) for n in names}).where("_side = 1").drop("_side")
    out = left.join(known, [*keys, on], "left")
    return out.select(*left.columns, *(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)))


def week_edges(weeks: DataFrame, key: str = "week_start") -> DataFrame:
    """(week_start, week_end): a week runs to the next row's start, whatever the hole; the last one has seven days."""
    w = Window.partitionBy(F.lit(0)).orderBy(key)
    return weeks.select(key).distinct().select(F.col(key).alias("week_start"), F.coalesce(F.lead(key).over(w), F.date_add(key, 7)).alias("week_end"))


def week_days(weeks: DataFrame) -> DataFrame:
    """(week_start, date) for every day of every week: the range join to weeks as an equi-join."""
    return week_edges(weeks).select("week_start", F.explode(F.sequence("week_start", F.date_sub("week_end", 1))).alias("date"))


def weekly_volatility(rets: DataFrame, weeks: DataFrame) -> DataFrame:
    """(asset, week_start, wk_ret, wk_absvol): sums of returns and of their sizes; null in weeks without returns."""
    sums = rets.join(week_days(weeks), "date").groupBy("asset", "week_start").agg(F.sum("ret").alias("wk_ret"), F.sum(F.abs("ret")).alias("wk_absvol"))
    grid = rets.select("asset").distinct().crossJoin(weeks.select("week_start").distinct())
    return grid.join(sums, ["asset", "week_start"], "left")


def lags(rows: DataFrame, column: str, most: int, order: str = "date", keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Adds ``<column>_l1`` ... up to ``most``."""
    w = by_asset(order, keys)
    return rows.withColumns({f"{column}_l{k}": F.lag(column, k).over(w) for k in range(1, most + 1)})


def quality(rows: DataFrame, value: str, flags: list[str]) -> DataFrame:
    """One row for each asset: rows, nulls, infinities, missing days, extremes, totals of the flags."""
    infinite = F.col(value).isin(float("inf"), float("-inf"))
    return rows.groupBy("asset").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
        F.count_if(infinite).alias("n_infinite"),
        (F.datediff(F.max("date"), F.min("date")) + 1 - F.count_distinct("date")).alias("missing_days"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        *(F.sum(f).cast("long").alias(f"days_{f}") for f in flags),
    )


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
