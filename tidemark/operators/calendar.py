"""Alignment of series: common and union calendars, availability, reindexing, nearest dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def common_calendar(panel: DataFrame) -> DataFrame:
    """Days that every asset has."""
    assets = panel.agg(F.count_distinct("asset").alias("n"))
    by = panel.groupBy("date").agg(F.count_distinct("asset").alias("k"))
    return by.crossJoin(F.broadcast(assets)).where("k = n").select("date")


def positions(calendar: DataFrame) -> DataFrame:
    """(date, position), from 0 in date order."""
    return calendar.select("date").distinct().withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)


def union_calendar(panel: DataFrame) -> DataFrame:
    """(date, position, pattern): days that any asset has; bit k of the pattern says whether the k-th asset has the day."""
    order = panel.select("asset").distinct().withColumn("bit", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("asset")) - 1)
    rows = panel.select("asset", "date").distinct().join(F.broadcast(order), "asset")
    by = rows.groupBy("date").agg(F.sum(F.expr("shiftleft(1L, cast(bit as int))")).alias("pattern"))
    return by.join(positions(by), "date").select("date", "position", "pattern")


def pattern_summary(calendar: DataFrame) -> DataFrame:
    """(pattern, n_days, first_day, last_day)."""
    return calendar.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


def complete_cases(panel: DataFrame, value: str = "ret") -> DataFrame:
    """Rows of days on which every asset has a value."""
    rows = panel.where(F.col(value).isNotNull())
    return rows.join(common_calendar(rows), "date", "left_semi")


def wide(panel: DataFrame, assets: list[str], value: str = "ret", key: str = "date") -> DataFrame:
    return panel.groupBy(key).pivot("asset", assets).agg(F.first(value))


def reindex(target: DataFrame, values: DataFrame, columns: list[str], keys: tuple[str, ...] = ("date",), fill: float | None = 0.0) -> DataFrame:
    """``target`` with the columns of ``values`` where the keys meet, ``fill`` elsewhere and for nulls."""
    rows = target.join(values.select(*keys, *columns), list(keys), "left")
    return rows if fill is None else rows.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in columns})


def scatter(draws: DataFrame, panel: DataFrame) -> DataFrame:
    """Values by (position, asset) on the days each asset has; other coordinates are left out."""
    days = union_calendar(panel).select("date", "position")
    return panel.select("asset", "date").join(days, "date").join(draws, ["position", "asset"])


def nearest(left: DataFrame, right: DataFrame, days: int, left_date: str, right_date: str, label: str) -> DataFrame:
    """Each left row with the labels of right rows within ``days`` days, nearest first then by label, and their number.

    The band becomes an equi-join on buckets of its width and their neighbours.
    """
    width = 2 * days + 1
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width)
    a = left.withColumn("_id", F.monotonically_increasing_id())
    near = a.select("_id", F.col(left_date).alias("_d"), F.explode(F.array(bucket(left_date) - 1, bucket(left_date), bucket(left_date) + 1)).alias("_b"))
    hits = near.join(right.select(F.col(right_date).alias("_r"), F.col(label).alias("_label"), bucket(right_date).alias("_b")), "_b")
    gap = F.abs(F.datediff("_d", "_r"))
    found = hits.where(gap <= days).groupBy("_d").agg(F.sort_array(F.collect_set(F.struct(gap.alias("gap"), F.col("_label").alias("label")))).alias("_hits"))
    rows = left.join(found, F.col(left_date) == F.col("_d"), "left")
    return rows.select(*left.columns, F.coalesce(F.size("_hits"), F.lit(0)).alias("n_near"), F.array_join(F.transform(F.coalesce(F.col("_hits.label"), F.array().cast("array<string>")), lambda x: x.cast("string")), ";").alias("near"))
