"""Event windows, regime segments and week buckets. Range conditions become equi-joins on exploded days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = {"Infrastructure": "d_infrastructure", "Regulatory": "d_regulatory"}


def event_days(events: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """(event_id, type, event_date, date) for each day from ``first`` to ``last`` around the event, both included."""
    a = F.lit(first) if isinstance(first, int) else first
    b = F.lit(last) if isinstance(last, int) else last
    days = F.sequence(F.date_add("date", a), F.date_add("date", b))
    return events.select("event_id", "type", F.col("date").alias("event_date"), F.explode(days).alias("date"))


def mark(calendar: DataFrame, days: DataFrame, weight: str | None = None) -> DataFrame:
    """``calendar`` (with ``date``) and a column for each type: the greatest weight of its events' days, else 0."""
    value = F.col(weight) if weight else F.lit(1.0)
    by = days.groupBy("date").agg(*(F.max(F.when(F.col("type") == k, value)).alias(c) for k, c in TYPES.items()))
    return calendar.join(by, "date", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in TYPES.values()})


def event_dummies(calendar: DataFrame, events: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """1 on days within an event's window, by type."""
    return mark(calendar, event_days(events, -before, after))


def asymmetric_dummies(calendar: DataFrame, events: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """As ``event_dummies`` with (before, after) for each type."""
    before, after = F.lit(None).cast("int"), F.lit(None).cast("int")
    for kind, (b, a) in windows.items():
        before, after = F.when(F.col("type") == kind, b).otherwise(before), F.when(F.col("type") == kind, a).otherwise(after)
    return mark(calendar, event_days(events.where(F.col("type").isin(*windows)), -before, after))


def offset_dummies(calendar: DataFrame, events: DataFrame, low: int, high: int) -> DataFrame:
    """1 on days from ``low`` to ``high`` relative to an event, such as -10 to -4."""
    return mark(calendar, event_days(events, low, high))


def overridden_dummies(calendar: DataFrame, events: DataFrame, overrides: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Windows with exceptions: ``overrides`` (event_id, window_start, window_end, weight).

    A window given there replaces the event's own; a weight given without a window is put on those days of the event's
    window that another event with such a weight has too (overlap). Events that share a replaced window act as one.
    """
    rows = events.join(F.broadcast(overrides.select("event_id", "window_start", "window_end", "weight")), "event_id", "left")
    start, end = F.coalesce("window_start", F.date_sub("date", before)), F.coalesce("window_end", F.date_add("date", after))
    shared = F.col("weight").isNotNull() & F.col("window_start").isNull()
    days = rows.select("event_id", "type", F.when(shared, F.col("weight")).alias("half"), F.explode(F.sequence(start, end)).alias("date"))
    twice = days.where("half is not null").groupBy("date").agg(F.count_distinct("event_id").alias("n"))
    days = days.join(twice, "date", "left").withColumn("w", F.when(F.col("half").isNotNull() & (F.col("n") > 1), F.col("half")).otherwise(1.0))
    return mark(calendar, days, "w")


def regime_segments(calendar: DataFrame, breaks: DataFrame) -> DataFrame:
    """Adds ``segment`` to (asset, date): how many of the asset's breaks lie on or before the day; 0 is the baseline.

    Segments are half-open: a break's own day belongs to the new segment.
    """
    w = Window.partitionBy("asset").orderBy("date")
    lead = breaks.select("asset", F.col("break_date").alias("date")).distinct()
    edges = lead.select("asset", F.col("date").alias("lo"), F.lead("date").over(w).alias("hi"), F.row_number().over(w).alias("segment"))
    last = calendar.groupBy("asset").agg(F.max("date").alias("end"))
    days = edges.join(last, "asset").where("lo <= end").select("asset", "segment", F.explode(F.sequence("lo", F.least(F.coalesce(F.date_sub("hi", 1), F.col("end")), F.col("end")))).alias("date"))
    return calendar.join(days, ["asset", "date"], "left").withColumn("segment", F.coalesce("segment", F.lit(0)))


def crisis_window(calendar: DataFrame, breaks: DataFrame, year: int) -> DataFrame:
    """(asset, lo, hi): from the last break of ``year`` to the first of a later year.

    Without a break in the year it starts at the break before its end, or the first day; without a later break it is all.
    """
    span = calendar.groupBy("asset").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    y = F.year("break_date")
    marks = breaks.groupBy("asset").agg(F.max(F.when(y == year, F.col("break_date"))).alias("start"), F.min(F.when(y > year, F.col("break_date"))).alias("end"))
    prior = breaks.join(marks, "asset").where("break_date < end").groupBy("asset").agg(F.max("break_date").alias("prior"))
    rows = span.join(marks, "asset", "left").join(prior, "asset", "left")
    lo = F.when(F.col("end").isNull(), F.col("first")).otherwise(F.coalesce("start", "prior", "first"))
    hi = F.coalesce("end", F.date_add("last", 1))
    return rows.select("asset", lo.alias("lo"), hi.alias("hi"))


def crisis_dummy(calendar: DataFrame, breaks: DataFrame, year: int) -> DataFrame:
    bounds = crisis_window(calendar, breaks, year)
    return calendar.join(bounds, "asset").withColumn("crisis", ((F.col("date") >= F.col("lo")) & (F.col("date") < F.col("hi"))).cast("double")).drop("lo", "hi")


def events_by_week(weeks: DataFrame, events: DataFrame) -> DataFrame:
    """(week_start, ev_all, ev_infra, ev_reg): events in each week, 0 in weeks without."""
    from tidemark.operators.timeseries import week_days

    hit = events.join(week_days(weeks), "date")
    kind = F.lower("type")
    by = hit.groupBy("week_start").agg(F.count(F.lit(1)).alias("ev_all"), F.count_if(kind.startswith("infra")).alias("ev_infra"), F.count_if(kind.startswith("reg")).alias("ev_reg"))
    out = weeks.select("week_start").distinct().join(by, "week_start", "left")
    return out.select("week_start", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("ev_all", "ev_infra", "ev_reg")))
