"""Panel-shaped inputs made of star-schema tables (lineitem, orders, events)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def raw_prices(lineitem: DataFrame) -> DataFrame:
    """(asset, date, price, l_orderkey, l_linenumber): each line item is one quote of its flag-and-status asset."""
    return lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber")


def price_panel(lineitem: DataFrame) -> DataFrame:
    """(asset, date, price): the mean quote of the day, from exact sums of cents."""
    rows = lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("date"), _cents("l_extendedprice").alias("c"))
    return rows.groupBy("asset", "date").agg((F.sum("c").cast("double") / (F.count("c") * F.lit(100.0))).alias("price"))


def event_type(priority: Column) -> Column:
    return F.when(priority.isin("1-URGENT", "2-HIGH"), "Infrastructure").otherwise("Regulatory")


def _largest(orders: DataFrame, unit: str) -> DataFrame:
    rows = orders.select(F.to_date("o_orderdate").alias("date"), event_type(F.col("o_orderpriority")).alias("type"), "o_totalprice", "o_orderkey", "o_custkey")
    best = rows.groupBy(F.trunc("date", unit).alias("unit"), "type").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"), "date", "o_custkey")).alias("b"))
    return best.select((-F.col("b.k")).alias("event_id"), F.col("b.date").alias("date"), "type", F.concat(F.lit("order "), (-F.col("b.k")).cast("string")).alias("label"), F.col("b.o_totalprice").alias("magnitude"))


def event_calendar(orders: DataFrame) -> DataFrame:
    """(event_id, date, type, label, magnitude): of each quarter and type the largest order."""
    return _largest(orders, "quarter")


def candidate_pool(orders: DataFrame) -> DataFrame:
    """As ``event_calendar``, of each month and type."""
    return _largest(orders, "month")


def weekly_sentiment(orders: DataFrame) -> DataFrame:
    """(week_start, raw, reg_proportion, infra_proportion): mean order value and shares of the types by week."""
    rows = orders.select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_start"), _cents("o_totalprice").alias("c"), event_type(F.col("o_orderpriority")).alias("type"))
    n = F.count("c")
    return rows.groupBy("week_start").agg(
        (F.sum("c").cast("double") / (n * F.lit(100.0))).alias("raw"),
        (F.count_if(F.col("type") == "Regulatory") / n).alias("reg_proportion"),
        (F.count_if(F.col("type") == "Infrastructure") / n).alias("infra_proportion"),
    )
