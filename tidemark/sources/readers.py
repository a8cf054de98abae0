"""Readers of the study's inputs. Every schema is declared; a missing column fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = T.StructType([T.StructField("snapped_at", T.StringType()), T.StructField("price", T.DoubleType())])
EVENTS = T.StructType([T.StructField("event_id", T.IntegerType()), T.StructField("date", T.DateType()), *(T.StructField(c, T.StringType()) for c in ("label", "title", "type"))])
SENTIMENT = T.StructType(
    [T.StructField("week_start", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("S_gdelt_raw", "S_gdelt_normalized"))]
    + [T.StructField(c, T.IntegerType()) for c in ("total_articles", "total_mentions", "reg_article_count", "infra_article_count")]
    + [T.StructField(c, T.DoubleType()) for c in ("reg_proportion", "infra_proportion", "S_reg_decomposed", "S_infra_decomposed")]
)
RECLASSIFIED = "events array<struct<event_id:int,date:date,title:string,type:string,type_detailed:string,include_in_reanalysis:boolean,meets_impact_threshold:boolean,has_sufficient_estimation_data:boolean>>"
OHLCV = "timestamp timestamp, open double, high double, low double, close double, volume double, quote_volume double, returns double, symbol string"


class MissingColumns(ValueError):
    """A required column is not in the file."""


def read_csv(spark: SparkSession, path: str, required: list[str], **options: str) -> DataFrame:
    """A CSV with a header as strings; fails if a required column is missing. Quoted commas and any text are kept."""
    found = spark.read.options(header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8", **options).csv(path)
    missing = [c for c in required if c not in found.columns]
    if missing:
        raise MissingColumns(f"{path}: {', '.join(missing)}")
    return found


def typed(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema from columns of strings; empty text is null."""

    def cast(f: T.StructField):
        text = F.nullif(F.trim(F.col(f.name)), F.lit(""))
        if isinstance(f.dataType, T.StringType):
            return F.col(f.name)
        if isinstance(f.dataType, T.BooleanType):
            return F.lower(text).cast("boolean").alias(f.name)
        return text.cast(f.dataType).alias(f.name)

    return rows.select(*(cast(f) for f in schema.fields if f.name in rows.columns))


def utc_date(text):
    """The date of a UTC time in text such as ``2019-01-31 00:00:00 UTC``."""
    return F.to_date(F.substring(F.regexp_replace(F.trim(text), " UTC$", ""), 1, 10))


def read_prices(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(asset, date, snapped_at, price) of one CSV for each asset; only ``snapped_at`` and ``price`` are read."""
    parts = None
    for asset, path in paths.items():
        rows = typed(read_csv(spark, path, ["snapped_at", "price"]), PRICES)
        rows = rows.select(F.lit(asset).alias("asset"), utc_date(F.col("snapped_at")).alias("date"), "snapped_at", "price")
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        raise ValueError("no price files")
    return parts


def first_of_day(prices: DataFrame, order: list[str], keys: tuple[str, ...] = ("asset", "date")) -> DataFrame:
    """One row for each asset and day: the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return prices.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return typed(read_csv(spark, path, ["event_id", "date", "type"]), EVENTS)


def read_sentiment(spark: SparkSession, path: str) -> DataFrame:
    rows = typed(read_csv(spark, path, ["week_start", "S_gdelt_raw", "reg_proportion", "infra_proportion"]), SENTIMENT)
    return rows.withColumn("week_start", utc_date(F.col("week_start")))


def read_reclassified(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON file that pass three optional flags (defaults true, false, true), by detailed type or else type."""
    rows = spark.read.schema(RECLASSIFIED).option("multiLine", True).json(path).select(F.explode("events").alias("e")).select("e.*")
    keep = F.coalesce("include_in_reanalysis", F.lit(True)) & F.coalesce("meets_impact_threshold", F.lit(False)) & F.coalesce("has_sufficient_estimation_data", F.lit(True))
    return rows.where(keep).select("event_id", "date", "title", F.coalesce("type_detailed", "type").alias("type"))


def read_latest_cache(spark: SparkSession, pattern: str) -> DataFrame:
    """(asset, date, ret) of the file that comes last in name order for each symbol."""
    rows = spark.read.schema(OHLCV).parquet(pattern).withColumn("file", F.input_file_name())
    latest = rows.groupBy("symbol").agg(F.max("file").alias("file"))
    return rows.join(F.broadcast(latest), ["symbol", "file"]).select(F.col("symbol").alias("asset"), F.to_date("timestamp").alias("date"), F.col("returns").alias("ret"))


def read_sections(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a file whose sections begin with a line ``# name`` and a header; ``schemas`` by name of section.

    Lines before the first section, empty lines and sections without a schema are passed by.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).where("trim(line) <> ''")
    order = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one file
    name = F.when(F.col("line").startswith("#"), F.trim(F.regexp_replace("line", "^#+", "")))
    told = lines.withColumn("section", F.last(name, ignorenulls=True).over(order)).withColumn("nth", F.row_number().over(Window.partitionBy("section").orderBy("at")))
    body = told.where("nth > 2")  # after the name and the header
    return {k: body.where(F.col("section") == k).select(F.from_csv("line", schema).alias("r")).select("r.*") for k, schema in schemas.items()}
