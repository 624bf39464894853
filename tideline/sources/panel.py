"""Price sources: long tables (day, asset, close), filtered at the source."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of an asset that one quoted price averages.
SMOOTHING = 63


def read_prices(spark: SparkSession, path: str, assets: list[str], start: str | None = None, end: str | None = None, fmt: str = "parquet", day: str = "day", asset: str = "asset", close: str = "close", **options) -> DataFrame:
    """(day, asset, close) of stored quotes; assets and dates are pushed to the scan, end excluded.

    day, asset and close name the table's columns, day being a date or a timestamp; a
    ValueError names a missing close.
    """
    df = spark.read.format(fmt).options(**options).load(path)
    if close not in df.columns:
        raise ValueError(f"the price table has no {close} column")
    at = lambda d: F.lit(d).cast(df.schema[day].dataType)
    df = df.where(F.col(asset).isin(assets))
    if start:
        df = df.where(F.col(day) >= at(start))
    if end:
        df = df.where(F.col(day) < at(end))
    return df.select(F.to_date(day).alias("day"), F.col(asset).alias("asset"), F.col(close).cast("double").alias("close"))


def wide_to_long(prices: DataFrame, day: str = "day") -> DataFrame:
    """A column for each asset to (day, asset, close)."""
    names = [c for c in prices.columns if c != day]
    return prices.unpivot([day], names, "asset", "close").withColumnRenamed(day, "day")


def long_to_wide(prices: DataFrame, assets: list[str], value: str = "close") -> DataFrame:
    return prices.groupBy("day").pivot("asset", assets).agg(F.first(value))


def part_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, asset, close) made of line items: each part type's price per unit over its last 63 trading days, MKT over all.

    Line items get their type from part, which Spark broadcasts where it is small and
    else joins by a shuffle of both; then they are summed by weekday and type in whole
    cents, partly before that sum's shuffle. Everything after works on that small table
    and is exact up to one division.
    """
    return smoothed_prices(part_sums(spark, sf_dir))


def part_sums(spark: SparkSession, sf_dir: str, after: dt.date | None = None, upto: dt.date | None = None) -> DataFrame:
    """(day, asset, v, q): cents and hundredths of units of the line items of each weekday and part type, and of all as MKT.

    Days `after` one and `upto` another only, where given: the scan gets those bounds.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.weekday("l_shipdate") < 5)
    at = lambda d: F.lit(d).cast(lines.schema["l_shipdate"].dataType)
    if after is not None:
        lines = lines.where(F.col("l_shipdate") >= at(after + dt.timedelta(days=1)))
    if upto is not None:
        lines = lines.where(F.col("l_shipdate") < at(upto + dt.timedelta(days=1)))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_type").alias("asset"))
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    lines = lines.select(F.to_date("l_shipdate").alias("day"), "l_partkey", "l_extendedprice", "l_quantity")
    daily = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("day", "asset").agg(cents("l_extendedprice").alias("v"), cents("l_quantity").alias("q"))
    return daily.select("day", F.explode(F.array("asset", F.lit("MKT"))).alias("asset"), "v", "q").groupBy("day", "asset").agg(F.sum("v").alias("v"), F.sum("q").alias("q"))


def smoothed_prices(sums: DataFrame) -> DataFrame:
    """(day, asset, close): price per unit over an asset's last 63 rows of part_sums(), from its 63rd on."""
    by_day = Window.partitionBy("asset").orderBy("day")
    last = by_day.rowsBetween(1 - SMOOTHING, 0)
    both = sums.select("day", "asset", (F.sum("v").over(last).cast("double") / F.sum("q").over(last).cast("double")).alias("close"), F.row_number().over(by_day).alias("n"))
    return both.where(F.col("n") >= SMOOTHING).select("day", "asset", "close")


def literal_table(spark: SparkSession, values: dict[str, float], value: str = "weight") -> DataFrame:
    """(asset, asset_ord, value) of a mapping, in its order."""
    rows = [(a, i, float(v)) for i, (a, v) in enumerate(values.items())]
    return spark.createDataFrame(rows, f"asset string, asset_ord int, {value} double")
