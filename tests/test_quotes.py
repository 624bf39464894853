"""The data source of stored quotes against a plain scan."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from tideline.sources.panel import read_prices
from tideline.sources.quotes import NAME, QuoteReader, QuoteSource, Span, read_quotes


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("quotes") / "q")
    first = dt.datetime(2019, 11, 3, 5)
    rows = [(first + dt.timedelta(hours=31 * i), a, None if i % 11 == 0 else float(i), "x") for i in range(400) for a in ("A", "B", None)]
    rows.append((None, "A", 1.0, "x"))
    spark.createDataFrame(rows, "ts timestamp, name string, price double, other string").write.parquet(at)
    return at


NAMES = {"day": "ts", "asset": "name", "close": "price"}


def rows(df):
    return sorted((tuple(r) for r in df.select("day", "asset", "close").collect()), key=repr)


@pytest.mark.parametrize("start, end", itertools.product([None, "2020-02-29", "2030-01-01"], [None, "2020-03-01", "2021-02-01"]))
def test_as_a_plain_scan(spark, path, start, end):
    want = rows(read_prices(spark, path, ["A", "none"], start, end, **NAMES))
    assert rows(read_quotes(spark, path, ["A", "none"], start, end, **NAMES)) == want


def test_filters_reach_the_source_and_plan_its_partitions(spark, path):
    df = read_quotes(spark, path, ["A", "B"], "2019-11-20", "2021-01-05", **NAMES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "asset" in plan and "Filter" not in plan.split("BatchScan")[0]  # nothing is left to filter above
    assert df.rdd.getNumPartitions() == 2 * 3
    reader = QuoteReader({"path": path, **NAMES})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

    odd = StringContains(("asset",), "A")
    left = list(reader.pushFilters([In(("asset",), ("A", "B", None)), EqualTo(("asset",), "B"), GreaterThan(("day",), dt.date(2019, 12, 30)), LessThanOrEqual(("day",), dt.date(2020, 1, 2)), odd]))
    assert left == [odd]
    assert reader.partitions() == [Span("B", dt.date(2019, 12, 31), dt.date(2020, 1, 1)), Span("B", dt.date(2020, 1, 1), dt.date(2020, 1, 3))]


def test_other_filters_stay_above(spark, path):
    spark.dataSource.register(QuoteSource)
    every = spark.read.format(NAME).options(**NAMES).load(path)
    assert every.count() == 1201
    assert every.where(F.col("asset").contains("B") & (F.col("close") > 390)).count() == 8  # one of nine is null
    assert every.where("asset is null").count() == 400 and every.where("day is null").count() == 1
    assert [every.where(f"{c} is not null").count() for c in ("day", "asset", "close")] == [1200, 801, 1090]
    assert every.where("day = date'2020-01-01' and asset = 'A'").count() == every.where("cast(day as string) = '2020-01-01' and asset = 'A'").count() > 0
    assert every.where("day < date'2019-01-01' and day > date'2020-01-01' and asset = 'A'").count() == 0


def test_zones(spark, path):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert rows(read_quotes(spark, path, ["B"], "2020-01-01", "2020-07-01", **NAMES)) == rows(read_prices(spark, path, ["B"], "2020-01-01", "2020-07-01", **NAMES))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_dates_and_missing_columns(spark, path, tmp_path):
    spark.read.parquet(path).select(F.to_date("ts").alias("day"), F.col("name").alias("asset"), F.col("price").cast("float").alias("close")).write.parquet(str(tmp_path / "d"))
    assert rows(read_quotes(spark, str(tmp_path / "d"), ["A"], "2020-01-01", "2020-02-01")) == rows(read_prices(spark, str(tmp_path / "d"), ["A"], "2020-01-01", "2020-02-01"))
    with pytest.raises(Exception, match="no close column"):
        read_quotes(spark, path, ["A"], day="ts", asset="name")
