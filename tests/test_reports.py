"""Report tables that are there as a whole or not at all."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tideline.sources import reports


def table(spark, n=50):
    return spark.range(n).select("id", F.lit(dt.date(2024, 1, 1)).alias("day"), (F.col("id") / 7).alias("v"), F.when(F.col("id") % 3 == 0, "é").alias("s"), F.array("id").alias("many")).repartition(4)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip_and_overwrite(spark, tmp_path):
    root = str(tmp_path / "r")
    reports.write_tables({"a": table(spark), "b c": table(spark, 3), "none": table(spark, 0)}, root)
    got = reports.read_table(spark, root, "a")
    assert got.dtypes == table(spark).dtypes and rows(got) == rows(table(spark))
    assert rows(reports.read_table(spark, root, "b c")) == rows(table(spark, 3)) and reports.read_table(spark, root, "none").count() == 0
    reports.write_tables({"a": table(spark, 5)}, root)
    assert reports.read_table(spark, root, "a").count() == 5
    table(spark, 2).write.format(reports.NAME).mode("append").save(f"{root}/a")
    assert reports.read_table(spark, root, "a").count() == 7
    assert rows(reports.read_table(spark, "file://" + root, "a").select("id")) == sorted([(i,) for i in [*range(5), 0, 1]])


def test_a_write_that_fails_leaves_what_was_there(spark, tmp_path):
    root = str(tmp_path / "r")
    with pytest.raises(Exception, match="no report table"):
        reports.read_table(spark, root, "a").collect()
    reports.write_tables({"a": table(spark, 6)}, root)
    before = set(os.listdir(f"{root}/a"))
    bad = table(spark, 5000).withColumn("id", F.when(F.col("id") == 4999, F.raise_error(F.lit("no luck"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="no luck"):
        reports.write_tables({"a": bad}, root)
    assert reports.read_table(spark, root, "a").count() == 6
    # parts that no list names are not read
    (tmp_path / "r" / "a" / "part-left.parquet").write_bytes(b"?")
    assert reports.read_table(spark, root, "a").count() == 6 and before <= set(os.listdir(f"{root}/a"))
