"""What the reports read several times is made once, and the number of their tasks follows the panel, not the settings."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tideline.operators import factors
from tideline.operators.returns import growth_frame
from tideline.plans import queries as plans

SF = "/root/testdata/sf0.001"


def series(spark, name, values, start=0):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(start + i), name, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "day date, series string, ret double")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_kept_panel_has_few_partitions(spark, monkeypatch):
    monkeypatch.setattr(plans, "_PRICES", {})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        kept = plans.prices(spark, SF)
        assert kept.rdd.getNumPartitions() <= 4
        assert kept is plans.prices(spark, SF) and kept.count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        kept.unpersist()


def test_growth_frame_is_one_scan(spark):
    a, b, late = series(spark, "x", [0.1, None, 0.2]), series(spark, "x", [0.5, -0.5], 2), series(spark, "x", [1.0, 1.0, 1.0], 3)
    out = growth_frame({"a": a, "b": b}, {"c": late})
    windows = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Window [")
    assert windows(out) == windows(growth_frame({"a": a}))
    day = lambda i: dt.date(2020, 1, 1 + i)
    got = [tuple(r) for r in out.orderBy("day").collect()]
    assert [r[0] for r in got] == [day(i) for i in range(4)]  # days that only a later series has are left out
    want = [(1.1, None, None), (None, None, None), (1.32, 1.5, None), (None, 0.75, 2.0)]
    for g, w in zip(got, want, strict=True):
        assert [x if x is None else round(x, 9) for x in g[1:]] == list(w)


def test_fit_takes_coefficients_at_hand(spark):
    days = 60
    f = spark.range(days).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"), *[F.sin((F.col("id") + 1) * (k + 2)).alias(n) for k, n in enumerate(("mkt_rf", "smb", "hml", "rmw", "cma"))], F.lit(0.0001).alias("rf"))
    s = f.select("day", F.lit("s").alias("series"), (F.col("mkt_rf") * 0.5 + F.cos(F.col("smb") * 9) * 0.1).alias("ret"))
    known = factors.coefficients(s, f)
    got, want = ({r["metric"]: r["value"] for r in t.collect()} for t in (factors.fit_statistics(s, f, known=known), factors.fit_statistics(s, f)))
    assert got == pytest.approx(want)
