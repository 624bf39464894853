"""Running aggregates in two levels against plain loops."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import returns
from tideline.operators.scan import growth_scan, scan


def day(n):
    return dt.date(1969, 11, 1) + dt.timedelta(days=n)  # on both sides of day 0


def near(a, b):
    return a == b or a is not None and b is not None and a == pytest.approx(b, rel=1e-12)


@pytest.mark.parametrize("span", [1, 7, 1024])
@pytest.mark.parametrize("before", [False, True])
def test_all_kinds(spark, span, before):
    rng = np.random.default_rng(1)
    rows = [(day(i), k, None if i < 9 and k == "b" or rng.random() < 0.3 else float(rng.normal(1, 0.4))) for i in range(150) for k in ("a", "b", None) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "day date, k string, v double").repartition(3)
    kinds = {"p": "product", "s": "sum", "n": "count", "m": "max", "l": "last"}
    got = {(r.k, r.day): r for r in scan(df, ["k"], "day", {n: (kind, F.col("v")) for n, kind in kinds.items()}, before, span).collect()}
    assert len(got) == len(rows)
    for key in ("a", "b", None):
        past = []
        for d, _, v in sorted((r for r in rows if r[1] == key), key=lambda r: r[0]):
            if not before:
                past.append(v)
            known = [x for x in past if x is not None]
            r = got[key, d]
            assert near(r.p, float(np.prod(known)) if known else None) and near(r.s, sum(known) if known else None)
            assert (r.n, r.m, r.l) == (len(known), max(known, default=None), known[-1] if known else None)
            if before:
                past.append(v)


def test_integer_order_and_no_keys(spark):
    df = spark.range(-50, 300).where("id % 7 <> 3").withColumnRenamed("id", "at")
    got = scan(df, [], "at", {"nth": ("count", F.lit(1))}, before=True, span=16).orderBy("at").collect()
    assert [r.nth for r in got] == list(range(len(got)))
    assert scan(df.limit(0), [], "at", {"nth": ("count", F.lit(1))}).collect() == []


@pytest.mark.parametrize("span", [1, 5, 1000])
def test_peaks(spark, span):
    """Also through losses of more than all, which turn signs, and zeros."""
    rng = np.random.default_rng(2)
    rets = [None, None, *(None if x < 0.1 else float(y) for x, y in zip(rng.random(60), rng.normal(0, 0.9, 60), strict=True)), -1.0, 0.5]
    df = spark.createDataFrame([(day(i), "s", v) for i, v in enumerate(rets)], "day date, series string, ret double").repartition(2)
    value, peak = None, None
    for r, v in zip(growth_scan(df, ["series"], "day", 1 + F.col("ret"), span).orderBy("day").collect(), rets, strict=True):
        if v is not None:
            value = (1 if value is None else value) * (1 + v)
            peak = value if peak is None else max(peak, value)
        assert near(r["product"], value) and near(r.peak, peak)


def test_returns_and_falls_across_spans(spark):
    rng = np.random.default_rng(3)
    close = {a: [None if i < late or rng.random() < 0.2 else float(v) for i, v in enumerate(100 + np.cumsum(rng.normal(0, 1, 60)))] for a, late in (("A", 0), ("B", 23), ("C", 59))}
    prices = spark.createDataFrame([(day(i), a, v) for a, vs in close.items() for i, v in enumerate(vs)], "day date, asset string, close double")
    panel = returns.densify(prices, list(close))
    one, many = ({(r.day, r.asset): (r.loc, r.ret) for r in returns.daily_returns(panel, span).collect()} for span in (1024, 4))
    assert one == many
    for a, vs in close.items():
        last = None
        for i, v in enumerate(vs):
            now = v if v is not None else last
            if (day(i), a) in one:
                assert near(one[day(i), a][1], now / last - 1 if last is not None else None)
            last = now
    series = spark.createDataFrame([(d, "s", x) for (d, a), (_, x) in one.items() if a == "A"], "day date, series string, ret double")
    for f in (returns.growth, returns.drawdowns):
        a, b = (f(series, span=span).orderBy("day").collect() for span in (1024, 4))
        assert all(near(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p[2:], q[2:], strict=True))


def test_many_tasks_for_one_series(spark):
    """A series of a century is dealt to tasks by its spans, and no window lacks a partition."""
    df = spark.range(0, 36_500).select(F.date_add(F.lit(dt.date(1925, 1, 1)), F.col("id").cast("int")).alias("day"), F.lit("s").alias("series"), (F.rand(1) * 0.01).alias("ret"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = returns.drawdowns(df)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*\], \[([^\]]*)\], \[", plan)
        assert windows and all(w.strip() for w in windows)
        rows = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(rows) == 4 and max(r["count"] for r in rows) < 0.6 * 36_500
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
