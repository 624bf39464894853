"""The other way of each option of SemanticsOptions, on small cases by hand."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.config import ModelParams, Portfolio, SemanticsOptions
from tideline.operators import backtest, montecarlo, performance, returns, rolling


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def long(spark, columns, value="ret"):
    rows = [(day(i), i, a, v) for a, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, f"day date, loc long, asset string, {value} double")


def test_defaults_are_the_public_ones():
    assert ModelParams().semantics == SemanticsOptions() and SemanticsOptions().pad_gaps
    assert [f for f, v in vars(SemanticsOptions()).items() if v] == ["pad_gaps"]


def test_gaps(spark):
    panel = long(spark, {"A": [10.0, 11.0, None, 22.0, 33.0], "B": [1.0, 1.0, 2.0, 2.0, 4.0]}, "close").drop("loc")
    got = {(r.day, r.asset): r.ret for r in returns.daily_returns(panel, pad=False, span=2).collect()}
    assert [got[day(i), "A"] for i in range(1, 5)] == [pytest.approx(0.1), None, None, pytest.approx(0.5)]
    assert [got[day(i), "B"] for i in range(1, 5)] == [0.0, 1.0, 0.0, 1.0]


def test_month_ends(spark):
    days = [dt.date(2024, 3, 28), dt.date(2024, 3, 29), dt.date(2024, 4, 30), dt.date(2024, 5, 2)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    assert sorted(r.day for r in rolling.rebalance_dates(df, trading=True).collect()) == days[1:]
    assert [r.day for r in rolling.rebalance_dates(df).collect()] == [days[2]]


def test_weights_and_peaks_and_thresholds(spark):
    r = long(spark, {"A": [0.1, None, 0.2], "B": [0.3, 0.5, None]})
    got = [x.ret for x in returns.portfolio_series(r, {"A": 0.25, "B": 0.75}, reweight=True).orderBy("day").collect()]
    assert got == pytest.approx([0.25, 0.5, 0.2])
    s = spark.createDataFrame([(day(0), "s", -0.5), (day(1), "s", 0.5)], "day date, series string, ret double")
    assert [x.drawdown for x in returns.drawdowns(s, from_start=True).orderBy("day").collect()] == [-0.5, -0.25]
    assert performance.max_drawdown(s).first().max_drawdown == 0.0 and performance.max_drawdown(s, True).first().max_drawdown == -0.5
    ends = spark.createDataFrame([(0, 9.0, 0.0), (1, 25.0, 0.0)], "sim_id long, terminal double, max_drawdown double")
    assert tuple(montecarlo.terminal_stats(ends, 10.0).select("prob_loss", "prob_double", "prob_5x").first()) == (0.5, 0.5, 0.0)


def test_many_assets_in_a_series(spark):
    names = [f"a{k}" for k in range(1000)]
    df = spark.range(1000).select(F.lit(day(0)).alias("day"), F.concat(F.lit("a"), F.col("id")).alias("asset"), (F.col("id") / 1000).alias("ret"))
    s = returns.portfolio_series(df, {a: 1 / 1000 for a in names})
    assert s.first().ret == pytest.approx(0.4995) and "CASE" not in s._jdf.queryExecution().optimizedPlan().toString()


def test_backtest_that_does_not_look_ahead(spark):
    """Weights from the days before the date, in force from the day after it; dates are last trading days."""
    rng = np.random.default_rng(3)
    x = rng.normal(0.002, 0.02, (75, 2))
    first = dt.date(2024, 1, 1)
    days = [d for d in (first + dt.timedelta(days=i) for i in range(110)) if d.weekday() < 5][:75]
    r = spark.createDataFrame([(d, i, a, float(x[i, k])) for i, d in enumerate(days) for k, a in enumerate("AB")], "day date, loc long, asset string, ret double")
    book = Portfolio(weights={"A": 0.5, "B": 0.5}, benchmark="A", bounds=(0.0, 1.0))
    p = replace(ModelParams(), walk_window=20, use_black_litterman=False, risk_free=-1.0, semantics=SemanticsOptions(trading_month_end=True, next_day=True))
    t = backtest.walk_forward(r, book, p, book.weights, shrink=False)
    ends = [i for i, d in enumerate(days) if i >= 20 and (i + 1 == len(days) or days[i + 1].month != d.month)]
    weights = {}
    for w in t.weights.collect():
        weights.setdefault(w.rebalance_date, {})[w.asset] = w.weight
    assert sorted(weights) == [days[i] for i in ends] and days[ends[1]] == dt.date(2024, 2, 29) and dt.date(2024, 3, 29) in weights
    for i in ends:  # the best of all two-asset mixes, on the 20 days before
        s = x[i - 20 : i]
        grid = np.linspace(0, 1, 20_001)
        mix = np.stack([grid, 1 - grid], axis=1)
        sharpe = (mix @ s.mean(axis=0) * 252 + 1) / np.sqrt(((mix @ np.cov(s.T)) * mix).sum(axis=1) * 252)
        assert weights[days[i]]["A"] == pytest.approx(grid[sharpe.argmax()], abs=2e-4)
    got = {v.day: v.ret for v in t.series.collect()}
    assert min(got) == days[ends[0] + 1] and len(got) == 75 - ends[0] - 1
    for i in range(ends[0] + 1, 75):
        w = weights[days[max(e for e in ends if e < i)]]
        assert got[days[i]] == pytest.approx(w["A"] * x[i, 0] + w["B"] * x[i, 1], abs=1e-12)
