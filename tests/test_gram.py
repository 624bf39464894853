"""Co-moments by blocks and windows by merged states, against NumPy on the whole data."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import gram, moments, rolling


def day(n):
    return dt.date(1925, 1, 1) + dt.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def long(spark, x):
    """(day, loc, asset, ret) of a matrix; NaN as null."""
    n, p = x.shape
    wide = spark.createDataFrame([(day(i), i, [None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)], "day date, loc long, v array<double>")
    return wide.select("day", "loc", F.posexplode("v").alias("k", "ret")).select("day", "loc", F.format_string("a%04d", "k").alias("asset"), "ret")


def matrix(df, value, p):
    out = np.full((p, p), np.nan)
    for r in df.collect():
        out[int(r.asset_i[1:]), int(r.asset_j[1:])] = np.nan if r[value] is None else r[value]
    return out


def brute(x, power=1):
    """Mean products over common days of what deviates from the assets' own means."""
    u = x - np.nanmean(x, axis=0)
    k = ~np.isnan(u)
    u = np.where(k, u, 0) ** power
    return u.T @ u / (k.T.astype(float) @ k)


@pytest.mark.parametrize("block", [2, 3, 128])
def test_blocks_and_spans_merge_exactly(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(0.5, 0.01, (90, 7)) + np.linspace(0, 3, 90)[:, None]
    x[rng.random(x.shape) < 0.2] = np.nan
    r = long(spark, x).where("ret is not null")
    got = gram.co_moments(r, fourth=True, block=block, span=13)
    assert np.allclose(matrix(got, "s", 7), brute(x), rtol=1e-11) and np.allclose(matrix(got, "q", 7), brute(x, 2), rtol=1e-10)
    want = np.ma.cov(np.ma.masked_invalid(x), rowvar=False, allow_masked=True)
    both = [[np.cov(x[ok][:, [i, j]].T)[0, 1] for j in range(7) for ok in [~np.isnan(x[:, [i, j]]).any(axis=1)]] for i in range(7)]
    assert want.shape == (7, 7) and np.allclose(matrix(gram.co_moments(r, block=block, span=13).withColumn("cov", F.col("c") / (F.col("n") - 1)), "cov", 7), both, rtol=1e-11)


def test_a_thousand_assets_without_a_join(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0.001, 0.02, (40, 1000))
    names = [f"a{k:04d}" for k in range(1000)]
    cov = moments.sample_cov(long(spark, x), 1, names)
    assert "Join" not in plan(cov)
    one = cov.where("asset_i <= asset_j").agg(F.count(F.lit(1)), F.sum("cov")).first()
    want = np.cov(x.T)
    assert one[0] == 500_500 and one[1] == pytest.approx(np.triu(want).sum(), rel=1e-9)
    some = matrix(cov.where(F.col("asset_i").isin(names[::97]) & F.col("asset_j").isin(names[::97])), "cov", 1000)[::97, ::97]
    assert np.allclose(some, want[::97, ::97], rtol=1e-10)
    assert "SortMergeJoin" not in plan(moments.shrunk_cov(long(spark, x[:, :3]), assets=names[:3]))


def test_single_and_missing_days(spark):
    x = np.array([[0.1, np.nan, 0.2], [0.3, np.nan, np.nan], [np.nan, 0.5, np.nan]])
    got = {(r.asset_i, r.asset_j): r.cov for r in moments.sample_cov(long(spark, x), 1).collect()}
    assert got[("a0000", "a0000")] == pytest.approx(0.02) and got[("a0000", "a0002")] is None and ("a0000", "a0001") not in got
    assert moments.sample_cov(long(spark, x).limit(0), 1).collect() == []
    assert moments.sample_cov(long(spark, x), 1, ["a0000", "none"]).count() == 1


def test_windows_of_a_hundred_years(spark):
    """Sliding mean and variance of a drifting series, to 1e-10 of NumPy on each window."""
    n, w = 25_200, 1260
    rng = np.random.default_rng(3)
    x = 50 + np.cumsum(rng.normal(0, 0.01, n)) + rng.normal(0, 1e-3, n)
    r = spark.createDataFrame([(day(i), i, "a", float(v)) for i, v in enumerate(x)], "day date, loc long, asset string, ret double")
    got = rolling.rolling_statistics(r, w, 1).orderBy("day").toPandas()
    views = np.lib.stride_tricks.sliding_window_view(x, w)[:-1]
    assert len(got) == n - w
    assert np.abs(got["return"] / views.mean(axis=1) - 1).max() < 1e-10 and np.abs(got["vol"] / views.std(axis=1, ddof=1) - 1).max() < 1e-10
    p = plan(rolling.window_states(r, w))
    assert "stretch" in p and "windowspecdefinition(asset#" in p.replace("`", "") and "Join" not in p


def test_sample_moments_of_a_long_drifting_series(spark):
    n, w = 3000, 500
    rng = np.random.default_rng(4)
    x = 5 + np.cumsum(rng.normal(0, 0.05, (n, 3)), axis=0) + rng.normal(0, 1e-3, (n, 3))
    r = long(spark, x)
    locs = list(range(w, n, 61)) + [n - 1, w * 3 + 2, w + 1]
    dates = spark.createDataFrame([(day(k), k) for k in sorted(set(locs))], "rebalance_date date, loc long")
    for shrink in (False, True):
        mu, cov = rolling.window_moments(r, dates, w, 1, shrink)
        got = {}
        for c in cov.collect():
            got.setdefault((c.rebalance_date - day(0)).days, np.zeros((3, 3)))[int(c.asset_i[1:]), int(c.asset_j[1:])] = c.cov
        assert got.keys() == set(locs)
        for k in locs:
            s = x[k - w : k + 1]
            want = np.cov(s.T)
            if shrink:
                u = s - s.mean(axis=0)
                c = u.T @ u / len(u)
                m = np.trace(c) / 3
                d2 = ((c - m * np.eye(3)) ** 2).sum() / 3
                b2 = min(d2, sum(((np.outer(v, v) - c) ** 2).sum() for v in u) / 3 / len(u) ** 2)
                want = (1 - b2 / d2) * c + b2 / d2 * m * np.eye(3)
            assert np.allclose(got[k], want, rtol=1e-10)
