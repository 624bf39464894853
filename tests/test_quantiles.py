"""Exact quantiles against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import quantiles as q

SHARES = [0.0, 0.01, 0.05, 0.25, 1 / 3, 0.5, 0.75, 0.95, 1.0]


def draws():
    rng = np.random.default_rng(1)
    yield "normal", rng.normal(size=7000)
    yield "heavy tails", rng.standard_cauchy(7000) ** 3
    yield "ties", rng.integers(0, 5, 7000).astype(float)
    yield "one value and a few", np.concatenate([np.full(6900, 3.0), rng.normal(size=100)])
    yield "greatest value mostly", np.concatenate([np.full(6000, 9.0), rng.random(1000)])
    yield "magnitudes", np.exp(rng.uniform(-600, 600, 7000)) * rng.choice([-1, 1], 7000)
    yield "infinite", np.concatenate([rng.normal(size=5000), np.full(1000, np.inf), np.full(1000, -np.inf)])
    yield "three", np.array([2.0, 1.0, 10.0])
    yield "one", np.array([4.0])


@pytest.mark.parametrize("name, x", list(draws()), ids=[n for n, _ in draws()])
def test_as_numpy(spark, name, x):
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    got = q.quantiles(df, "v", SHARES, buckets=8, listed=50)
    s = np.sort(x)
    for p, g in zip(SHARES, got, strict=True):
        at = p * (len(s) - 1)
        low, high = s[int(np.floor(at))], s[int(np.ceil(at))]
        assert g == (low if low == high else pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12, nan_ok=True))


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(None,), (1.0,), (3.0,), (float("nan"),)], "v double")
    assert q.quantiles(df, "v", [0.0, 0.25, 0.5])[:2] == [1.0, 2.0] and q.order_statistics(df, "v", [1]) == {1: 3.0}
    assert np.isnan(q.order_statistics(df, "v", [2])[2])
    assert q.quantiles(df.limit(0), "v", [0.5]) == [None] == q.quantiles(df.where("v is null"), "v", [0.5])
    with pytest.raises(IndexError):
        q.order_statistics(df, "v", [3])


def test_what_reaches_the_driver_is_bounded(spark, monkeypatch):
    """Half a million values: no job returns more rows than its buckets or its list."""
    seen, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: seen.append(len(out := collect(self))) or out)
    df = spark.range(500_000).select((F.hash("id") % 100_003 + F.rand(3)).alias("v"))
    got = q.quantiles(df, "v", [0.05, 0.5, 0.95])
    assert got == df.agg(F.percentile("v", [0.05, 0.5, 0.95]).alias("p")).first()["p"]
    assert max(seen) <= 6 * q.LISTED and len(seen) <= 8
