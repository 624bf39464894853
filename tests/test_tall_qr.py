"""R factors merged from tasks, and regressions from them, against NumPy on the whole matrix."""

import datetime as dt

import numpy as np
import pytest

from tideline.operators import factors
from tideline.operators.tall_qr import tall_qr


def test_factor_is_that_of_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) @ np.diag([1, 1e-4, 1e4, 1])
    key = rng.choice(["a", "b", "one row"], 500, p=[0.7, 0.3, 0]).tolist()
    key[7] = "one row"
    df = spark.createDataFrame([(k, *map(float, v)) for k, v in zip(key, x, strict=True)], "k string, c0 double, c1 double, c2 double, c3 double").repartition(7)
    got = {r.k: r for r in tall_qr(df, "k", ["c0", "c1", "c2", "c3"]).collect()}
    assert {k: r.n for k, r in got.items()} == {k: key.count(k) for k in set(key)}
    for k, r in got.items():
        rows = x[[i for i, v in enumerate(key) if v == k]]
        f = np.array(r.r).reshape(-1, 4)
        assert len(f) == min(4, len(rows)) and np.allclose(f.T @ f, rows.T @ rows, rtol=1e-10) and np.allclose(np.tril(f, -1), 0)
    assert tall_qr(df.limit(0), "k", ["c0", "c1"]).collect() == []


def days(spark, columns, rows):
    first = dt.date(2000, 1, 1)
    return spark.createDataFrame([(first + dt.timedelta(days=i), *map(float, r)) for i, r in enumerate(rows)], "day date, " + ", ".join(f"{c} double" for c in columns))


@pytest.mark.parametrize("gap", [1e-2, 1e-6])
def test_near_collinear_factors(spark, gap):
    """Two factors a millionth apart: sums of products would lose all digits of their difference."""
    rng = np.random.default_rng(2)
    n = 800
    f = rng.normal(0, 0.01, (n, 3))
    f[:, 1] = f[:, 0] + gap * f[:, 1]
    y = f @ [0.5, 0.25, -1] + rng.normal(0, 1e-9, n)
    from pyspark.sql import functions as F

    series = days(spark, ["ret"], y[:, None]).select("day", F.lit("s").alias("series"), "ret").repartition(5)
    table = days(spark, ["mkt_rf", "smb", "hml", "rf"], np.column_stack([f, np.zeros(n)]))
    got = {r.term: r for r in factors.coefficients(series, table, "ff3").collect()}
    x = np.column_stack([np.ones(n), f])
    want, rest, _, size = np.linalg.lstsq(x, y, rcond=None)
    se = np.sqrt(rest[0] / (n - 4) * np.diag(np.linalg.pinv(x) @ np.linalg.pinv(x).T))
    for k, t in enumerate(["const", "mkt_rf", "smb", "hml"]):
        assert got[t].coef == pytest.approx(want[k], rel=1e-7, abs=1e-12) and got[t].std_err == pytest.approx(se[k], rel=1e-5)
    fit = {r.metric: r.value for r in factors.fit_statistics(series, table, "ff3").collect()}
    assert fit["condition_number"] == pytest.approx(size[0] / size[-1], rel=1e-6)


def test_factors_that_repeat_each_other_are_an_error(spark):
    from pyspark.sql import functions as F

    f = np.random.default_rng(3).normal(size=(50, 1))
    series = days(spark, ["ret"], f).select("day", F.lit("s").alias("series"), "ret")
    table = days(spark, ["mkt_rf", "smb", "hml", "rf"], np.column_stack([f, f, f * 2, f * 0]))
    with pytest.raises(Exception, match="combinations of others"):
        factors.coefficients(series, table, "ff3").collect()
    with pytest.raises(Exception, match="too few days"):
        factors.coefficients(series.limit(3), table, "ff3").collect()
