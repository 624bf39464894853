"""Hand-computed cases of each quirk."""

import contextlib
import datetime as dt
import io
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.config import LIVE, ModelParams, Portfolio
from tideline.functions.small import printed
from tideline.kernels import qp, special
from tideline.operators import backtest, bayes, costs, factors, montecarlo, moments, optimize, performance, risk, rolling
from tideline.operators.returns import daily_returns, densify, drawdowns, growth, growth_frame, on_days_of, portfolio_series, require
from tideline.plans import workflows
from tideline.sources.factors import FF3, load_factors
from tideline.sources.panel import literal_table, long_to_wide, read_prices, wide_to_long

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def series(spark, values, name="p"):
    return spark.createDataFrame([(day(i), name, v) for i, v in enumerate(values)], "day date, series string, ret double")


def panel(spark, columns):
    rows = [(day(i), a, v) for a, vs in columns.items() for i, v in enumerate(vs) if v is not None]
    return densify(spark.createDataFrame(rows, "day date, asset string, close double"), list(columns))


def rets(spark, columns):
    rows = [(day(i), i, a, v) for a, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "day date, loc long, asset string, ret double")


def test_gaps_are_padded_and_late_assets_start_later(spark):
    r = daily_returns(panel(spark, {"A": [100.0, None, 110.0, 121.0], "B": [None, 10.0, None, 20.0]})).collect()
    got = {(x.loc, x.asset): x.ret for x in r}
    assert got == {(0, "A"): 0.0, (1, "A"): pytest.approx(0.1), (2, "A"): pytest.approx(0.1), (0, "B"): None, (1, "B"): 0.0, (2, "B"): 1.0}


def test_missing_return_counts_nothing(spark):
    r = rets(spark, {"A": [0.1, None], "B": [None, None]})
    assert [x.ret for x in portfolio_series(r, {"A": 0.5, "B": 0.5}).orderBy("day").collect()] == [0.05, 0.0]


def test_first_day_loss_is_no_drawdown(spark):
    assert performance.max_drawdown(series(spark, [-0.1, 0.05])).first().max_drawdown == 0
    assert performance.max_drawdown(series(spark, [0.1, -0.5, 0.2])).first().max_drawdown == pytest.approx(-0.5)


def test_annual_return_counts_missing_days(spark):
    got = performance.annual_stats(series(spark, [0.10, None, 0.20])).first()
    assert got.annual_return == pytest.approx(1.32 ** (252 / 3) - 1)
    assert [x.value for x in growth(series(spark, [0.10, None, 0.20])).orderBy("day").collect()] == [pytest.approx(1.1), None, pytest.approx(1.32)]


def test_equal_to_benchmark(spark):
    s = series(spark, [0.01, -0.02, 0.03])
    r = performance.against(s, s).first()
    assert (r.beta, r.alpha, r.tracking_error, r.information_ratio) == (pytest.approx(1), pytest.approx(0), 0, None)
    flat = performance.against(s, series(spark, [0.01, 0.01, 0.01])).first()
    assert flat.beta is None and flat.correlation is None


def test_rebalance_dates_are_calendar_month_ends(spark):
    days = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 28), dt.date(2024, 2, 29), dt.date(2024, 3, 28), dt.date(2024, 3, 29), dt.date(2024, 4, 1)]
    got = rolling.rebalance_dates(spark.createDataFrame([(d,) for d in days], "day date"))
    assert sorted(r.day for r in got.collect()) == [dt.date(2024, 1, 31), dt.date(2024, 2, 29)]
    with pytest.raises(ValueError):
        rolling.rebalance_dates(got, "W")


def test_windows_around_a_day(spark):
    r = rets(spark, {"A": [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]})
    got = rolling.rolling_statistics(r, 3, 1).orderBy("day").collect()
    assert [x["return"] for x in got] == [pytest.approx(7 / 3), pytest.approx(14 / 3), pytest.approx(28 / 3)]  # today is left out
    dates = spark.createDataFrame([(day(4), 4)], "rebalance_date date, loc long")
    assert sorted(x.ret for x in rolling.window_samples(r, dates, 3).collect()) == [2, 4, 8, 16]  # today and three before


def day_pairs(rows, *group):
    """Returns of each ordered pair of assets on the same day, by a join: the plain form of co_moments()."""
    on = ["day", *group]
    a = rows.select(*on, F.col("asset").alias("asset_i"), F.col("ret").alias("x"))
    return a.join(rows.select(*on, F.col("asset").alias("asset_j"), F.col("ret").alias("y")), on)


def test_running_sums_are_those_of_the_samples(spark):
    """Against every sample laid out: late assets, nulls, positions that some assets lack, a first sample from the start."""
    rng = np.random.default_rng(4)
    rows = [(day(i), i, a, None if rng.random() < 0.1 or i < late else float(rng.normal(0.001, 0.02))) for i in range(60) for a, late in (("A", 0), ("B", 7), ("C", 30)) if rng.random() > 0.05]
    r = spark.createDataFrame(rows, "day date, loc long, asset string, ret double")
    dates = spark.createDataFrame([(day(n), n) for n in (20, 33, 34, 59)], "rebalance_date date, loc long")
    sample = rolling.window_samples(r, dates, 20)
    want_mu = {(x.rebalance_date, x.asset): x.mu for x in sample.groupBy("rebalance_date", "asset").agg(F.avg("ret").alias("mu")).collect()}
    plain = day_pairs(sample.where("ret is not null"), "rebalance_date").groupBy("rebalance_date", "asset_i", "asset_j").agg(F.covar_samp("x", "y").alias("cov"))
    near = lambda df: {(x.rebalance_date, x.asset_i, x.asset_j): x.cov for x in df.collect()}
    for shrink, want in ((False, plain), (True, moments.shrunk_cov(sample, 1, ("rebalance_date",)))):
        mu, cov = rolling.window_moments(r, dates, 20, 1, shrink)
        got = {(x.rebalance_date, x.asset): x.mu for x in mu.collect()}
        assert got.keys() == want_mu.keys() and all(got[k] == (None if v is None else pytest.approx(v, abs=1e-12)) for k, v in want_mu.items())
        got, want = near(cov), near(want)
        assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v, abs=1e-13)) for k, v in want.items())


def test_series_side_by_side(spark):
    a, b, none = series(spark, [0.1, 0.1], "a"), series(spark, [None, 1.0, 1.0], "b"), series(spark, [0.5]).limit(0)
    out = growth_frame({"a": a, "b b": b}, {"later": none})
    assert out.columns == ["day", "a", "b b", "later"]
    assert [tuple(r)[1:] for r in out.orderBy("day").collect()] == [(1.1, None, None), (pytest.approx(1.21), 2.0, None), (None, 4.0, None)]
    assert on_days_of(b, a).count() == 2 and on_days_of(b, none).count() == 0
    with pytest.raises(KeyError):
        on_days_of(a, b)


def test_printed_tables_round_half_to_even(spark):
    df = spark.createDataFrame([("x", 0.00125, 2), ("y", 0.125, 3), ("z", None, 4)], "a string, v double, n int")
    assert [tuple(r) for r in printed(df, 2).collect()] == [("x", 0.0, 2), ("y", 0.12, 3), ("z", None, 4)]
    assert printed(df).first().v == 0.0012 and printed(df.withColumn("v", F.lit(0.00375)), 4).first().v == 0.0038


def test_rolling_vol_needs_every_asset(spark):
    got = rolling.rolling_statistics(rets(spark, {"A": [1.0, 2.0, 3.0, 4.0], "B": [None, None, 1.0, 1.0]}), 2, 1).orderBy("day").collect()
    assert [x.vol is None for x in got] == [True, True]


def test_three_null_policies(spark):
    r = rets(spark, {"A": [0.1, 0.3, None], "B": [0.2, None, 0.4]})
    assert {x.asset: x.mu for x in moments.annual_mean(r, 1).collect()} == {"A": pytest.approx(0.2), "B": pytest.approx(0.3)}
    s = {(x.asset_i, x.asset_j): x.cov for x in moments.sample_cov(r, 1).collect()}
    assert s[("A", "A")] == pytest.approx(0.02) and s.get(("A", "B")) is None
    p = {(x.asset_i, x.asset_j): x.s for x in moments.shrinkage_parts(r).collect()}
    a, b = np.array([0.1, 0.3, 0]), np.array([0.2, 0, 0.4])
    assert p[("A", "B")] == pytest.approx(np.cov(a, b, ddof=0)[0, 1])


def test_shrinkage_against_numpy(spark):
    x = np.random.default_rng(0).normal(size=(60, 4)) * 0.01
    got = {(r.asset_i, r.asset_j): r.cov for r in moments.shrunk_cov(rets(spark, {f"a{i}": x[:, i].tolist() for i in range(4)}), 252).collect()}
    c = x - x.mean(axis=0)
    n, p = c.shape
    s = c.T @ c / n
    m = np.trace(s) / p
    d2 = ((s - m * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, sum(((np.outer(v, v) - s) ** 2).sum() for v in c) / p / n**2)
    want = ((1 - b2 / d2) * s + b2 / d2 * m * np.eye(p)) * 252
    assert np.allclose([[got[(f"a{i}", f"a{j}")] for j in range(4)] for i in range(4)], want)
    with pytest.raises(ValueError):
        moments.covariance(rets(spark, {"A": [0.1]}), use_shrinkage=True, method="other")


def two_assets(spark):
    return spark.createDataFrame([("A", "A", 0.04), ("A", "B", 0.01), ("B", "A", 0.01), ("B", "B", 0.09)], "asset_i string, asset_j string, cov double")


def test_posterior_with_one_view(spark):
    cov, w = two_assets(spark), {"A": 0.5, "B": 0.5}
    for confidence, tau in ((0.1, 0.05), (0.9, 0.5)):
        got = {r.asset: r for r in bayes.posterior(cov, ["A", "B"], w, 2.5, tau, {"B": (0.2, confidence)}).collect()}
        assert (got["A"].pi, got["B"].pi) == (pytest.approx(0.0625), pytest.approx(0.125))
        assert got["A"].bl_mu == pytest.approx(0.0625 + 0.01 / 0.18 * 0.075)
        assert got["B"].bl_mu == pytest.approx(0.125 + 0.0375)
    same = bayes.posterior(cov, ["A", "B"], w).collect()
    assert all(r.bl_mu == r.pi for r in same)
    with pytest.raises(ValueError):
        bayes.posterior(cov, ["A", "B"], w, views={"C": (0.1, 1)})
    with pytest.warns(UserWarning):
        bayes.note_relative_views([("A", "B", 0.1, 0.5)])


def test_turnover_is_two_sided_and_changes_are_strict(spark):
    both = costs.two_weights(literal_table(spark, {"A": 0.6, "B": 0.4}), literal_table(spark, {"A": 0.4, "B": 0.6}))
    assert costs.turnover(both).first().turnover == pytest.approx(0.4)
    assert costs.tax_drag(both).first().tax == pytest.approx(0.2 * 0.2 * 0.25)
    one = costs.net_return(both, 0.1, gain=None).first()
    assert (one.tax_drag, one.net_expected_return) == (0, pytest.approx(0.1 - 0.4 * 0.0015))
    both = costs.two_weights(literal_table(spark, {"A": 0.25, "B": 0.5, "C": 0.25}), literal_table(spark, {"A": 0.375, "B": 0.375, "C": 0.25}))
    assert [r.action for r in costs.weight_changes(both, 0.125).collect()] == ["Hold"] * 3
    assert [(r.asset, r.action) for r in costs.trade_sheet(both).collect()] == [("A", "Buy"), ("B", "Sell"), ("C", "Hold")]


def test_penalty_and_layer(spark):
    mu = spark.createDataFrame([("A", 0.1), ("B", 0.2)], "asset string, mu double")
    w = literal_table(spark, {"A": 1.0, "C": 0.5})
    assert {r.asset: r.mu for r in costs.implementation_layer(mu, w, True, 0.5).collect()} == {"A": 0.1, "B": None, "C": None}
    assert costs.implementation_layer(mu, w, False).count() == 2


def test_weights(spark):
    with pytest.raises(KeyError):
        optimize.weights_table(spark, {"A": 1.0}, ["A", "B"])
    assert optimize.weights_dict(optimize.weights_table(spark, {"A": 1.0}, ["A", "B"], strict=False)) == {"A": 1.0, "B": 0.0}
    df = spark.createDataFrame([("p", "A", 2.0), ("p", "B", 6.0)], "portfolio string, asset string, weight double")
    assert sorted(r.weight for r in optimize.normalize_weights(df).collect()) == [0.25, 0.75]
    with pytest.raises(Exception, match="sum to 0"):
        optimize.normalize_weights(df.withColumn("weight", F.lit(0.0))).collect()
    assert [r.line for r in costs.weight_lines(literal_table(spark, {"QQQ": 0.3456})).collect()] == ["  QQQ: 34.56%"]
    assert LIVE.universe[-1] == "SPY" and sum(LIVE.weights.values()) == pytest.approx(1)


def test_stats_and_risk(spark):
    w, cov = literal_table(spark, {"A": 0.5, "B": 0.5}), two_assets(spark)
    mu = spark.createDataFrame([("A", 0.1), ("B", 0.2)], "asset string, mu double")
    one = risk.portfolio_stats(w, mu, cov).first()
    assert (one.expected_return, one.volatility) == (pytest.approx(0.15), pytest.approx(np.sqrt(0.0375)))
    assert risk.sharpe(w, mu, cov.withColumn("cov", F.lit(0.0))).first().sharpe is None
    assert risk.expected_return(w, mu).first()[0] == pytest.approx(0.15) and risk.volatility(w, cov).first()[0] == pytest.approx(np.sqrt(0.0375))
    rows = risk.risk_contribution(w, cov).collect()
    assert [r.asset for r in rows] == ["B", "A"] and sum(r.percent for r in rows) == pytest.approx(1)


def random_moments(rng, n):
    a = rng.normal(size=(n, 3 * n))
    return rng.normal(0.1, 0.05, n), a @ a.T / n


def test_programmes_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(3, 12))
        mu, cov = random_moments(rng, n)
        eq, over = np.ones((1, n)), np.vstack([np.eye(n), -np.eye(n)])
        to = np.concatenate([np.zeros(n), np.full(n, -0.4)])
        x, u = qp.solve_qp(cov, np.zeros(n), eq, 1.0, over, to)
        assert np.abs(cov @ x - np.vstack([eq, over]).T @ u).max() < 1e-7 and (u[1:] >= -1e-9).all()
        assert x.sum() == pytest.approx(1) and (over @ x >= to - 1e-8).all() and abs(u[1:] @ (over @ x - to)) < 1e-7
        w = qp.max_sharpe(mu, cov, 0.02, (0, 0.4), {0: 0.35}, {1: 0.05})
        best = (w @ mu - 0.02) / np.sqrt(w @ cov @ w)
        for _ in range(40):
            z = rng.dirichlet(np.ones(n - 1)) * 0.65
            z = np.concatenate([[0.35], z])
            if z.max() <= 0.4 and z[1] >= 0.05:
                assert best >= (z @ mu - 0.02) / np.sqrt(z @ cov @ z) - 1e-3 * abs(best)
    with pytest.raises(ValueError):
        qp.max_sharpe([0.01, 0.02], np.eye(2), 0.04)
    with pytest.raises(qp.Infeasible):
        qp.target_return([0.1, 0.2], np.eye(2), 0.3, (0, 1))
    assert qp.clean(np.array([0.123456, 0.00009, 0.5])).tolist() == [0.12346, 0, 0.5]


def test_frontier_is_convex_and_drops_what_is_out_of_reach(spark):
    mu, c = random_moments(np.random.default_rng(3), 4)
    names = list("ABCD")
    cov = spark.createDataFrame([(names[i], names[j], float(c[i, j])) for i in range(4) for j in range(4)], "asset_i string, asset_j string, cov double")
    m = spark.createDataFrame([(a, float(v)) for a, v in zip(names, mu, strict=True)], "asset string, mu double")
    rows = optimize.efficient_frontier(m, cov, names, 21, (0, 1)).orderBy("point_id").collect()
    assert len(rows) == 21
    v = [r.vol**2 for r in rows]
    assert all(a + b >= 2 * x - 1e-9 for a, x, b in zip(v, v[1:], v[2:], strict=False))
    assert len(optimize.efficient_frontier(m, cov, names, 21, (0, 0.4)).collect()) < 21
    least = optimize.weights_dict(optimize.min_vol(m, cov, names))
    w = np.array([least[a] for a in names])
    assert w @ c @ w <= min(v) + 1e-6


def test_optimality_tells_the_optimum_from_others(spark):
    mu, c = random_moments(np.random.default_rng(11), 5)
    mu = mu + 0.1
    names = list("ABCDE")
    cov = spark.createDataFrame([(names[i], names[j], float(c[i, j])) for i in range(5) for j in range(5)], "asset_i string, asset_j string, cov double")
    m = spark.createDataFrame([(a, float(v)) for a, v in zip(names, mu, strict=True)], "asset string, mu double")
    rules = {"bounds": (0, 0.4), "fixed": {"A": 0.3}, "minimum": {"B": 0.05}}
    best = optimize.weights_dict(optimize.max_sharpe(m, cov, names, 0.02, **rules))
    say = lambda w, **k: tuple(optimize.optimality(literal_table(spark, w), m, cov, 0.02, **{**rules, **k}).first())
    assert say(best) == (True, True, True)
    high, low = max("BCDE", key=best.get), min("BCDE", key=best.get)
    moved = {**best, high: best[high] - 0.05, low: best[low] + 0.05}
    assert say(moved) == (True, True, False)
    assert say({**best, "A": 0.35})[:2] == (False, False)
    least = optimize.weights_dict(optimize.min_vol(m, cov, names, (0, 0.4)))
    assert say(least, sharpe=False, fixed=None, minimum=None) == (True, True, True)
    assert say(dict.fromkeys(names, 0.2), sharpe=False, fixed=None, minimum=None)[2] is False


def test_special_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.0733880348)
    assert special.t_two_sided(0.1, 5) == pytest.approx(0.924230141)
    assert special.f_upper(3, 2, 20) == pytest.approx(0.0725381503)
    assert special.t_quantile(0.95, 10) == pytest.approx(2.228138852) and special.t_quantile(0.5, 1) == pytest.approx(1.0)
    x = np.random.default_rng(3).normal(size=(4000, 60))
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    k2 = [special.omnibus(s, k, 60) for s, k in zip((z**3).mean(axis=1), (z**4).mean(axis=1), strict=True)]
    assert np.mean(k2) == pytest.approx(2, abs=0.2) and np.mean(np.exp(-np.array(k2) / 2) < 0.05) == pytest.approx(0.055, abs=0.015)
    assert special.omnibus(0.0, 0.1, 50) > 20 and np.isnan(special.omnibus(0, 3, 7))
    assert special.incomplete_beta(1, 1, 0.3) == pytest.approx(0.3)


def test_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * 0.01
    y = 0.0001 + x @ [1.0, 0.5, -0.2] + rng.normal(size=200) * 0.001
    f = spark.createDataFrame([(day(i), *map(float, v), 0.0001) for i, v in enumerate(x)], "day date, mkt_rf double, smb double, hml double, rf double")
    s = series(spark, (y + 0.0001).tolist())
    got = {r.term: r for r in factors.regress(s, f, " FF3").collect()}
    a = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    assert [got[t].coef for t in ("const", "mkt_rf", "smb", "hml")] == pytest.approx(beta.tolist(), abs=1e-9)
    rest = y - a @ beta
    error = np.sqrt(rest @ rest / 196 * np.diag(np.linalg.inv(a.T @ a)))
    rows = {r.term: r for r in factors.coefficients(s, f, "ff3").collect()}
    assert [rows[t].std_err for t in ("const", "mkt_rf", "smb", "hml")] == pytest.approx(error.tolist(), rel=1e-6)
    assert (rows["smb"].high - rows["smb"].low) / 2 / rows["smb"].std_err == pytest.approx(1.97214, abs=1e-4)  # of 196 degrees of freedom
    fit = {r.metric: r.value for r in factors.fit_statistics(s, f, "ff3").collect()}
    assert fit["condition_number"] == pytest.approx(np.linalg.cond(a)) and fit["df_residuals"] == 196
    z = (rest - rest.mean()) / rest.std()
    assert fit["omnibus"] == pytest.approx(special.omnibus((z**3).mean(), (z**4).mean(), 200)) and 0 <= fit["omnibus_p_value"] <= 1
    e = y - a @ beta
    assert fit["r_squared"] == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum())
    assert fit["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e @ e))
    with pytest.raises(ValueError):
        factors.factor_names("ff4")


def test_factor_files(spark, tmp_path):
    import zipfile

    text = "made for a test\n\n,Mkt-RF,SMB,HML,RF\n20240102, 0.5,-0.1,0.2,0.02\n20240103,1\n20240104,-1.0,0.0,0.1,0.02,7\n\n20240105,1,1,1,1\n"
    (tmp_path / "f.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.csv", text)
    for name in ("f.csv", "f.zip"):
        rows = load_factors(spark, str(tmp_path / name), "FF3").orderBy("day").collect()
        assert [tuple(r) for r in rows] == [(dt.date(2024, 1, 2), 0.005, -0.001, 0.002, 0.0002), (dt.date(2024, 1, 4), -0.01, 0.0, 0.001, 0.0002)]
        assert rows[0].__fields__[1:] == list(FF3)
    (tmp_path / "g.csv").write_text("nothing here")
    with pytest.raises(ValueError):
        load_factors(spark, str(tmp_path / "g.csv"), "ff3")


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_price_sources(spark, tmp_path):
    df = spark.createDataFrame([(day(0), "A", 1.0), (day(1), "A", 2.0), (day(0), "B", 3.0)], "day date, asset string, close double")
    df.write.parquet(str(tmp_path / "p"))
    got = read_prices(spark, str(tmp_path / "p"), ["A"], "2024-01-01", "2024-01-02")
    assert [tuple(r) for r in got.collect()] == [(day(0), "A", 1.0)]
    plan = explained(got)
    assert "GreaterThanOrEqual(day,2024-01-01), LessThan(day,2024-01-02)" in plan and "(asset,A)" in plan[plan.index("PushedFilters") :]
    late = df.selectExpr("cast(day as timestamp) as at", "asset as name", "close as quote", "'x' as more")
    late.write.parquet(str(tmp_path / "r"))
    other = read_prices(spark, str(tmp_path / "r"), ["A", "B"], "2024-01-02", day="at", asset="name", close="quote")
    assert [tuple(r) for r in other.collect()] == [(day(1), "A", 2.0)]
    plan = explained(other)
    assert "GreaterThanOrEqual(at,2024-01-02" in plan and "In(name, [A,B])" in plan and "more" not in plan
    df.drop("close").write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError):
        read_prices(spark, str(tmp_path / "q"), ["A"])
    assert wide_to_long(long_to_wide(df, ["A", "B"])).where("close is not null").exceptAll(df).count() == 0
    with pytest.raises(KeyError):
        require(df, ["A", "C"])


def test_simulation_does_not_depend_on_partitions(spark):
    s = spark.createDataFrame([(0.08, 0.15)], "expected_return double, volatility double")
    a = montecarlo.simulate(s, 1, 300).orderBy("sim_id").collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    b = montecarlo.simulate(s, 1, 300).repartition(3).orderBy("sim_id").collect()
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert a == b
    paths = montecarlo.summarize(montecarlo.simulate(s, 1, 300, paths=True)).orderBy("sim_id").collect()
    assert [p.terminal for p in paths] == pytest.approx([x.terminal for x in a]) and [p.max_drawdown for p in paths] == pytest.approx([x.max_drawdown for x in a])
    mean = sum(x.terminal for x in a) / 300
    assert abs(mean - (1 + 0.08 / 252) ** 252) < 4 * 0.17 / 300**0.5
    assert montecarlo.risk_report(montecarlo.simulate(s, 1, 300)).count() == 15


def walk_data(spark):
    rng = np.random.default_rng(8)
    x = 0.0008 + rng.normal(size=(150, 3)) * 0.01
    return rets(spark, {a: x[:, i].tolist() for i, a in enumerate("ABC")}), x


def test_walk_forward(spark):
    r, x = walk_data(spark)
    book = Portfolio({"A": 0.5, "B": 0.3, "C": 0.2}, "A", bounds=(0, 0.6), absolute_views={"B": (0.2, 0.5)})
    p = ModelParams(walk_window=40)
    t = backtest.walk_forward(r, book, p, book.weights, shrink=False)
    dates = sorted({w.rebalance_date for w in t.weights.collect()})
    assert dates == [dt.date(2024, 2, 29), dt.date(2024, 3, 31), dt.date(2024, 4, 30)]
    w = {(v.rebalance_date, v.asset): v.weight for v in t.weights.collect()}
    cov = np.cov(x[59 - 40 : 60].T) * 252
    mu, _ = qp.posterior(cov, [0.5, 0.3, 0.2], 2.5, 0.05, {1: 0.2})
    want = qp.max_sharpe(mu, cov, 0.04, (0, 0.6))
    assert [w[(dates[0], a)] for a in "ABC"] == pytest.approx(want.tolist(), abs=2e-5)
    d = {v.rebalance_date: v for v in t.diagnostics.collect()}
    assert d[dates[0]].turnover == pytest.approx(np.abs(want - [0.5, 0.3, 0.2]).sum(), abs=1e-4)
    s = {v.day: v.ret for v in t.series.collect()}
    assert min(s) == dates[0] and s[dates[0]] == pytest.approx(float(want @ x[59]), abs=1e-6)  # that day's return is earned
    on = backtest.walk_forward(r, book, replace(p, implementation_layer=True, turnover_lambda=0.5), book.weights, shrink=False)
    assert on.diagnostics.count() == 3
    assert backtest.latest_weights(t.weights).count() == 3 and backtest.last_rows(t.diagnostics, 2).count() == 2
    none = backtest.walk_forward(r, book, replace(p, walk_window=500), book.weights)
    assert none.weights.count() == none.diagnostics.count() == none.series.count() == 0
    with pytest.raises(ValueError):
        backtest.walk_forward(r, replace(book, market_weights={"A": 1.0}), p)


def test_workflows_and_reports(spark, tmp_path):
    rng = np.random.default_rng(2)
    close = 100 * np.cumprod(1 + 0.0008 + rng.normal(size=(130, 4)) * 0.01, axis=0)
    df = spark.createDataFrame([(day(i), a, float(close[i, k])) for i in range(130) for k, a in enumerate("ABCM")], "day date, asset string, close double")
    book = Portfolio({"A": 0.5, "B": 0.3, "C": 0.2}, "M", bounds=(0, 0.6), absolute_views={"B": (0.2, 0.5), "A": (0.15, 0.5)})
    p = ModelParams(walk_window=40, rolling_window=60, mc_years=1, mc_sims=64, frontier_points=5, implementation_layer=True)
    live = workflows.live(df, book, p)
    assert live["current_performance"].count() == 9 and live["implementation"].count() == 1
    research = workflows.research(df, book, p)
    assert research["monte_carlo"].count() == 15 and research["growth"].columns == ["day", "Starting Portfolio", "Max Sharpe", "Min Vol", "M Benchmark", "Walk-Forward OOS"]
    plain = workflows.live(df, book, replace(p, use_black_litterman=False, use_shrinkage=False, implementation_layer=False))
    assert "implementation" not in plain and plain["expected_returns"].where("hist_mu = bl_mu").count() == 3
    at = tmp_path / "new" / "report.html"
    workflows.write_html({"weights": live["target_weights"], "growth": research["growth"], "many": spark.range(1700)}, str(at))
    assert "weights" in at.read_text() and at.read_text().count("<tr>") == 3 + 3 + 129 + 1700
    none = workflows.research(df, book, replace(p, walk_window=500))
    assert none["growth"].where("`Walk-Forward OOS` is not null").count() == 0 and none["walkforward_summary"].count() == 0
    s = series(spark, [0.01, None, -0.02, 0.03])
    workflows.performance_report(s, str(at), s)
    assert "Sharpe" in at.read_text()


def test_live_portfolio(spark):
    """The workflow on the quoted universe: fixed and least weights hold, no weight is over its bound."""
    rng = np.random.default_rng(12)
    names = LIVE.universe
    close = 100 * np.cumprod(1 + 0.0006 + rng.normal(size=(260, len(names))) * 0.012, axis=0)
    df = spark.createDataFrame([(day(i), a, float(close[i, k])) for i in range(260) for k, a in enumerate(names)], "day date, asset string, close double")
    with pytest.warns(UserWarning):
        out = workflows.live(df, LIVE)
    w = {r.asset: r.weight for r in out["target_summary"].collect()}
    assert w["QQQ"] == pytest.approx(0.35) and min(w["IWM"], w["LMT"]) >= 0.05 and max(w.values()) <= 0.4 and sum(w.values()) == pytest.approx(1, abs=1e-4)
    assert [r.asset for r in out["trade_sheet"].collect()] == LIVE.assets


def test_small_tables_beyond_the_bound_are_written(spark, monkeypatch):
    from tideline.functions import small

    monkeypatch.setattr(small, "MOST", 10)
    assert small.settle(spark.range(10)).count() == 10 and sorted(r.id for r in small.settle(spark.range(25)).collect()) == list(range(25))


def test_order_of_rows_does_not_matter(spark):
    _, x = walk_data(spark)
    df = spark.createDataFrame([(day(i), a, float(100 * (1 + x[:i, k].sum()))) for i in range(60) for k, a in enumerate("ABC")], "day date, asset string, close double")
    one = daily_returns(densify(df, list("ABC")))
    two = daily_returns(densify(df.repartition(7, "close").withColumn("close", F.col("close") * 8), list("ABC")))
    r = lambda d: sorted((v.day, v.asset, v.loc, round(v.ret, 12)) for v in d.collect())
    assert r(one) == r(two)
    assert drawdowns(portfolio_series(one, {"A": 1.0})).agg(F.max("drawdown")).first()[0] <= 0
