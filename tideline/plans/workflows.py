"""The two workflows, each a mapping of report names to tables: live rebalancing and research."""

from __future__ import annotations

import html
import pathlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import ModelParams, Portfolio
from tideline.functions.shared import stored
from tideline.functions.small import printed, settle
from tideline.operators import backtest, bayes, costs, factors, montecarlo, optimize, performance, risk, rolling
from tideline.operators.moments import mean_cov
from tideline.operators.returns import asset_series, daily_returns, densify, drawdowns, growth_frame, on_days_of, portfolio_series, require


def _inputs(prices: DataFrame, book: Portfolio, p: ModelParams):
    returns = daily_returns(densify(require(prices, book.universe), book.universe), pad=p.semantics.pad_gaps)
    mine = returns.where(F.col("asset").isin(book.assets))
    hist, cov = mean_cov(mine, p.trading_days, p.use_shrinkage, p.shrinkage, book.assets)
    hist, cov = settle(hist), settle(cov)
    if p.use_black_litterman:
        both = settle(bayes.posterior(cov, book.assets, book.market, p.risk_aversion, p.tau, book.absolute_views, book.relative_views))
        mu, pi = both.select("asset", F.col("bl_mu").alias("mu")), both.select("asset", "pi")
    else:
        mu, pi = hist, hist.select("asset", F.col("mu").alias("pi"))
    compare = bayes.compare_mu(hist.withColumnRenamed("mu", "hist_mu"), pi, mu.withColumnRenamed("mu", "bl_mu"))
    return returns, mine, hist, cov, mu, compare


def _best(mu, cov, current, book: Portfolio, p: ModelParams):
    goal = costs.implementation_layer(mu, current, p.implementation_layer, p.turnover_lambda)
    return optimize.max_sharpe(goal, cov, book.assets, p.risk_free, book.bounds, book.fixed, book.minimum)


def live(prices: DataFrame, book: Portfolio, p: ModelParams = ModelParams()) -> dict[str, DataFrame]:
    """Target weights for today's holdings and what moving to them means."""
    spark = prices.sparkSession
    returns, mine, hist, cov, mu, compare = _inputs(prices, book, p)
    current = optimize.weights_table(spark, book.weights, book.assets)
    target = settle(_best(mu, cov, current, book, p))
    stats = risk.portfolio_stats(target, mu, cov, p.risk_free)
    both = costs.two_weights(current, target)
    series, bench = portfolio_series(mine, book.weights, "current", p.semantics.reweight), asset_series(returns, book.benchmark)
    table, numbers = costs.optimized_summary(target, stats)
    out = {
        "expected_returns": compare,
        "current_stats": risk.portfolio_stats(current, mu, cov, p.risk_free),
        "current_performance": performance.summary_table(series, bench, p.risk_free, p.trading_days, performance.CURRENT, p.semantics),
        "current_weights": costs.weight_lines(current),
        "target_weights": costs.weight_lines(target),
        "target_summary": table,
        "target_stats": numbers,
        "weight_changes": costs.weight_changes(both, p.action_threshold),
        "trade_sheet": costs.trade_sheet(both),
        "risk_contribution": risk.risk_contribution(target, cov),
    }
    if p.implementation_layer:
        gross = stats.first()["expected_return"]
        out["implementation"] = costs.net_return(both, gross, p.cost_bps, p.slippage_bps, p.gain_rate if p.apply_tax else None, p.short_term_rate, p.long_term_rate, p.long_term_fraction)
    return out


def research(prices: DataFrame, book: Portfolio, p: ModelParams = ModelParams(), factor_table: DataFrame | None = None) -> dict[str, DataFrame]:
    """Optimal portfolios, their realised history, factors, walk-forward test, Monte Carlo risk and chart data."""
    spark = prices.sparkSession
    returns, mine, hist, cov, mu, compare = _inputs(prices, book, p)
    start = optimize.weights_table(spark, book.weights, book.assets)
    best = settle(_best(mu, cov, start, book, p))
    least = settle(optimize.min_vol(mu, cov, book.assets, book.bounds))
    bench = asset_series(returns, book.benchmark, f"{book.benchmark} Benchmark")
    series = {n: portfolio_series(mine, w, n, p.semantics.reweight) for n, w in (("Starting Portfolio", book.weights), ("Max Sharpe", optimize.weights_dict(best)), ("Min Vol", optimize.weights_dict(least)))}
    test = backtest.walk_forward(mine, book, p, book.weights)
    # all that follows reads the series, most of it several times: made once, in few files
    every = stored(reduce(DataFrame.union, [*series.values(), test.series.withColumn("series", F.lit("Walk-Forward OOS"))]), "series")
    one = lambda n: every.where(F.col("series") == n)
    series, walked = {n: one(n) for n in series}, one("Walk-Forward OOS")
    stats = settle(risk.portfolio_stats(best, mu, cov, p.risk_free))
    point = settle(performance.benchmark_point(bench, p.trading_days))
    frontier = settle(optimize.efficient_frontier(mu, cov, book.assets, p.frontier_points, book.bounds))
    ends = montecarlo.simulate(risk.portfolio_stats(start, mu, cov, p.risk_free), p.mc_years, p.mc_sims, p.trading_days, p.mc_initial, p.mc_seed)
    walk_bench = on_days_of(bench, walked)
    out = {
        "expected_returns": compare,
        "max_sharpe": costs.weight_lines(best),
        "min_vol": costs.weight_lines(least),
        "portfolio_stats": stats,
        "rolling": rolling.rolling_statistics(mine, p.rolling_window, p.trading_days),
        "summary": performance.summary_table(every, bench, p.risk_free, p.trading_days, semantics=p.semantics),
        "walkforward_summary": performance.summary_table(walked, walk_bench, p.risk_free, p.trading_days, semantics=p.semantics),
        "walkforward_weights": backtest.latest_weights(test.weights),
        "walkforward_diagnostics": backtest.last_rows(test.diagnostics),
        "risk_contribution": risk.risk_contribution(best, cov),
        "monte_carlo": montecarlo.risk_report(ends, p.mc_initial if p.semantics.relative_thresholds else 1.0),
        "growth": growth_frame({**series, f"{book.benchmark} Benchmark": bench}, {"Walk-Forward OOS": walked}),
        "frontier": frontier,
        "benchmark_point": point,
        "capital_market_line": optimize.capital_market_line(stats, frontier, point, p.risk_free),
    }
    if factor_table is not None:
        f = stored(factor_table, "factors")
        for name, s in (("factors", series["Max Sharpe"]), ("walkforward_factors", walked)):
            found = settle(factors.coefficients(s, f))
            out[name], out[f"{name}_fit"] = found.select("series", "term", "coef", "t_stat", "p_value"), factors.fit_statistics(s, f, known=found)
            out[f"{name}_coefficients"] = found
    return out


def write_html(tables: dict[str, DataFrame], path: str, title: str = "Portfolio report") -> None:
    """The tables of a report, all their rows, as one HTML file; parents are made.

    For reports: their longest tables have a row for each trading day.
    """
    body = []
    for name, df in tables.items():
        body.append(f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        body += ["<tr>" + "".join(f"<td>{html.escape(f'{v:.4f}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in printed(df).toLocalIterator()]
        body.append("</table>")
    at = pathlib.Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(body), encoding="utf-8")


def performance_report(series: DataFrame, path: str, benchmark: DataFrame | None = None, rf: float = 0.04, days: int = 252) -> None:
    """An HTML tearsheet of a return series, without its null days, with or without a benchmark."""
    s = series.where("ret is not null")
    monthly = s.groupBy(F.last_day("day").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret")).orderBy("month")
    deepest = drawdowns(s).orderBy("drawdown").limit(10)
    tables = {"metrics": performance.summary_table(s, benchmark, rf, days) if benchmark is not None else performance.annual_stats(s, rf, days), "monthly returns": monthly, "deepest days": deepest}
    write_html(tables, path, "Portfolio Report")
