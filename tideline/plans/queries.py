"""One query for each operator, over the panel of part prices, with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.config import PARTS, PARTS_TARGET, ModelParams
from tideline.functions.shared import new_path, stored
from tideline.functions.small import printed, settle
from tideline.operators import backtest, bayes, costs, factors, moment_store, moments, montecarlo, optimize, performance, returns, risk, rolling
from tideline.operators.quantiles import quantiles
from tideline.plans import workflows
from tideline.sources.factors import FF5, load_factors, parse_factors
from tideline.sources import reports
from tideline.sources.panel import literal_table, part_prices
from tideline.sources.quotes import read_quotes

P, BOOK = ModelParams(), PARTS
#: First day of the stored quotes that are read, and the day after their last.
QUOTES = ("2024-01-05", "2024-01-20")
_PRICES: dict[tuple[str, str], DataFrame] = {}


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price panel, some thousand rows for any input, kept in memory for the session.

    It is written first: kept as it comes from its window, it would have a task for each
    shuffle partition in every scan of it, and the plans here scan it often.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PRICES:
        kept = stored(part_prices(spark, sf_dir), "prices").cache()
        kept.count()
        _PRICES[key] = kept
    return _PRICES[key]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, for comparison."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


class Inputs:
    """What the queries share, each made when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.current = literal_table(spark, BOOK.weights)
        self.target = literal_table(spark, PARTS_TARGET)
        self.both = costs.two_weights(self.current, self.target)

    @property
    def prices(self) -> DataFrame:
        return prices(self.spark, self.sf_dir)

    @property
    def panel(self) -> DataFrame:
        return returns.densify(self.prices, BOOK.universe)

    @cached_property
    def every(self) -> DataFrame:
        return returns.daily_returns(self.panel)

    @property
    def mine(self) -> DataFrame:
        return self.every.where(F.col("asset").isin(BOOK.assets))

    @property
    def bench(self) -> DataFrame:
        return returns.asset_series(self.every, BOOK.benchmark)

    @property
    def series(self) -> DataFrame:
        return returns.portfolio_series(self.mine, BOOK.weights)

    @property
    def mu(self) -> DataFrame:
        return moments.annual_mean(self.mine)

    @cached_property
    def cov(self) -> DataFrame:
        return settle(moments.shrunk_cov(self.mine, assets=BOOK.assets))

    @cached_property
    def bl_mu(self) -> DataFrame:
        return settle(bayes.posterior(self.cov, BOOK.assets, BOOK.market, views=BOOK.absolute_views).select("asset", F.col("bl_mu").alias("mu")))

    @cached_property
    def dates(self) -> DataFrame:
        return rolling.eligible_dates(self.mine, P.walk_window)

    @property
    def history(self) -> DataFrame:
        """Weights that change from the starting to the target ones with the month's parity."""
        w = F.when(F.month("rebalance_date") % 2 == 1, returns.asset_weights(BOOK.weights)).otherwise(returns.asset_weights(PARTS_TARGET))
        one = self.dates.select("rebalance_date", F.explode(F.array(*map(F.lit, BOOK.assets))).alias("asset"))
        return one.withColumn("weight", w)

    @property
    def factors(self) -> DataFrame:
        """Stand-ins for published factors: differences of the assets' returns."""
        wide = self.every.groupBy("day").pivot("asset", BOOK.universe).agg(F.first("ret"))
        rf = P.risk_free / P.trading_days
        c = F.col
        return wide.select("day", (c("MKT") - rf).alias("mkt_rf"), (c("SMALL") - c("LARGE")).alias("smb"), (c("ECONOMY") - c("PROMO")).alias("hml"), (c("STANDARD") - c("MEDIUM")).alias("rmw"), (c("PROMO") - c("SMALL")).alias("cma"), F.lit(rf).alias("rf"))

    @property
    def paths(self) -> DataFrame:
        """A deterministic walk for each of 100 groups of customers."""
        o = self.spark.read.parquet(f"{self.sf_dir}/orders.parquet")
        w = Window.partitionBy("sim_id").orderBy("o_orderkey")
        o = o.select((F.col("o_custkey") % 100).alias("sim_id"), "o_orderkey", (F.lit(0.5) + F.col("o_totalprice") / 100000.0).alias("value"))
        return o.select("sim_id", F.row_number().over(w).alias("step"), "value")


#: Lines of a factor file: preamble, table, a short row, a blank line, a footer.
FACTOR_TEXT = ["This file was made for a test", "", ",Mkt-RF,SMB,HML,RMW,CMA,RF", "20240102,  0.50, -0.10, 0.20, 0.05, -0.07, 0.02", "20240103, -0.25,0.15,-0.30,0.01,0.02,0.02,9", "20240104, 0.10", "20240105,1.00,0.00,0.00,0.00,0.00,0.02", "", "20240108,1.00,1.00,1.00,1.00,1.00,0.02", "Copyright"]


def _factor_lines(i: Inputs) -> DataFrame:
    return i.spark.createDataFrame(list(enumerate(FACTOR_TEXT)), "line_no int, value string")


def _walk(i: Inputs, layer: bool = False) -> backtest.Backtest:
    return backtest.walk_forward(i.mine, BOOK, replace(P, implementation_layer=layer), BOOK.weights)


def _report(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables of a workflow as rows (report, row)."""
    out = None
    for name, df in tables.items():
        t = rounded(df).select(F.lit(name).alias("report"), F.to_json(F.struct("*")).alias("row"))
        out = t if out is None else out.unionByName(t)
    return out


QUERIES = {
    "prices_vwap": lambda i: i.prices,
    "prices_densified": lambda i: i.panel,
    "returns_daily": lambda i: i.every,
    "annualized_mean": lambda i: i.mu,
    "sample_cov": lambda i: moments.sample_cov(i.mine, assets=BOOK.assets),
    "lw_moments": lambda i: moments.shrinkage_parts(i.mine, assets=BOOK.assets).select("asset_i", "asset_j", (F.col("s") * 1e4).alias("s"), (F.col("q") * 1e8).alias("q"), "n"),
    "lw_delta": lambda i: moments.shrinkage(moments.shrinkage_parts(i.mine, assets=BOOK.assets)).select((F.col("m") * 1e4).alias("m"), "delta"),
    "lw_cov": lambda i: moments.shrunk_cov(i.mine, assets=BOOK.assets),
    "implied_returns": lambda i: bayes.implied_returns(i.cov, BOOK.market),
    "bl_single_view": lambda i: bayes.posterior(i.cov, BOOK.assets, BOOK.market, views={"LARGE": (0.12, 0.3)}),
    "mu_compare": lambda i: bayes.compare_mu(i.mu.withColumnRenamed("mu", "hist_mu"), bayes.implied_returns(i.cov, BOOK.market), moments.annual_mean(i.every).withColumnRenamed("mu", "all_mu")),
    "portfolio_series": lambda i: i.series,
    "portfolio_stats": lambda i: risk.portfolio_stats(i.current, i.mu, i.cov),
    "cumulative_growth": lambda i: returns.growth(i.series),
    "drawdown_path": lambda i: returns.drawdowns(i.series).select("day", "value", "drawdown"),
    "max_drawdown": lambda i: performance.max_drawdown(i.series),
    "annualized_return": lambda i: performance.annual_stats(i.series).select("series", "annual_return"),
    "annualized_vol": lambda i: performance.annual_stats(i.series).select("series", "annual_vol"),
    "sharpe": lambda i: performance.annual_stats(i.series).select("series", "sharpe"),
    "beta_alpha": lambda i: performance.against(i.series, i.bench),
    "summary_table": lambda i: performance.summary_table(i.series, i.bench),
    "current_performance": lambda i: performance.summary_table(i.series, i.bench, labels=performance.CURRENT),
    "risk_contribution": lambda i: risk.risk_contribution(i.target, i.cov),
    "weight_changes": lambda i: costs.weight_changes(i.both),
    "trade_sheet": lambda i: costs.trade_sheet(i.both),
    "turnover": lambda i: costs.turnover(i.both),
    "impl_cost": lambda i: costs.cost_rate(i.both),
    "tax_drag": lambda i: costs.tax_drag(i.both),
    "net_return": lambda i: costs.net_return(i.both, 0.10),
    "mu_penalized": lambda i: costs.penalized_mu(i.mu, i.current),
    "normalize_weights": lambda i: optimize.normalize_weights(i.prices.groupBy("asset").agg(F.count("close").cast("double").alias("weight")).select(F.lit("days").alias("portfolio"), "asset", "weight")),
    "rolling_stats": lambda i: rolling.rolling_statistics(i.mine),
    "rebalance_dates": lambda i: rolling.rebalance_dates(i.mine),
    "eligible_dates": lambda i: i.dates,
    "wf_window_moments": lambda i: rolling.window_moments(i.mine, i.dates, assets=BOOK.assets)[1],
    "wf_window_mean": lambda i: rolling.window_moments(i.mine, i.dates, assets=BOOK.assets)[0],
    "asof_weights": lambda i: rolling.asof_weights(i.mine, i.history).select("day", "asset", "weight"),
    "wf_series_fixed_policy": lambda i: rolling.history_series(i.mine, i.history),
    "growth_frame": lambda i: returns.growth_frame({"portfolio": i.series, "MKT": i.bench}, {"walkforward_portfolio": rolling.history_series(i.mine, i.history)}),
    "benchmark_on_days": lambda i: returns.on_days_of(i.bench, rolling.history_series(i.mine, i.history)),
    "stored_quotes": lambda i: read_quotes(i.spark, f"{i.sf_dir}/events.parquet", ["click", "purchase", "view"], *QUOTES, day="ts", asset="event_type", close="value"),
    "printed_summary": lambda i: printed(performance.summary_table(i.series, i.bench)),
    "wf_shrunk_cov": lambda i: rolling.window_moments(i.mine, i.dates, shrink=True, assets=BOOK.assets)[1],
    "diagnostics_fixed_policy": lambda i: backtest.policy_diagnostics(i.history, *rolling.window_moments(i.mine, i.dates, assets=BOOK.assets), BOOK.weights),
    "cml_given_frontier": lambda i: optimize.capital_market_line(risk.portfolio_stats(i.target, i.mu, i.cov), i.mine.groupBy("asset").agg((F.stddev_samp("ret") * 252**0.5).alias("vol")), performance.benchmark_point(i.bench)),
    "bl_posterior": lambda i: bayes.posterior(i.cov, BOOK.assets, BOOK.market, views=BOOK.absolute_views, relative_views=()),
    "ff3_regression": lambda i: factors.regress(i.series, i.factors, "FF3 "),
    "ff5_regression": lambda i: factors.regress(i.series, i.factors),
    "factor_fit": lambda i: factors.fit_statistics(i.series, i.factors).where(~F.col("metric").isin("f_p_value", "omnibus", "omnibus_p_value", "condition_number")),
    "equal_weights": lambda i: returns.portfolio_series(i.mine, dict.fromkeys(BOOK.assets, 1 / len(BOOK.assets))),
    "factor_file": lambda i: _factor_file(i),
    "path_names": lambda i: montecarlo.path_names(i.paths).groupBy("sim_id", "sim").agg(F.count(F.lit(1)).alias("steps")),
    "max_sharpe_optimality": lambda i: _judged(i, optimize.max_sharpe(i.bl_mu, i.cov, BOOK.assets, P.risk_free, BOOK.bounds, BOOK.fixed, BOOK.minimum), bounds=BOOK.bounds, fixed=BOOK.fixed, minimum=BOOK.minimum),
    "max_sharpe_unconstrained_optimality": lambda i: _judged(i, optimize.max_sharpe(i.bl_mu, i.cov, BOOK.assets, P.risk_free)),
    "min_vol_optimality": lambda i: _judged(i, optimize.min_vol(i.bl_mu, i.cov, BOOK.assets, BOOK.bounds), bounds=BOOK.bounds, sharpe=False),
    "frontier_points": lambda i: optimize.efficient_frontier(i.bl_mu, i.cov, BOOK.assets, P.frontier_points, BOOK.bounds).select("point_id", "target_ret", F.round("vol", 5).alias("vol")),
    "walkforward_sharpe": lambda i: _walk_sharpe(_walk(i)),
    "ff_single_factor": lambda i: factors.regression_rows(i.series, i.factors).groupBy("series").agg(F.regr_slope("y", "mkt_rf").alias("slope"), F.regr_intercept("y", "mkt_rf").alias("intercept"), F.count(F.lit(1)).alias("n")),
    "factor_gram": lambda i: factors.gram(factors.regression_rows(i.series, i.factors), ["mkt_rf", "smb"]).select("series", "n", *[(F.col(c) * 100).alias(c) for c in ("mkt_rf__mkt_rf", "mkt_rf__smb", "mkt_rf__y", "smb__y", "y__y")]),
    "benchmark_point": lambda i: performance.benchmark_point(i.bench),
    "frontier_targets": lambda i: optimize.frontier_targets(i.mu, P.frontier_points),
    "universe_dedup": lambda i: literal_table(i.spark, dict.fromkeys([*BOOK.assets, BOOK.benchmark, BOOK.benchmark, "SMALL"], 1.0)).select("asset", "asset_ord"),
    "market_weights": lambda i: _market_weights(i),
    "latest_weights": lambda i: backtest.latest_weights(i.history),
    "last5_diag": lambda i: backtest.last_rows(i.dates),
    "turnover_history": lambda i: backtest.turnover_history(i.history, BOOK.weights),
    "mc_stats_from_paths": lambda i: montecarlo.terminal_stats(stored(montecarlo.summarize(i.paths), "path-ends")),
    "drawdown_stats_from_paths": lambda i: montecarlo.drawdown_stats(stored(montecarlo.summarize(i.paths), "path-ends")),
    "mc_report_from_paths": lambda i: montecarlo.risk_report(montecarlo.summarize(i.paths)),
    # two sets of weights made of the line items, and factors read back from a file made of the returns
    "held_weight_changes": lambda i: costs.weight_changes(_held_both(i)),
    "held_trade_sheet": lambda i: costs.trade_sheet(_held_both(i)),
    "held_turnover": lambda i: costs.turnover(_held_both(i)),
    "held_impl_cost": lambda i: costs.cost_rate(_held_both(i)),
    "held_tax_drag": lambda i: costs.tax_drag(_held_both(i)),
    "held_net_return": lambda i: costs.net_return(_held_both(i), 0.10),
    "held_print_weights": lambda i: costs.weight_lines(_held(i, 0)),
    "held_summary": lambda i: costs.optimized_summary(_held(i, 1), risk.portfolio_stats(_held(i, 1), i.mu, i.cov))[1],
    "held_summary_weights": lambda i: costs.optimized_summary(_held(i, 1), risk.portfolio_stats(_held(i, 1), i.mu, i.cov))[0],
    "factors_from_file": lambda i: load_factors(i.spark, _factor_text(i), "FF5 "),
    "report_written": lambda i: _written(i),
    # the other way of each option of SemanticsOptions
    "rebalance_dates_trading": lambda i: rolling.rebalance_dates(i.mine, trading=True),
    "returns_unpadded": lambda i: returns.daily_returns(returns.densify(_with_gaps(i.prices), BOOK.universe), pad=False),
    "series_next_day": lambda i: rolling.history_series(i.mine, i.history, next_day=True),
    "drawdown_from_start": lambda i: returns.drawdowns(i.series, from_start=True).select("day", "drawdown"),
    "alpha_over_rf": lambda i: performance.against(i.series, i.bench, over_rf=P.risk_free).select("series", "alpha"),
    "series_reweighted": lambda i: returns.portfolio_series(i.mine, BOOK.weights, reweight=True),
    "loss_against_start": lambda i: montecarlo.terminal_stats(stored(montecarlo.summarize(i.paths), "path-ends"), 1.5).select("prob_loss", "prob_double", "prob_5x"),
    "price_quantiles": lambda i: _price_quantiles(i),
    "maintained_cov": lambda i: _maintained(i).sample_cov(),
    "maintained_lw_cov": lambda i: _maintained(i).shrunk_cov(),
    "kf_parse": lambda i: parse_factors(_factor_lines(i), FF5),
    "print_weights": lambda i: costs.weight_lines(i.current),
    "optimized_summary": lambda i: costs.optimized_summary(i.target, risk.portfolio_stats(i.target, i.mu, i.cov))[0],
    # what SQL cannot say
    "max_sharpe": lambda i: optimize.max_sharpe(i.bl_mu, i.cov, BOOK.assets, P.risk_free, BOOK.bounds, BOOK.fixed, BOOK.minimum),
    "max_sharpe_unconstrained": lambda i: optimize.max_sharpe(i.bl_mu, i.cov, BOOK.assets, P.risk_free),
    "min_vol": lambda i: optimize.min_vol(i.bl_mu, i.cov, BOOK.assets, BOOK.bounds),
    "frontier": lambda i: optimize.efficient_frontier(i.bl_mu, i.cov, BOOK.assets, P.frontier_points, BOOK.bounds),
    "cml": lambda i: optimize.capital_market_line(risk.portfolio_stats(i.target, i.bl_mu, i.cov), optimize.efficient_frontier(i.bl_mu, i.cov, BOOK.assets, P.frontier_points, BOOK.bounds), performance.benchmark_point(i.bench)),
    "factor_coefficients": lambda i: factors.coefficients(i.series, i.factors),
    "factor_table": lambda i: factors.fit_statistics(i.series, i.factors),
    "mc_paths": lambda i: montecarlo.simulate(risk.portfolio_stats(i.current, i.bl_mu, i.cov), P.mc_years, P.mc_sims, paths=True),
    "mc_report": lambda i: montecarlo.risk_report(montecarlo.simulate(risk.portfolio_stats(i.current, i.bl_mu, i.cov), P.mc_years, P.mc_sims)),
    "walkforward_weights": lambda i: _walk(i).weights,
    "walkforward_diagnostics": lambda i: _walk(i).diagnostics,
    "walkforward_layer_on": lambda i: _walk(i, True).diagnostics,
    "walkforward_series": lambda i: _walk(i).series,
    "live_report": lambda i: _report(workflows.live(i.prices, BOOK, replace(P, implementation_layer=True))),
    "research_report": lambda i: _report(workflows.research(i.prices, BOOK, P, i.factors)),
}


def _market_weights(i: Inputs) -> DataFrame:
    lines = i.spark.read.parquet(f"{i.sf_dir}/lineitem.parquet").select("l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    part = i.spark.read.parquet(f"{i.sf_dir}/part.parquet").select("p_partkey", F.col("p_type").alias("asset"))
    v = lines.join(part, lines.l_partkey == part.p_partkey).groupBy("asset").agg(F.sum("v").cast("double").alias("weight"))
    return optimize.normalize_weights(v.select(F.lit("market").alias("portfolio"), "asset", "weight"))


def _held(i: Inputs, half: int) -> DataFrame:
    """(asset, asset_ord, weight) of the part types by the value shipped in even years (0) or odd ones (1)."""
    lines = i.spark.read.parquet(f"{i.sf_dir}/lineitem.parquet").where(F.year("l_shipdate") % 2 == half).select("l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    part = i.spark.read.parquet(f"{i.sf_dir}/part.parquet").select("p_partkey", F.col("p_type").alias("asset"))
    v = lines.join(part, lines.l_partkey == part.p_partkey).groupBy("asset").agg(F.sum("v").cast("double").alias("weight"))
    place = (F.array_position(F.lit(BOOK.assets), F.col("asset")) - 1).cast("int")
    return optimize.normalize_weights(v.select(F.lit("held").alias("portfolio"), "asset", place.alias("asset_ord"), "weight")).drop("portfolio")


def _held_both(i: Inputs) -> DataFrame:
    return costs.two_weights(_held(i, 0), _held(i, 1))


def _factor_text(i: Inputs) -> str:
    """A factor file of all days, in the published form: a preamble, dated percentages to four places, a footer."""
    known = i.factors.dropna()
    row = F.format_string("%s" + ",%10.4f" * len(FF5), F.date_format("day", "yyyyMMdd"), *[F.col(c) * 100 for c in FF5])
    text = lambda place, lines: i.spark.createDataFrame([(place, None, x) for x in lines], "place int, day date, value string")
    every = text(0, ["Factors made of the returns of part types", "", ",Mkt-RF,SMB,HML,RMW,CMA,RF"]).unionByName(known.select(F.lit(1).alias("place"), "day", row.alias("value"))).unionByName(text(2, ["", "Made for a test"]))
    path = new_path(i.spark, "factor-text")
    every.coalesce(1).sortWithinPartitions("place", "day").select("value").write.text(path)
    return path


def _written(i: Inputs) -> DataFrame:
    """The drawdown chart's data, written as a table of a report and read back."""
    root = new_path(i.spark, "report")
    reports.write_tables({"summary": performance.summary_table(i.series, i.bench), "drawdown": returns.drawdowns(i.series).select("day", "value", "drawdown")}, root)
    return reports.read_table(i.spark, root, "drawdown")


def _with_gaps(prices: DataFrame) -> DataFrame:
    """Prices without those of an asset whose days' numbers leave the remainder of its name's length by 7."""
    return prices.where(F.pmod(F.unix_date("day"), F.lit(7)) != F.pmod(F.length("asset"), F.lit(7)))


def _judged(i: Inputs, weights: DataFrame, sharpe: bool = True, **rules) -> DataFrame:
    """optimality() of weights, and the value they reach when they are made to sum to 1."""
    weights = settle(weights)
    flags = optimize.optimality(weights, i.bl_mu, i.cov, P.risk_free, sharpe=sharpe, **rules)
    sums = weights.agg(F.sum("weight").alias("total"))
    one = risk.portfolio_stats(weights, i.bl_mu, i.cov, P.risk_free).join(sums)
    value = (F.col("expected_return") - P.risk_free * F.col("total")) / F.col("volatility") if sharpe else F.col("volatility") / F.col("total")
    return flags.join(one.select(F.round(value, 4).alias("value")))


def _walk_sharpe(test: backtest.Backtest) -> DataFrame:
    """The Sharpe ratio that each date's target was expected to have, its weights made to sum to 1."""
    sums = test.weights.groupBy("rebalance_date").agg(F.sum("weight").alias("total"))
    value = (F.col("expected_return") - P.risk_free * F.col("total")) / F.col("volatility")
    return test.diagnostics.join(sums, "rebalance_date").select("rebalance_date", F.round(value, 4).alias("value"))


def _maintained(i: Inputs) -> moment_store.MomentStore:
    """A store of moments made of all line items but those of the last days, and then brought up to date."""
    store = moment_store.MomentStore(i.spark, new_path(i.spark, "moments"), tuple(BOOK.assets), BOOK.benchmark)
    last = i.spark.read.parquet(f"{i.sf_dir}/lineitem.parquet").agg(F.to_date(F.max("l_shipdate"))).first()[0]
    for upto in (last - dt.timedelta(days=40), last - dt.timedelta(days=1), None):
        store.add(i.sf_dir, upto)
    return store


def _price_quantiles(i: Inputs) -> DataFrame:
    """Exact quantiles of all line items' prices and of their quantities, which are mostly ties."""
    lines = i.spark.read.parquet(f"{i.sf_dir}/lineitem.parquet").select("l_extendedprice", "l_quantity")
    shares = [0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]
    both = zip(shares, quantiles(lines, "l_extendedprice", shares), quantiles(lines, "l_quantity", shares), strict=True)
    return i.spark.createDataFrame(list(both), "share double, price double, quantity double")


def _factor_file(i: Inputs) -> DataFrame:
    """The lines of the factor file, written as text to the shared folder and loaded from it."""
    path = new_path(i.spark, "factors")
    i.spark.createDataFrame([(x,) for x in FACTOR_TEXT], "value string").coalesce(1).write.text(path)
    return load_factors(i.spark, path, " FF5")


def queries() -> dict:
    def of(f):
        return lambda spark, sf_dir: rounded(f(Inputs(spark, sf_dir)))

    return {name: of(f) for name, f in QUERIES.items()}


# --- SQL -------------------------------------------------------------------------------------


def _values(weights: dict[str, float]) -> str:
    return ", ".join(f"('{a}', {i}, {float(v)!r}::DOUBLE)" for i, (a, v) in enumerate(weights.items()))


_ASSETS = ", ".join(f"'{a}'" for a in BOOK.assets)
_UNIVERSE = ", ".join(f"('{a}')" for a in BOOK.universe)
_WHERE = f"WHERE asset IN ({_ASSETS})"

#: Common tables: prices, panel, rets (all), mine, weights, moments, series.
_CTE = f"""
WITH daily AS (SELECT CAST(l_shipdate AS DATE) AS day, p_type AS asset, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS v, sum(CAST(round(l_quantity * 100) AS BIGINT)) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE isodow(l_shipdate) < 6 GROUP BY 1, 2),
lines AS (SELECT day, asset, v, q FROM daily UNION ALL SELECT day, 'MKT', sum(v), sum(q) FROM daily GROUP BY day),
smooth AS (SELECT day, asset, CAST(sum(v) OVER w AS DOUBLE) / CAST(sum(q) OVER w AS DOUBLE) AS close, row_number() OVER (PARTITION BY asset ORDER BY day) AS n
  FROM lines WINDOW w AS (PARTITION BY asset ORDER BY day ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
prices AS (SELECT day, asset, close FROM smooth WHERE n >= 63),
panel AS (SELECT d.day, u.asset, p.close FROM (SELECT DISTINCT day FROM prices) d CROSS JOIN (VALUES {_UNIVERSE}) u(asset) LEFT JOIN prices p ON p.day = d.day AND p.asset = u.asset),
filled AS (SELECT day, asset, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close FROM panel),
change AS (SELECT day, asset, close / lag(close) OVER (PARTITION BY asset ORDER BY day) - 1 AS ret FROM filled),
days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS loc FROM (SELECT DISTINCT day FROM change WHERE ret IS NOT NULL)),
rets AS (SELECT c.day, loc, asset, ret FROM change c JOIN days USING (day)),
mine AS (SELECT * FROM rets {_WHERE}),
w(asset, asset_ord, weight) AS (VALUES {_values(BOOK.weights)}),
t(asset, asset_ord, weight) AS (VALUES {_values(PARTS_TARGET)}),
mw(asset, asset_ord, weight) AS (VALUES {_values(BOOK.market)}),
both_w AS (SELECT w.asset, w.asset_ord, w.weight AS current, t.weight AS target FROM w JOIN t USING (asset)),
mu AS (SELECT asset, avg(ret) * 252 AS mu FROM mine GROUP BY asset),
centred AS (SELECT day, asset, coalesce(ret, 0) - avg(coalesce(ret, 0)) OVER (PARTITION BY asset) AS x FROM mine),
parts AS (SELECT a.asset AS asset_i, b.asset AS asset_j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, count(*) AS n FROM centred a JOIN centred b USING (day) GROUP BY 1, 2),
sums AS (SELECT count(DISTINCT asset_i)::DOUBLE AS p, sum(s) FILTER (WHERE asset_i = asset_j) / count(DISTINCT asset_i) AS m, sum(s * s) AS ss, sum(q) AS qq, max(n)::DOUBLE AS n FROM parts),
level AS (SELECT m, CASE WHEN least((ss - p * m * m) / p, (qq - ss) / (p * n)) = 0 THEN 0 ELSE least((ss - p * m * m) / p, (qq - ss) / (p * n)) / ((ss - p * m * m) / p) END AS delta FROM sums),
cov AS (SELECT asset_i, asset_j, ((1 - delta) * s + CASE WHEN asset_i = asset_j THEN delta * m ELSE 0 END) * 252 AS cov FROM parts, level),
pi AS (SELECT asset_i AS asset, sum(cov * weight) * 2.5 AS pi FROM cov JOIN mw ON mw.asset = asset_j GROUP BY 1),
series AS (SELECT day, 'portfolio' AS series, coalesce(sum(ret * weight), 0) AS ret FROM mine JOIN w USING (asset) GROUP BY day),
bench AS (SELECT day, ret FROM rets WHERE asset = 'MKT'),
grown AS (SELECT day, series, ret, CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS value FROM series),
fall AS (SELECT *, value / max(value) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM grown),
ann AS (SELECT series, product(1 + ret) ^ (252.0 / count(*)) - 1 AS annual_return, stddev_samp(ret) * sqrt(252) AS annual_vol FROM series GROUP BY series),
joint AS (SELECT s.series, s.ret AS r, b.ret AS b FROM series s JOIN bench b USING (day) WHERE s.ret IS NOT NULL AND b.ret IS NOT NULL),
versus AS (SELECT series, covar_samp(r, b) / var_samp(b) AS beta, (avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252 AS alpha, covar_samp(r, b) / (stddev_samp(r) * stddev_samp(b)) AS correlation,
  stddev_samp(r - b) * sqrt(252) AS tracking_error, avg(r - b) * 252 / (stddev_samp(r - b) * sqrt(252)) AS information_ratio FROM joint GROUP BY series),
dates AS (SELECT DISTINCT day AS rebalance_date, loc FROM mine WHERE day = last_day(day) AND loc >= 756),
sample AS (SELECT d.rebalance_date, m.* FROM mine m JOIN dates d ON m.loc BETWEEN d.loc - 756 AND d.loc),
history AS (SELECT rebalance_date, w.asset, CASE WHEN month(rebalance_date) % 2 = 1 THEN w.weight ELSE t.weight END AS weight FROM dates, w JOIN t USING (asset)),
inforce AS (SELECT * FROM (SELECT m.day, m.asset, m.ret, last_value(h.weight IGNORE NULLS) OVER (PARTITION BY m.asset ORDER BY m.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight
  FROM mine m LEFT JOIN history h ON h.rebalance_date = m.day AND h.asset = m.asset) WHERE weight IS NOT NULL),
walked AS (SELECT day, 'walkforward_portfolio' AS series, coalesce(sum(ret * weight), 0) AS ret FROM inforce GROUP BY day),
wide AS (PIVOT_PLACEHOLDER),
xy AS (SELECT s.series, s.day, s.ret - 0.04 / 252 AS y, mkt_rf, smb, hml, rmw, cma FROM series s JOIN wide USING (day) WHERE s.ret IS NOT NULL AND mkt_rf IS NOT NULL AND smb IS NOT NULL AND hml IS NOT NULL AND rmw IS NOT NULL AND cma IS NOT NULL),
paths AS (SELECT o_custkey % 100 AS sim_id, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS step, 0.5 + o_totalprice / 100000.0 AS value FROM orders),
steps AS (SELECT *, value / max(value) OVER (PARTITION BY sim_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS fall FROM paths),
ends AS (SELECT sim_id, arg_max(value, step) AS terminal, min(fall) AS max_drawdown FROM steps GROUP BY sim_id)
"""
_R = {a: f"max(ret) FILTER (WHERE asset = '{a}')" for a in BOOK.universe}
_CTE = _CTE.replace("PIVOT_PLACEHOLDER", f"SELECT day, {_R['MKT']} - 0.04 / 252 AS mkt_rf, {_R['SMALL']} - {_R['LARGE']} AS smb, {_R['ECONOMY']} - {_R['PROMO']} AS hml, {_R['STANDARD']} - {_R['MEDIUM']} AS rmw, {_R['PROMO']} - {_R['SMALL']} AS cma FROM rets GROUP BY day")

_TERMINAL = {"mean_terminal_value": "avg(terminal)", "median_terminal_value": "median(terminal)", "p5_terminal_value": "quantile_cont(terminal, 0.05)", "p25_terminal_value": "quantile_cont(terminal, 0.25)", "p75_terminal_value": "quantile_cont(terminal, 0.75)", "p95_terminal_value": "quantile_cont(terminal, 0.95)", "prob_loss": "avg((terminal < 1)::INT::DOUBLE)", "prob_double": "avg((terminal >= 2)::INT::DOUBLE)", "prob_5x": "avg((terminal >= 5)::INT::DOUBLE)"}
_FALLS = {"mean_max_drawdown": "avg(max_drawdown)", "median_max_drawdown": "median(max_drawdown)", "p95_worst_drawdown": "quantile_cont(max_drawdown, 0.05)", "prob_drawdown_30": "avg((max_drawdown <= -0.3)::INT::DOUBLE)", "prob_drawdown_50": "avg((max_drawdown <= -0.5)::INT::DOUBLE)", "prob_drawdown_60": "avg((max_drawdown <= -0.6)::INT::DOUBLE)"}


def _r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def _row(exprs: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{_r(e)} AS {n}" for n, e in exprs.items()) + f" FROM {source}"


def _nine(labels: tuple[str, ...], shown=_r) -> str:
    columns = ("a.annual_return", "a.annual_vol", "(a.annual_return - 0.04) / a.annual_vol", "d.max_drawdown", "v.beta", "v.alpha", "v.correlation", "v.tracking_error", "v.information_ratio")
    one = "FROM ann a JOIN (SELECT series, min(drawdown) AS max_drawdown FROM fall GROUP BY series) d USING (series) JOIN versus v USING (series)"
    return " UNION ALL ".join(f"SELECT series, '{n}' AS metric, {shown(c)} AS value {one}" for n, c in zip(labels, columns, strict=True))


def _stats(w: str) -> str:
    return _STATS.replace("w.weight", f"{w}.weight").replace("FROM w ", f"FROM {w} ").replace("JOIN w ", f"JOIN {w} ")


def _least_squares(x: list[str]) -> str:
    """One row: n, coefficients b0 (constant), b1, ... and their variances v0, v1, ... by Gauss-Jordan steps on the factors' covariances."""
    k = range(len(x))
    known = "SELECT s.ret - 0.04 / 252 AS y, " + ", ".join(x) + " FROM series s JOIN wide USING (day) WHERE s.ret IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in x)
    means = ", ".join(f"avg({x[i]}) AS m{i}, covar_pop(y, {x[i]}) AS y{i}" for i in k)
    cells = [(i, j) for i in k for j in range(2 * len(x))]
    start = ", ".join(f"covar_pop({x[i]}, {x[j]}) AS a{i}_{j}" if j < len(x) else f"{float(i == j - len(x))} AS a{i}_{j}" for i, j in cells)
    sql = f"SELECT count(*)::DOUBLE AS n, avg(y) AS my, var_pop(y) AS vy, {means}, {start} FROM ({known})"
    rest = "n, my, vy, " + ", ".join(f"m{i}, y{i}" for i in k)
    for p in k:
        step = ", ".join((f"a{p}_{j} / a{p}_{p}" if i == p else f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p}") + f" AS a{i}_{j}" for i, j in cells)
        sql = f"SELECT {rest}, {step} FROM ({sql})"
    inverse = {(i, j): f"a{i}_{j + len(x)}" for i in k for j in k}
    sql = f"SELECT *, {', '.join('(' + ' + '.join(f'{inverse[i, j]} * y{j}' for j in k) + f') AS b{i + 1}' for i in k)} FROM ({sql})"
    sql = f"SELECT *, my - {' - '.join(f'b{i + 1} * m{i}' for i in k)} AS b0, n * (vy - {' - '.join(f'b{i + 1} * y{i}' for i in k)}) / (n - {len(x) + 1}) / n AS s2 FROM ({sql})"
    every = " + ".join(f"m{i} * m{j} * {inverse[i, j]}" for i in k for j in k)
    return f"SELECT n, {', '.join(f'b{i}' for i in range(len(x) + 1))}, s2 * (1 + {every}) AS v0, {', '.join(f's2 * {inverse[i, i]} AS v{i + 1}' for i in k)} FROM ({sql})"


def _regression(x: list[str]) -> str:
    """Terms with t statistics; p values by Simpson's rule on Student's density, which is nil past 40."""
    terms, k = ["const", *x], len(x)
    density = f"exp(lgamma((n - {k}) / 2) - lgamma((n - {k + 1}) / 2)) / sqrt((n - {k + 1}) * pi())"
    inside = f"(SELECT sum(CASE WHEN j IN (0, 20000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * pow(1 + j * h * j * h / (n - {k + 1}), -(n - {k}) / 2)) FROM range(0, 20001) s(j))"
    rows = f"SELECT n, unnest({terms}) AS term, unnest([{', '.join(f'b{i}' for i in range(k + 1))}]) AS coef, unnest([{', '.join(f'v{i}' for i in range(k + 1))}]) AS v FROM ({_least_squares(x)})"
    return f"SELECT 'portfolio' AS series, term, {_r('coef')} AS coef, {_r('t')} AS t_stat, {_r(f'1 - 2 * h / 3 * {density} * {inside}')} AS p_value FROM (SELECT *, coef / sqrt(v) AS t, least(abs(coef / sqrt(v)), 40.0) / 20000 AS h FROM ({rows}))"


def _fit(x: list[str]) -> str:
    """Statistics of the fit, from its residuals."""
    k = len(x)
    e = f"SELECT day, y, y - b0 - {' - '.join(f'b{i + 1} * {c}' for i, c in enumerate(x))} AS e FROM xy, ({_least_squares(x)})"
    sums = f"SELECT count(*)::DOUBLE AS n, sum(e * e) AS sse, var_pop(y) * count(*) AS sst, sum(step * step) AS ssd, avg(e * e) AS m2, avg(e * e * e) AS m3, avg(e * e * e * e) AS m4 FROM (SELECT *, e - lag(e) OVER (ORDER BY day) AS step FROM ({e}))"
    ll = "-n / 2 * (ln(2 * pi()) + ln(sse / n) + 1)"
    test = "n / 6 * (m3 * m3 / pow(m2, 3) + pow(m4 / (m2 * m2) - 3, 2) / 4)"
    values = {"r_squared": "1 - sse / sst", "adj_r_squared": f"1 - sse / sst * (n - 1) / (n - {k + 1})", "f_statistic": f"(1 - sse / sst) / {k} / (sse / sst / (n - {k + 1}))", "log_likelihood": ll, "aic": f"{2 * (k + 1)} - 2 * ({ll})", "bic": f"ln(n) * {k + 1} - 2 * ({ll})", "durbin_watson": "ssd / sse", "skew": "m3 / pow(m2, 1.5)", "kurtosis": "m4 / (m2 * m2)", "jarque_bera": test, "jarque_bera_p_value": f"exp(-({test}) / 2)", "observations": "n", "df_model": f"{k}.0", "df_residuals": f"n - {k + 1}"}
    return " UNION ALL ".join(f"SELECT 'portfolio' AS series, '{m}' AS metric, {_r(v)} AS value FROM ({sums})" for m, v in values.items())


#: Shrunk covariances of every rebalance date's sample, the date as key.
_WF_COV = """SELECT rebalance_date AS key, asset_i, asset_j, ((1 - delta) * s + CASE WHEN asset_i = asset_j THEN delta * m ELSE 0 END) * 252 AS cov FROM (
  WITH x AS (SELECT rebalance_date, day, asset, coalesce(ret, 0) - avg(coalesce(ret, 0)) OVER (PARTITION BY rebalance_date, asset) AS x FROM sample),
  parts AS (SELECT rebalance_date, a.asset AS asset_i, b.asset AS asset_j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, count(*) AS n FROM x a JOIN x b USING (rebalance_date, day) GROUP BY 1, 2, 3),
  sums AS (SELECT rebalance_date, count(DISTINCT asset_i)::DOUBLE AS p, sum(s) FILTER (WHERE asset_i = asset_j) / count(DISTINCT asset_i) AS m, sum(s * s) AS ss, sum(q) AS qq, max(n)::DOUBLE AS n FROM parts GROUP BY 1)
  SELECT parts.*, m, least((ss - p * m * m) / p, (qq - ss) / (p * sums.n)) / ((ss - p * m * m) / p) AS delta FROM parts JOIN sums USING (rebalance_date))"""


def _posterior(cov: str) -> str:
    """(key, asset, bl_mu, pi) of covariances (key, asset_i, asset_j, cov): the book's three views by Cramer's rule."""
    views = list(BOOK.absolute_views)
    cells = list(zip("abcdef", [*views, views[0], views[0], views[1]], [*views, views[1], views[2], views[2]], strict=True))
    columns = ", ".join(f"max(cov) FILTER (WHERE asset_j = '{v}') AS c{n}" for n, v in enumerate(views, 1))
    spread = ", ".join(f"max(cov) FILTER (WHERE asset_i = '{x}' AND asset_j = '{y}') * {2 if x == y else 1} AS {n}" for n, x, y in cells)
    gaps = ", ".join(f"max({q} - pi) FILTER (WHERE asset = '{v}') AS r{n}" for n, (v, (q, _)) in enumerate(BOOK.absolute_views.items(), 1))
    moved = "pi + c1 * (r1 * (b * c - f * f) + r2 * (e * f - c * d) + r3 * (d * f - b * e)) / det + c2 * (r1 * (e * f - c * d) + r2 * (a * c - e * e) + r3 * (d * e - a * f)) / det + c3 * (r1 * (d * f - b * e) + r2 * (d * e - a * f) + r3 * (a * b - d * d)) / det"
    return f"""WITH vc AS ({cov}), vp AS (SELECT key, asset_i AS asset, sum(cov * weight) * 2.5 AS pi FROM vc JOIN mw ON mw.asset = asset_j GROUP BY 1, 2)
      SELECT key, asset, {moved} AS bl_mu, pi FROM (SELECT *, a * (b * c - f * f) - d * (d * c - e * f) + e * (d * f - b * e) AS det FROM
        (SELECT key, asset_i AS asset, {columns} FROM vc GROUP BY 1, 2) JOIN vp USING (key, asset) JOIN (SELECT key, {spread} FROM vc GROUP BY 1) USING (key) JOIN (SELECT key, {gaps} FROM vp GROUP BY 1) USING (key))"""


def _optimum(cov: str, sharpe: bool = True, bounds=(0.0, 1.0), fixed=None, minimum=None, sweeps: int = 200) -> str:
    """(key, w, value, before): the best weights for covariances by key and their posterior means, by exchanges.

    Weight moves between two assets at a time, all pairs in turn, each time by the best
    step that the rules leave: for the Sharpe ratio (a + b x) / sqrt(c + 2 d x + e x x)
    that is (b c - a d) / (a e - b d), for the variance -d / e. `before` is the value a
    sweep earlier.
    """
    n, fixed, minimum = len(BOOK.assets), fixed or {}, minimum or {}
    low = [fixed.get(x, minimum.get(x, bounds[0])) for x in BOOK.assets]
    high = [fixed.get(x, bounds[1]) for x in BOOK.assets]
    room = sum(high) - sum(low)
    start = [lo + (1 - sum(low)) * (hi - lo) / room for lo, hi in zip(low, high, strict=True)]
    pairs = [(i + 1, j + 1) for i in range(n) for j in range(i)]
    at = f"(k % {len(pairs)}) + 1"
    order = ", ".join(f"'{x}'" for x in BOOK.assets)
    step = "CASE WHEN a * e - b * d > 0 THEN (b * c - a * d) / (a * e - b * d) WHEN b * c > a * d THEN 1e9 ELSE -1e9 END" if sharpe else "-d / e"
    value = "list_dot_product(m, w) / sqrt(list_dot_product(w, list_transform(s, lambda r: list_dot_product(r, w))))" if sharpe else "sqrt(list_dot_product(w, list_transform(s, lambda r: list_dot_product(r, w))))"
    return f"""WITH RECURSIVE vcov AS MATERIALIZED ({cov}), vmu AS MATERIALIZED ({_posterior(cov)}),
      data AS MATERIALIZED (SELECT key, m, s FROM (SELECT key, list(bl_mu - 0.04 ORDER BY list_position([{order}], asset)) AS m FROM vmu GROUP BY 1)
        JOIN (SELECT key, list(r ORDER BY list_position([{order}], asset_i)) AS s FROM (SELECT key, asset_i, list(cov ORDER BY list_position([{order}], asset_j)) AS r FROM vcov GROUP BY 1, 2) GROUP BY 1) USING (key)),
      go AS (SELECT key, m, s, 0 AS k, {start}::DOUBLE[] AS w FROM data
        UNION ALL SELECT key, m, s, k + 1, list_transform(w, lambda x, t: x + CASE WHEN t = i THEN x_ WHEN t = j THEN -x_ ELSE 0 END) FROM (
          SELECT *, greatest(least({step}, {high}[i] - w[i], w[j] - {low}[j]), {low}[i] - w[i], w[j] - {high}[j]) AS x_ FROM (
            SELECT *, list_dot_product(m, w) AS a, m[i] - m[j] AS b, list_dot_product(w, cw) AS c, cw[i] - cw[j] AS d, s[i][i] + s[j][j] - 2 * s[i][j] AS e FROM (
              SELECT *, {[i for i, _ in pairs]}[{at}] AS i, {[j for _, j in pairs]}[{at}] AS j, list_transform(s, lambda r: list_dot_product(r, w)) AS cw FROM go WHERE k < {sweeps * len(pairs)}))))
      SELECT key, max(w) FILTER (WHERE k = {sweeps * len(pairs)}) AS w, max({value}) FILTER (WHERE k = {sweeps * len(pairs)}) AS value, max({value}) FILTER (WHERE k = {(sweeps - 1) * len(pairs)}) AS before FROM go WHERE k >= {(sweeps - 1) * len(pairs)} GROUP BY key"""


def _frontier(points: int, bounds: tuple[float, float], sweeps: int = 150) -> str:
    """(point_id, target_ret, vol): least deviation for each reachable target, by exchanges of three.

    Moving weight along (m_j - m_l, m_l - m_i, m_i - m_j) leaves the sum and the return as
    they are, and all such moves together reach every portfolio that has both. The start
    lies between the portfolios of least and of greatest return, filled up in their order.
    """
    n = len(BOOK.assets)
    order = ", ".join(f"'{x}'" for x in BOOK.assets)
    triples = [(i + 1, j + 1, h + 1) for i in range(n) for j in range(i) for h in range(j)]
    at = f"(k % {len(triples)}) + 1"
    fill = [min(bounds[1] - bounds[0], max(0.0, 1 - n * bounds[0] - r * (bounds[1] - bounds[0]))) + bounds[0] for r in range(n)]
    most = ", ".join(f"CASE WHEN d[{t}] > 0 THEN ({bounds[1]} - w[{v}]) / d[{t}] WHEN d[{t}] < 0 THEN ({bounds[0]} - w[{v}]) / d[{t}] ELSE 1e9 END" for t, v in zip((1, 2, 3), "ijh", strict=True))
    least = ", ".join(f"CASE WHEN d[{t}] > 0 THEN ({bounds[0]} - w[{v}]) / d[{t}] WHEN d[{t}] < 0 THEN ({bounds[1]} - w[{v}]) / d[{t}] ELSE -1e9 END" for t, v in zip((1, 2, 3), "ijh", strict=True))
    cov = "SELECT 0 AS key, * FROM cov"
    return f"""WITH RECURSIVE vmu AS MATERIALIZED ({_posterior(cov)}),
      ends AS (SELECT list(lo ORDER BY p) AS lo, list(hi ORDER BY p) AS hi, list(bl_mu ORDER BY p) AS m, sum(lo * bl_mu) AS r_lo, sum(hi * bl_mu) AS r_hi, min(bl_mu) AS least, max(bl_mu) AS most FROM (
        SELECT list_position([{order}], asset) AS p, bl_mu, {fill}[row_number() OVER (ORDER BY bl_mu)] AS lo, {fill}[row_number() OVER (ORDER BY bl_mu DESC)] AS hi FROM vmu)),
      data AS MATERIALIZED (SELECT m, s, point_id, t, list_transform(lo, lambda x, i: x + (hi[i] - x) * (t - r_lo) / (r_hi - r_lo)) AS w FROM (SELECT *, least + (most - least) * point_id / {points - 1} AS t FROM ends, range(0, {points}) r(point_id)),
        (SELECT list(r ORDER BY list_position([{order}], asset_i)) AS s FROM (SELECT asset_i, list(cov ORDER BY list_position([{order}], asset_j)) AS r FROM cov GROUP BY 1)) WHERE t BETWEEN r_lo AND r_hi),
      go AS (SELECT point_id, t, m, s, 0 AS k, w FROM data
        UNION ALL SELECT point_id, t, m, s, k + 1, list_transform(w, lambda x, v: x + x_ * CASE WHEN v = i THEN d[1] WHEN v = j THEN d[2] WHEN v = h THEN d[3] ELSE 0 END) FROM (
          SELECT *, greatest(least(-(d[1] * cw[i] + d[2] * cw[j] + d[3] * cw[h]) / greatest(q, 1e-300), {most}), {least}) AS x_ FROM (
            SELECT *, d[1] * d[1] * s[i][i] + d[2] * d[2] * s[j][j] + d[3] * d[3] * s[h][h] + 2 * (d[1] * d[2] * s[i][j] + d[1] * d[3] * s[i][h] + d[2] * d[3] * s[j][h]) AS q FROM (
              SELECT *, [m[j] - m[h], m[h] - m[i], m[i] - m[j]] AS d, list_transform(s, lambda r: list_dot_product(r, w)) AS cw FROM (
                SELECT *, {[t[0] for t in triples]}[{at}] AS i, {[t[1] for t in triples]}[{at}] AS j, {[t[2] for t in triples]}[{at}] AS h FROM go WHERE k < {sweeps * len(triples)})))))
      SELECT point_id, t AS target_ret, sqrt(list_dot_product(w, list_transform(s, lambda r: list_dot_product(r, w)))) AS vol FROM go WHERE k = {sweeps * len(triples)}"""


def _optimality(sharpe: bool, bounds, fixed=None, minimum=None) -> str:
    """What the optimality queries say, of the optimum that SQL finds by itself."""
    fixed, minimum = fixed or {}, minimum or {}
    low = [fixed.get(x, minimum.get(x, bounds[0])) for x in BOOK.assets]
    high = [fixed.get(x, bounds[1]) for x in BOOK.assets]
    within = " AND ".join(f"w[{i + 1}] BETWEEN {lo} - 2e-4 AND {hi} + 2e-4" for i, (lo, hi) in enumerate(zip(low, high, strict=True)))
    return f"SELECT abs(list_sum(w) - 1) < 1e-3 AS sums_to_one, {within} AS within_rules, abs(value - before) < 1e-9 AS no_gain, round(value, 4) + 0.0 AS value FROM ({_optimum('SELECT 0 AS key, * FROM cov', sharpe, bounds, fixed, minimum)})"


_STATS = "(SELECT sum(w.weight * mu) AS er FROM w JOIN mu USING (asset)), (SELECT sqrt(sum(a.weight * b.weight * cov)) AS vol FROM cov JOIN w a ON a.asset = asset_i JOIN w b ON b.asset = asset_j)"
_SHARES = "[0.0, 0.001, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]::DOUBLE[]"
_LINES = ", ".join(f"({i}, '{x}')" for i, x in enumerate(FACTOR_TEXT))

_SQL = {
    "prices_vwap": f"SELECT day, asset, {_r('close')} AS close FROM prices",
    "prices_densified": f"SELECT day, asset, {_r('close')} AS close FROM panel",
    "returns_daily": f"SELECT day, loc, asset, {_r('ret')} AS ret FROM rets",
    "annualized_mean": f"SELECT asset, {_r('mu')} AS mu FROM mu",
    "sample_cov": f"SELECT a.asset AS asset_i, b.asset AS asset_j, {_r('covar_samp(a.ret, b.ret) * 252')} AS cov FROM mine a JOIN mine b USING (day) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2",
    "lw_moments": f"SELECT asset_i, asset_j, {_r('s * 1e4')} AS s, {_r('q * 1e8')} AS q, n FROM parts",
    "lw_delta": f"SELECT {_r('m * 1e4')} AS m, {_r('delta')} AS delta FROM level",
    "lw_cov": f"SELECT asset_i, asset_j, {_r('cov')} AS cov FROM cov",
    "implied_returns": f"SELECT asset, {_r('pi')} AS pi FROM pi",
    "bl_single_view": f"SELECT p.asset, {_r('p.pi + c.cov / (2 * k.cov) * (0.12 - v.pi)')} AS bl_mu, {_r('p.pi')} AS pi FROM pi p JOIN cov c ON c.asset_i = p.asset AND c.asset_j = 'LARGE', (SELECT cov FROM cov WHERE asset_i = 'LARGE' AND asset_j = 'LARGE') k, (SELECT pi FROM pi WHERE asset = 'LARGE') v",
    "mu_compare": f"SELECT asset, {_r('mu')} AS hist_mu, {_r('pi')} AS pi, {_r('all_mu')} AS all_mu FROM mu FULL JOIN pi USING (asset) FULL JOIN (SELECT asset, avg(ret) * 252 AS all_mu FROM rets GROUP BY asset) USING (asset)",
    "portfolio_series": f"SELECT day, series, {_r('ret')} AS ret FROM series",
    "portfolio_stats": f"SELECT {_r('er')} AS expected_return, {_r('vol')} AS volatility, {_r('(er - 0.04) / vol')} AS sharpe FROM {_STATS}",
    "cumulative_growth": f"SELECT day, series, {_r('ret')} AS ret, {_r('value')} AS value FROM grown",
    "drawdown_path": f"SELECT day, {_r('value')} AS value, {_r('drawdown')} AS drawdown FROM fall",
    "max_drawdown": f"SELECT series, {_r('min(drawdown)')} AS max_drawdown FROM fall GROUP BY series",
    "annualized_return": f"SELECT series, {_r('annual_return')} AS annual_return FROM ann",
    "annualized_vol": f"SELECT series, {_r('annual_vol')} AS annual_vol FROM ann",
    "sharpe": f"SELECT series, {_r('(annual_return - 0.04) / annual_vol')} AS sharpe FROM ann",
    "beta_alpha": "SELECT series, " + ", ".join(f"{_r(c)} AS {c}" for c in ("beta", "alpha", "correlation", "tracking_error", "information_ratio")) + " FROM versus",
    "summary_table": _nine(performance.SUMMARY),
    "current_performance": _nine(performance.CURRENT),
    "risk_contribution": f"SELECT asset, weight, {_r('cw / vol')} AS marginal, {_r('weight * cw / vol')} AS component, {_r('weight * cw / vol / vol')} AS percent FROM (SELECT asset, weight, cw, sqrt(sum(weight * cw) OVER ()) AS vol FROM (SELECT a.asset, a.weight, sum(cov * b.weight) AS cw FROM cov JOIN t a ON a.asset = asset_i JOIN t b ON b.asset = asset_j GROUP BY 1, 2))",
    "weight_changes": f"SELECT asset, current, target, {_r('target - current')} AS change, CASE WHEN target - current > 0.005 THEN 'Increase' WHEN target - current < -0.005 THEN 'Decrease' ELSE 'Hold' END AS action FROM both_w",
    "trade_sheet": f"SELECT asset, current, target, {_r('target - current')} AS trade, CASE WHEN target > current THEN 'Buy' WHEN target < current THEN 'Sell' ELSE 'Hold' END AS action FROM both_w",
    "turnover": f"SELECT {_r('sum(abs(target - current))')} AS turnover FROM both_w",
    "impl_cost": f"SELECT {_r('sum(abs(target - current)) * 15 / 10000')} AS cost FROM both_w",
    "tax_drag": f"SELECT {_r('sum(greatest(current - target, 0) * 0.2) * 0.25')} AS tax FROM both_w",
    "net_return": f"SELECT 0.1::DOUBLE AS gross_expected_return, {_r('m * 15 / 10000')} AS implementation_cost, {_r('x')} AS tax_drag, {_r('0.1 - m * 15 / 10000 - x')} AS net_expected_return, {_r('m')} AS turnover FROM (SELECT sum(abs(target - current)) AS m, sum(greatest(current - target, 0) * 0.2) * 0.25 AS x FROM both_w)",
    "mu_penalized": f"SELECT asset, {_r('mu - 0.5 * (1 - weight) * 0.01')} AS mu FROM mu JOIN w USING (asset)",
    "normalize_weights": f"SELECT 'days' AS portfolio, asset, {_r('count(close)::DOUBLE / sum(count(close)) OVER ()')} AS weight FROM prices GROUP BY asset",
    "rolling_stats": f"""SELECT day, {_r('avg(m)')} AS "return", {_r('CASE WHEN count(v) = count(*) THEN sqrt(avg(v)) END')} AS vol FROM (SELECT day, loc, avg(ret) OVER r * 252 AS m, var_samp(ret) OVER r * 252 AS v FROM mine WINDOW r AS (PARTITION BY asset ORDER BY loc ROWS BETWEEN 1260 PRECEDING AND 1 PRECEDING)) WHERE loc >= 1260 GROUP BY day""",
    "rebalance_dates": "SELECT DISTINCT day FROM mine WHERE day = last_day(day)",
    "eligible_dates": "SELECT rebalance_date, loc FROM dates",
    "wf_window_moments": f"SELECT rebalance_date, a.asset AS asset_i, b.asset AS asset_j, {_r('covar_samp(a.ret, b.ret) * 252')} AS cov FROM sample a JOIN sample b USING (rebalance_date, day) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3",
    "wf_window_mean": f"SELECT rebalance_date, asset, {_r('avg(ret) * 252')} AS mu FROM sample GROUP BY 1, 2",
    "asof_weights": "SELECT day, asset, weight FROM inforce",
    "wf_series_fixed_policy": f"SELECT day, series, {_r('ret')} AS ret FROM walked",
    "growth_frame": f"SELECT day, {_r('a.value')} AS portfolio, {_r('b.value')} AS \"MKT\", {_r('c.value')} AS walkforward_portfolio FROM grown a FULL JOIN (SELECT day, CASE WHEN ret IS NOT NULL THEN product(1 + ret) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS value FROM bench) b USING (day) LEFT JOIN (SELECT day, product(1 + ret) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM walked) c USING (day)",
    "ff_single_factor": f"SELECT series, {_r('regr_slope(y, mkt_rf)')} AS slope, {_r('regr_intercept(y, mkt_rf)')} AS intercept, count(*) AS n FROM xy GROUP BY series",
    "factor_gram": "SELECT series, count(*) AS n, " + ", ".join(f"{_r(f'sum({a} * {b}) * 100')} AS {a}__{b}" for a, b in (("mkt_rf", "mkt_rf"), ("mkt_rf", "smb"), ("mkt_rf", "y"), ("smb", "y"), ("y", "y"))) + " FROM xy GROUP BY series",
    "benchmark_point": f"SELECT {_r('avg(ret) * 252')} AS ret, {_r('stddev_samp(ret) * sqrt(252)')} AS vol FROM bench",
    "frontier_targets": f"SELECT i AS point_id, {_r('lo + (hi - lo) * i / 49')} AS target_ret FROM (SELECT min(mu) AS lo, max(mu) AS hi FROM mu), range(0, 50) r(i)",
    "universe_dedup": "SELECT asset, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS asset_ord FROM (SELECT asset, min(i) AS first FROM (VALUES " + ", ".join(f"('{a}', {i})" for i, a in enumerate([*BOOK.assets, "MKT", "MKT", "SMALL"])) + ") x(asset, i) GROUP BY asset)",
    "benchmark_on_days": f"SELECT day, 'MKT' AS series, {_r('ret')} AS ret FROM bench SEMI JOIN walked USING (day)",
    "stored_quotes": f"SELECT CAST(ts AS DATE) AS day, event_type AS asset, {_r('value')} AS close FROM events WHERE event_type IN ('click', 'purchase', 'view') AND ts >= TIMESTAMP '{QUOTES[0]}' AND ts < TIMESTAMP '{QUOTES[1]}'",
    "printed_summary": _nine(performance.SUMMARY, lambda c: f"round_even({c}, 4) + 0.0"),
    "equal_weights": f"SELECT day, 'portfolio' AS series, {_r(f'coalesce(sum(ret / {len(BOOK.assets)}), 0)')} AS ret FROM mine GROUP BY day",
    "wf_shrunk_cov": f"SELECT key AS rebalance_date, asset_i, asset_j, {_r('cov')} AS cov FROM ({_WF_COV})",
    "diagnostics_fixed_policy": f"""SELECT rebalance_date, {_r('er')} AS expected_return, {_r('vol')} AS volatility, {_r('(er - 0.04) / vol')} AS sharpe, {_r('turnover')} AS turnover FROM
      (SELECT rebalance_date, sum(weight * mu) AS er FROM history JOIN (SELECT rebalance_date, asset, avg(ret) * 252 AS mu FROM sample GROUP BY 1, 2) USING (rebalance_date, asset) GROUP BY 1)
      JOIN (SELECT c.rebalance_date, sqrt(sum(a.weight * b.weight * cov)) AS vol FROM (SELECT rebalance_date, a.asset AS i, b.asset AS j, covar_samp(a.ret, b.ret) * 252 AS cov FROM sample a JOIN sample b USING (rebalance_date, day) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3) c
        JOIN history a ON a.rebalance_date = c.rebalance_date AND a.asset = i JOIN history b ON b.rebalance_date = c.rebalance_date AND b.asset = j GROUP BY 1) USING (rebalance_date)
      JOIN (SELECT rebalance_date, sum(abs(weight - prev)) AS turnover FROM (SELECT h.rebalance_date, h.weight, coalesce(lag(h.weight) OVER (PARTITION BY h.asset ORDER BY rebalance_date), w.weight) AS prev FROM history h JOIN w USING (asset)) GROUP BY 1) USING (rebalance_date)""",
    "cml_given_frontier": f"SELECT {_r('x')} AS x, {_r('0.04 + (er - 0.04) / vol * x')} AS y FROM (SELECT er, vol, unnest([0.0::DOUBLE, far * 1.1]) AS x FROM {_stats('t')}, (SELECT greatest(max(v), max(b)) AS far FROM (SELECT stddev_samp(ret) * sqrt(252) AS v FROM mine GROUP BY asset), (SELECT stddev_samp(ret) * sqrt(252) AS b FROM bench)))",
    "bl_posterior": f"SELECT asset, {_r('bl_mu')} AS bl_mu, {_r('pi')} AS pi FROM ({_posterior('SELECT 0 AS key, * FROM cov')})",
    "ff3_regression": _regression(["mkt_rf", "smb", "hml"]),
    "ff5_regression": _regression(["mkt_rf", "smb", "hml", "rmw", "cma"]),
    "factor_fit": _fit(["mkt_rf", "smb", "hml", "rmw", "cma"]),
    "market_weights": f"SELECT 'market' AS portfolio, p_type AS asset, {_r('sum(v)::DOUBLE / sum(sum(v)) OVER ()')} AS weight FROM (SELECT p_type, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY p_type",
    "latest_weights": "SELECT * FROM history WHERE rebalance_date = (SELECT max(rebalance_date) FROM history)",
    "last5_diag": "SELECT rebalance_date, loc FROM dates ORDER BY rebalance_date DESC LIMIT 5",
    "turnover_history": f"SELECT rebalance_date, {_r('sum(abs(h.weight - h.prev))')} AS turnover FROM (SELECT h.rebalance_date, h.weight, coalesce(lag(h.weight) OVER (PARTITION BY h.asset ORDER BY rebalance_date), w.weight) AS prev FROM history h JOIN w USING (asset)) h GROUP BY 1",
    "mc_stats_from_paths": _row(_TERMINAL, "ends"),
    "drawdown_stats_from_paths": _row(_FALLS, "ends"),
    "mc_report_from_paths": " UNION ALL ".join(f"SELECT '{n}' AS metric, {_r((_TERMINAL | _FALLS)[c])} AS value FROM ends" for n, c in montecarlo.REPORT.items()),
    "price_quantiles": f"SELECT unnest(s) AS share, {_r('unnest(p)')} AS price, {_r('unnest(q)')} AS quantity FROM (SELECT {_SHARES} AS s, quantile_cont(l_extendedprice::DOUBLE, {_SHARES}) AS p, quantile_cont(l_quantity::DOUBLE, {_SHARES}) AS q FROM lineitem)",
    "print_weights": "SELECT asset_ord::INT AS asset_ord, printf('%5s: %5.2f%%', asset, weight * 100) AS line FROM w",
    "optimized_summary": "SELECT asset, weight FROM t",
    "kf_parse": f"""SELECT strptime(f[1], '%Y%m%d')::DATE AS day, {', '.join(f"{_r(f'f[{i + 2}]::DOUBLE / 100')} AS {c}" for i, c in enumerate(FF5))} FROM (
      SELECT *, max(CASE WHEN begun AND NOT goes THEN 1 ELSE 0 END) OVER o AS ended FROM (
        SELECT *, max(starts::INT) OVER o = 1 AS begun FROM (
          SELECT n, list_transform(string_split(trim(x), ','), lambda y: trim(y)) AS f, regexp_matches(substr(trim(x), 1, 8), '^[0-9]+$') AS starts, regexp_matches(trim(string_split(trim(x), ',')[1]), '^[0-9]+$') AS goes FROM (VALUES {_LINES}) l(n, x))
        WINDOW o AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      WINDOW o AS (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE begun AND ended = 0 AND len(f) >= 7""",
}


_HELD = f"""held AS (SELECT year(l_shipdate) % 2 AS half, p_type AS asset, list_position([{', '.join(f"'{a}'" for a in BOOK.assets)}], p_type) - 1 AS asset_ord, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
  ew AS (SELECT asset, asset_ord, v / sum(v) OVER () AS weight FROM held WHERE half = 0), ow AS (SELECT asset, asset_ord, v / sum(v) OVER () AS weight FROM held WHERE half = 1),
  both_h AS (SELECT asset, ew.asset_ord, ew.weight AS current, ow.weight AS target FROM ew JOIN ow USING (asset))"""


for _name in ("weight_changes", "trade_sheet", "turnover", "impl_cost", "tax_drag", "net_return"):
    _two = f"* REPLACE ({_r('current')} AS current, {_r('target')} AS target)" if _name in ("weight_changes", "trade_sheet") else "*"
    _SQL[f"held_{_name}"] = f"WITH {_HELD} SELECT {_two} FROM ({_SQL[_name].replace('both_w', 'both_h')})"
_SQL |= {
    "held_print_weights": f"WITH {_HELD} SELECT asset_ord::INT AS asset_ord, printf('%5s: %5.2f%%', asset, weight * 100) AS line FROM ew",
    "held_summary_weights": f"WITH {_HELD} SELECT asset, {_r('weight')} AS weight FROM ow",
    "held_summary": f"WITH {_HELD}, s AS (SELECT er, vol FROM {_stats('ow')}) SELECT 'Expected Return' AS metric, {_r('er')} AS value FROM s UNION ALL SELECT 'Volatility', {_r('vol')} FROM s UNION ALL SELECT 'Sharpe Ratio', {_r('(er - 0.04) / vol')} FROM s",
    "factors_from_file": f"SELECT day, {', '.join(_r(f'round({c} * 100, 4) / 100') + f' AS {c}' for c in FF5[:-1])}, {_r('round(0.04 / 252 * 100, 4) / 100')} AS rf FROM wide WHERE {' AND '.join(f'{c} IS NOT NULL' for c in FF5[:-1])}",
    "report_written": _SQL["drawdown_path"],
    "rebalance_dates_trading": "SELECT max(day) AS day FROM mine GROUP BY last_day(day)",
    "returns_unpadded": f"""SELECT day, loc, asset, {_r('ret')} AS ret FROM (
      WITH gaps AS (SELECT * FROM prices WHERE date_diff('day', DATE '1970-01-01', day) % 7 <> length(asset) % 7),
      gp AS (SELECT d.day, u.asset, p.close FROM (SELECT DISTINCT day FROM gaps) d CROSS JOIN (VALUES {_UNIVERSE}) u(asset) LEFT JOIN gaps p ON p.day = d.day AND p.asset = u.asset),
      gc AS (SELECT day, asset, close / lag(close) OVER (PARTITION BY asset ORDER BY day) - 1 AS ret FROM gp),
      gd AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS loc FROM (SELECT DISTINCT day FROM gc WHERE ret IS NOT NULL))
      SELECT gc.*, loc FROM gc JOIN gd USING (day))""",
    "series_next_day": f"""SELECT day, 'walkforward_portfolio' AS series, {_r('coalesce(sum(ret * weight), 0)')} AS ret FROM (SELECT m.day, m.ret, last_value(h.weight IGNORE NULLS) OVER (PARTITION BY m.asset ORDER BY m.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS weight
      FROM mine m LEFT JOIN history h ON h.rebalance_date = m.day AND h.asset = m.asset) WHERE weight IS NOT NULL GROUP BY day""",
    "drawdown_from_start": f"SELECT day, {_r('value / greatest(max(value) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) - 1')} AS drawdown FROM grown",
    "alpha_over_rf": f"SELECT series, {_r('alpha - 0.04 * (1 - beta)')} AS alpha FROM versus",
    "series_reweighted": f"SELECT day, 'portfolio' AS series, {_r('coalesce(sum(ret * weight) * sum(weight) / sum(weight) FILTER (WHERE ret IS NOT NULL), 0)')} AS ret FROM mine JOIN w USING (asset) GROUP BY day",
    "loss_against_start": _row({"prob_loss": "avg((terminal < 1.5)::INT::DOUBLE)", "prob_double": "avg((terminal >= 3)::INT::DOUBLE)", "prob_5x": "avg((terminal >= 7.5)::INT::DOUBLE)"}, "ends"),
}
_SQL["maintained_cov"], _SQL["maintained_lw_cov"] = _SQL["sample_cov"], _SQL["lw_cov"]
_SQL["factor_file"] = _SQL["kf_parse"]
_SQL["path_names"] = "SELECT sim_id, 'sim_' || (sim_id + 1) AS sim, count(*) AS steps FROM paths GROUP BY sim_id"
_SQL["max_sharpe_optimality"] = _optimality(True, BOOK.bounds, BOOK.fixed, BOOK.minimum)
_SQL["max_sharpe_unconstrained_optimality"] = _optimality(True, (0.0, 1.0))
_SQL["min_vol_optimality"] = _optimality(False, BOOK.bounds)
_SQL["frontier_points"] = f"SELECT point_id, {_r('target_ret')} AS target_ret, round(vol, 5) + 0.0 AS vol FROM ({_frontier(P.frontier_points, BOOK.bounds)})"
_SQL["walkforward_sharpe"] = f"SELECT key AS rebalance_date, round(value, 4) + 0.0 AS value FROM ({_optimum(_WF_COV, True, BOOK.bounds, BOOK.fixed, BOOK.minimum)})"


def oracle_sql() -> dict[str, str]:
    """Each query's SQL; tables of its own come after the common ones."""
    return {name: f"{_CTE.rstrip()},\n{sql[5:]}" if sql.startswith("WITH held") else f"{_CTE}\n{sql}" for name, sql in _SQL.items()}
