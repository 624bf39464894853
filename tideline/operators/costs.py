"""Turnover, trading cost, tax and the reports that compare two sets of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_weights(current: DataFrame, target: DataFrame) -> DataFrame:
    """(asset, asset_ord, current, target), missing weights as 0."""
    c = current.select("asset", F.col("asset_ord").alias("c_ord"), F.col("weight").alias("current"))
    t = target.select("asset", F.col("asset_ord").alias("t_ord"), F.col("weight").alias("target"))
    return c.join(t, "asset", "full_outer").select("asset", F.coalesce("c_ord", "t_ord").alias("asset_ord"), F.coalesce("current", F.lit(0.0)).alias("current"), F.coalesce("target", F.lit(0.0)).alias("target"))


def _moved() -> Column:
    return F.sum(F.abs(F.col("target") - F.col("current")))


def turnover(both: DataFrame) -> DataFrame:
    """(turnover): sum of absolute changes, buys and sells alike."""
    return both.agg(_moved().alias("turnover"))


def cost_rate(both: DataFrame, cost_bps: float = 10, slippage_bps: float = 5) -> DataFrame:
    return both.agg((_moved() * ((cost_bps + slippage_bps) / 10_000)).alias("cost"))


def _tax(gain: float | None, short: float, long: float, share: float) -> Column:
    if gain is None:
        return F.lit(0.0)
    sold = F.greatest(F.col("current") - F.col("target"), F.lit(0.0))
    return F.sum(sold * max(gain, 0.0)) * (share * long + (1 - share) * short)


def tax_drag(both: DataFrame, gain: float | None = 0.20, short: float = 0.35, long: float = 0.15, share: float = 0.5) -> DataFrame:
    """(tax): gains of what is sold, at the mixed rate of short and long holdings."""
    return both.agg(_tax(gain, short, long, share).alias("tax"))


def net_return(both: DataFrame, gross: float, cost_bps: float = 10, slippage_bps: float = 5, gain: float | None = 0.20, short: float = 0.35, long: float = 0.15, share: float = 0.5) -> DataFrame:
    """One row: gross_expected_return, implementation_cost, tax_drag, net_expected_return, turnover."""
    one = both.agg(_moved().alias("turnover"), _tax(gain, short, long, share).alias("tax_drag"))
    cost = F.col("turnover") * ((cost_bps + slippage_bps) / 10_000)
    return one.select(F.lit(gross).alias("gross_expected_return"), cost.alias("implementation_cost"), "tax_drag", (F.lit(gross) - cost - F.col("tax_drag")).alias("net_expected_return"), "turnover")


def penalized_mu(mu: DataFrame, current: DataFrame, penalty: float = 0.5, value: str = "mu") -> DataFrame:
    """(asset, mu) less penalty * (1 - weight) * 1 %: dear for small holdings. A missing side gives null."""
    j = mu.select("asset", F.col(value).alias("m")).join(current.select("asset", "weight"), "asset", "full_outer")
    return j.select("asset", (F.col("m") - penalty * (1 - F.col("weight")) * 0.01).alias("mu"))


def implementation_layer(mu: DataFrame, current: DataFrame, on: bool, penalty: float = 0.5) -> DataFrame:
    return penalized_mu(mu, current, penalty) if on else mu.select("asset", "mu")


def weight_changes(both: DataFrame, threshold: float = 0.005) -> DataFrame:
    """Changes in falling order, with Increase or Decrease strictly over the threshold, else Hold."""
    change = F.col("target") - F.col("current")
    action = F.when(change > threshold, "Increase").when(change < -threshold, "Decrease").otherwise("Hold")
    out = both.select("asset", "asset_ord", "current", "target", change.alias("change"), action.alias("action"))
    return out.orderBy(F.desc_nulls_last("change"), "asset_ord").drop("asset_ord")


def trade_sheet(both: DataFrame) -> DataFrame:
    """Trades in the order of the universe; any change is a Buy or a Sell."""
    trade = F.col("target") - F.col("current")
    action = F.when(trade > 0, "Buy").when(trade < 0, "Sell").otherwise("Hold")
    return both.select("asset_ord", "asset", "current", "target", trade.alias("trade"), action.alias("action")).orderBy("asset_ord").drop("asset_ord")


def optimized_summary(weights: DataFrame, stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weights from the greatest down, (metric, value) of expected return, volatility and Sharpe ratio)."""
    table = stats.select(F.col("expected_return").alias("Expected Return"), F.col("volatility").alias("Volatility"), F.col("sharpe").alias("Sharpe Ratio"))
    return weights.orderBy(F.desc_nulls_last("weight"), "asset_ord").select("asset", "weight"), table.unpivot([], [F.col(f"`{c}`") for c in table.columns], "metric", "value")


def weight_lines(weights: DataFrame) -> DataFrame:
    """(asset_ord, line): printed weights, name to 5 and percentage to 6 places."""
    return weights.select("asset_ord", F.format_string("%5s: %5.2f%%", "asset", F.col("weight") * 100).alias("line"))
