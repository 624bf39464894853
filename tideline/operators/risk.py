"""Model statistics of a portfolio and the risk that each asset brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quadratic(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(asset, weight, cov_w): for each asset the covariance with the whole portfolio."""
    wj = weights.select(F.col("asset").alias("asset_j"), F.col("weight").alias("wj"))
    rows = cov.join(F.broadcast(wj), "asset_j").groupBy(F.col("asset_i").alias("asset")).agg(F.sum(F.col("cov") * F.col("wj")).alias("cov_w"))
    return rows.join(F.broadcast(weights), "asset")


def expected_return(weights: DataFrame, mu: DataFrame) -> DataFrame:
    return weights.join(mu, "asset").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"))


def volatility(weights: DataFrame, cov: DataFrame) -> DataFrame:
    return quadratic(weights, cov).agg(F.sqrt(F.sum(F.col("weight") * F.col("cov_w"))).alias("volatility"))


def portfolio_stats(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.04) -> DataFrame:
    """One row: expected_return, volatility and sharpe (null at no volatility)."""
    one = quadratic(weights, cov).join(mu, "asset").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"), F.sqrt(F.sum(F.col("weight") * F.col("cov_w"))).alias("volatility"))
    return one.withColumn("sharpe", F.try_divide(F.col("expected_return") - rf, F.col("volatility")))


def sharpe(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.04) -> DataFrame:
    return portfolio_stats(weights, mu, cov, rf).select("sharpe")


def risk_contribution(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """Marginal, component and percent contribution of each asset, from the greatest down."""
    rows = quadratic(weights, cov)
    vol = rows.agg(F.sqrt(F.sum(F.col("weight") * F.col("cov_w"))).alias("vol"))
    marginal = F.try_divide("cov_w", "vol")
    out = rows.join(F.broadcast(vol)).select("asset", "asset_ord", "weight", marginal.alias("marginal"), (F.col("weight") * marginal).alias("component"), F.try_divide(F.col("weight") * marginal, F.col("vol")).alias("percent"))
    return out.orderBy(F.desc_nulls_last("percent"), "asset_ord").drop("asset_ord")
