"""Walk-forward backtest: rolling estimation, rebalanced targets, realised out-of-sample series."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.config import ModelParams, Portfolio
from tideline.functions.small import settle
from tideline.kernels import qp
from tideline.operators.bayes import square, view_returns
from tideline.operators.optimize import positions
from tideline.operators.returns import asset_weights
from tideline.operators.rolling import eligible_dates, history_series, window_moments

_TARGETS = "rebalance_date date, asset string, asset_ord int, weight double, expected_return double, volatility double"


@dataclass(frozen=True)
class Backtest:
    """series (day, series, ret), weights (rebalance_date, asset, asset_ord, weight) and diagnostics by date."""

    series: DataFrame
    weights: DataFrame
    diagnostics: DataFrame


def _target(assets, hist_mu, cov, book: Portfolio, p: ModelParams, current) -> tuple[np.ndarray, float, float]:
    """(weights, expected return, volatility) of one date; the return is that before any penalty."""
    mu = hist_mu
    if p.use_black_litterman:
        views = {assets.index(a): v for a, v in view_returns(book.absolute_views).items()}
        mu, _ = qp.posterior(cov, [book.market[a] for a in assets], p.risk_aversion, p.tau, views)
    goal = mu - p.turnover_lambda * (1 - current) * 0.01 if p.implementation_layer else mu
    w = qp.max_sharpe(goal, cov, p.risk_free, book.bounds, positions(book.fixed, assets), positions(book.minimum, assets))
    return w, float(w @ mu), float(np.sqrt(w @ cov @ w))


def walk_forward(returns: DataFrame, book: Portfolio, p: ModelParams = ModelParams(), start: dict[str, float] | None = None, shrink: bool | None = None) -> Backtest:
    """Targets at each month's end that is a trading day and has walk_window days before it.

    All dates' moments are one aggregation. Without the turnover penalty each date is
    optimised by itself; with it a date's target is the next one's starting point, so one
    group takes the dates in order. Turnover is against the previous target, undrifted.
    The sample includes the rebalance day, whose return the new weights already earn,
    unless p.semantics.next_day says otherwise; it also says which day ends a month.
    No eligible date: empty tables. Market weights that lack an asset are a ValueError.
    """
    assets = book.assets
    if missing := [a for a in assets if a not in book.market]:
        raise ValueError(f"no market weights for {missing}")
    shrink = p.use_shrinkage and p.shrinkage == "ledoit_wolf" if shrink is None else shrink
    first = start or dict.fromkeys(assets, 1 / len(assets))
    r = returns.where(F.col("asset").isin(assets))
    later = p.semantics.next_day
    dates = eligible_dates(r, p.walk_window, p.walk_freq, p.semantics.trading_month_end)
    sampled = dates.withColumn("loc", F.col("loc") - int(later))
    mu, cov = window_moments(r, sampled, p.walk_window - later, p.trading_days, shrink, assets)
    rows = cov.unionByName(mu.select("rebalance_date", F.col("asset").alias("asset_i"), F.lit(None).cast("string").alias("asset_j"), F.col("mu").alias("cov")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, current = [], np.array([first[a] for a in assets], float)
        for day, g in pdf.groupby("rebalance_date", sort=True):
            single = g["asset_j"].isna()
            m = g[single].set_index("asset_i")["cov"].loc[assets].to_numpy()
            w, ret, vol = _target(assets, m, square(g[~single], assets), book, p, current)
            out += [(day, a, i, w[i], ret, vol) for i, a in enumerate(assets)]
            current = w
        return pd.DataFrame(out, columns=[c.split()[0] for c in _TARGETS.split(", ")])

    groups = rows.groupBy() if p.implementation_layer else rows.groupBy("rebalance_date")
    targets = settle(groups.applyInPandas(run, _TARGETS))
    weights = targets.select("rebalance_date", "asset", "asset_ord", "weight")
    stats = targets.groupBy("rebalance_date").agg(F.first("expected_return").alias("expected_return"), F.first("volatility").alias("volatility"))
    return Backtest(history_series(r, weights, next_day=later), weights, _diagnostics(stats, turnover_history(weights, first), p.risk_free))


def turnover_history(weights: DataFrame, start: dict[str, float]) -> DataFrame:
    """(rebalance_date, turnover): absolute changes against the previous target, of the first date against start."""
    prev = F.coalesce(F.lag("weight").over(Window.partitionBy("asset").orderBy("rebalance_date")), asset_weights(start))
    return weights.withColumn("move", F.abs(F.col("weight") - prev)).groupBy("rebalance_date").agg(F.sum("move").alias("turnover"))


def _diagnostics(stats: DataFrame, turnover: DataFrame, rf: float) -> DataFrame:
    sharpe = F.when(F.col("volatility") > 0, F.try_divide(F.col("expected_return") - rf, F.col("volatility")))
    return stats.join(turnover, "rebalance_date").select("rebalance_date", "expected_return", "volatility", sharpe.alias("sharpe"), "turnover")


def policy_diagnostics(weights: DataFrame, mu: DataFrame, cov: DataFrame, start: dict[str, float], rf: float = 0.04) -> DataFrame:
    """Diagnostics of given weights (rebalance_date, asset, weight) under each date's moments, as window_moments() gives them."""
    at = lambda side: weights.select("rebalance_date", F.col("asset").alias(f"asset_{side}"), F.col("weight").alias(f"w_{side}"))
    vol = cov.join(at("i"), ["rebalance_date", "asset_i"]).join(at("j"), ["rebalance_date", "asset_j"]).groupBy("rebalance_date").agg(F.sqrt(F.sum(F.col("w_i") * F.col("w_j") * F.col("cov"))).alias("volatility"))
    ret = weights.join(mu, ["rebalance_date", "asset"]).groupBy("rebalance_date").agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return"))
    return _diagnostics(ret.join(vol, "rebalance_date"), turnover_history(weights, start), rf)


def latest_weights(weights: DataFrame) -> DataFrame:
    last = weights.agg(F.max("rebalance_date").alias("rebalance_date"))
    return weights.join(F.broadcast(last), "rebalance_date")


def last_rows(diagnostics: DataFrame, n: int = 5) -> DataFrame:
    """The n latest dates, in order."""
    return diagnostics.orderBy(F.desc("rebalance_date")).limit(n).orderBy("rebalance_date")
