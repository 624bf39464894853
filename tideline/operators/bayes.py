"""Equilibrium returns, views and the Bayesian posterior."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.kernels import qp


def implied_returns(cov: DataFrame, market: dict[str, float], risk_aversion: float = 2.5) -> DataFrame:
    """(asset, pi): risk aversion times covariance times market weights."""
    w = F.lit(None).cast("double")
    for a, v in market.items():
        w = F.when(F.col("asset_j") == a, F.lit(float(v))).otherwise(w)
    return cov.groupBy(F.col("asset_i").alias("asset")).agg((F.sum(F.col("cov") * w) * risk_aversion).alias("pi"))


def view_returns(views: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Expected returns of absolute views; their confidence has no part in the posterior."""
    return {a: v[0] for a, v in views.items()}


def note_relative_views(views) -> None:
    """Relative views are accepted and not used; warn if there are any."""
    if views:
        warnings.warn("relative views are carried but not used by the posterior", stacklevel=2)


def square(rows: pd.DataFrame, assets: list[str]) -> np.ndarray:
    """Covariance matrix, in the order of assets, of rows (asset_i, asset_j, cov)."""
    return rows.pivot(index="asset_i", columns="asset_j", values="cov").loc[assets, assets].to_numpy()


def posterior(cov: DataFrame, assets: list[str], market: dict[str, float], risk_aversion: float = 2.5, tau: float = 0.05, views: dict[str, tuple[float, float]] | None = None, relative_views=()) -> DataFrame:
    """(asset, bl_mu, pi); a view on an asset outside the universe is a ValueError, a missing market weight a KeyError."""
    note_relative_views(relative_views)
    q = view_returns(views or {})
    if unknown := [a for a in q if a not in assets]:
        raise ValueError(f"views on unknown assets: {unknown}")
    w = [market[a] for a in assets]
    at = {assets.index(a): v for a, v in q.items()}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mu, pi = qp.posterior(square(rows, assets), w, risk_aversion, tau, at)
        return pd.DataFrame({"asset": assets, "bl_mu": mu, "pi": pi})

    return cov.groupBy().applyInPandas(run, "asset string, bl_mu double, pi double")


def compare_mu(*tables: DataFrame) -> DataFrame:
    """Expected returns of several methods side by side, on the union of their assets."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, "asset", "full_outer")
    return out
