"""Annualised means and covariances, shrunk by Ledoit and Wolf's formula, from merged co-moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.gram import co_moments


def annual_mean(returns: DataFrame, days: int = 252) -> DataFrame:
    """(asset, mu): mean return, missing ones skipped, times days."""
    return returns.groupBy("asset").agg((F.avg("ret") * days).alias("mu"))


def sample_cov(returns: DataFrame, days: int = 252, assets: list[str] | None = None) -> DataFrame:
    """(asset_i, asset_j, cov) over the days that both assets have, with n - 1, times days; null for a single day."""
    both = co_moments(returns.where("ret is not null"), assets=assets)
    return both.select("asset_i", "asset_j", (F.try_divide("c", F.col("n") - 1) * days).alias("cov"))


def shrinkage_parts(returns: DataFrame, *group: str, assets: list[str] | None = None) -> DataFrame:
    """(asset_i, asset_j, s, q, n): covariance over n of the centred returns, and the mean square of their products, of which the error of s is made.

    A missing return is 0 before centring.
    """
    return co_moments(returns, group, assets, fourth=True).select(*group, "asset_i", "asset_j", "s", "q", "n")


def shrinkage(parts: DataFrame, *group: str) -> DataFrame:
    """(m, delta): the mean variance and the share of it that replaces the sample covariance."""
    p = F.count_distinct("asset_i")
    out = parts.groupBy(*group).agg(p.cast("double").alias("p"), (F.sum(F.when(F.col("asset_i") == F.col("asset_j"), F.col("s"))) / p).alias("m"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").cast("double").alias("n"))
    d2 = (F.col("ss") - F.col("p") * F.col("m") * F.col("m")) / F.col("p")
    b2 = F.least(d2, (F.col("qq") - F.col("ss")) / (F.col("p") * F.col("n")))
    return out.select(*group, "m", F.when(b2 == 0, 0.0).otherwise(F.coalesce(F.try_divide(b2, d2), F.lit(0.0))).alias("delta"))


def shrunk_cov(returns: DataFrame, days: int = 252, group: tuple[str, ...] = (), assets: list[str] | None = None) -> DataFrame:
    """(asset_i, asset_j, cov) shrunk towards a multiple of the identity, times days."""
    parts = shrinkage_parts(returns, *group, assets=assets)
    return shrunk(parts, shrinkage(parts, *group), days, group)


def shrunk(parts: DataFrame, level: DataFrame, days: int = 252, group: tuple[str, ...] = ()) -> DataFrame:
    """(asset_i, asset_j, cov) of shrinkage_parts() and their shrinkage()."""
    joined = parts.join(F.broadcast(level), list(group)) if group else parts.join(F.broadcast(level))
    target = F.when(F.col("asset_i") == F.col("asset_j"), F.col("delta") * F.col("m")).otherwise(0.0)
    return joined.select(*group, "asset_i", "asset_j", (((1 - F.col("delta")) * F.col("s") + target) * days).alias("cov"))


def covariance(returns: DataFrame, days: int = 252, use_shrinkage: bool = False, method: str = "ledoit_wolf", assets: list[str] | None = None) -> DataFrame:
    if use_shrinkage and method not in ("ledoit_wolf", "sample_cov"):
        raise ValueError(f"unknown shrinkage {method!r}")
    return shrunk_cov(returns, days, assets=assets) if use_shrinkage and method == "ledoit_wolf" else sample_cov(returns, days, assets)


def mean_cov(returns: DataFrame, days: int = 252, use_shrinkage: bool = False, method: str = "ledoit_wolf", assets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((asset, mu), (asset_i, asset_j, cov)), both annualised."""
    return annual_mean(returns, days), covariance(returns, days, use_shrinkage, method, assets)
