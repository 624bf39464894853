"""Optimal weights and the efficient frontier: one small programme for each group of moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.kernels import qp
from tideline.operators.bayes import square
from tideline.operators.risk import quadratic

_WEIGHTS = "asset string, asset_ord int, weight double"


def positions(values: dict[str, float] | None, assets: list[str]) -> dict[int, float]:
    """Rules by position; ValueError for an asset outside the universe."""
    return {assets.index(a): v for a, v in (values or {}).items()}


def _solve(mu: DataFrame, cov: DataFrame, assets: list[str], solver) -> DataFrame:
    both = cov.select("asset_i", "asset_j", "cov").unionByName(mu.select(F.col("asset").alias("asset_i"), F.lit(None).cast("string").alias("asset_j"), F.col("mu").alias("cov")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        single = rows["asset_j"].isna()
        m = rows[single].set_index("asset_i")["cov"].loc[assets].to_numpy()
        return pd.DataFrame({"asset": assets, "asset_ord": range(len(assets)), "weight": solver(m, square(rows[~single], assets))})

    return both.groupBy().applyInPandas(run, _WEIGHTS)


def max_sharpe(mu: DataFrame, cov: DataFrame, assets: list[str], rf: float = 0.04, bounds=(0.0, 1.0), fixed: dict[str, float] | None = None, minimum: dict[str, float] | None = None) -> DataFrame:
    """(asset, asset_ord, weight) of greatest Sharpe ratio, cleaned; mu is (asset, mu)."""
    at, least = positions(fixed, assets), positions(minimum, assets)
    return _solve(mu, cov, assets, lambda m, c: qp.max_sharpe(m, c, rf, bounds, at, least))


def min_vol(mu: DataFrame, cov: DataFrame, assets: list[str], bounds=(0.0, 1.0)) -> DataFrame:
    """Weights of least variance; fixed and least weights have no part in it."""
    return _solve(mu, cov, assets, lambda m, c: qp.min_vol(c, bounds))


def optimality(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.04, bounds=(0.0, 1.0), fixed: dict[str, float] | None = None, minimum: dict[str, float] | None = None, sharpe: bool = True) -> DataFrame:
    """One row (sums_to_one, within_rules, no_gain): whether weights satisfy the first-order conditions of their programme.

    The objective is the logarithm of the Sharpe ratio, or less variance if not `sharpe`.
    no_gain: moving weight from any asset that may give to any that may take, rules
    considered, gains at most 1 % of the scale of the objective's slopes; cleaned weights
    are rounded, so the conditions hold to about that.
    """
    rules, near = {**(fixed or {}), **(minimum or {})}, 2e-4
    least = F.lit(float(bounds[0]))
    for a, v in rules.items():
        least = F.when(F.col("asset") == a, F.lit(float(v))).otherwise(least)
    most = F.lit(float(bounds[1]))
    for a, v in (fixed or {}).items():
        most = F.when(F.col("asset") == a, F.lit(float(v))).otherwise(most)
    one = quadratic(weights, cov).join(mu, "asset").withColumn("least", least).withColumn("most", most)
    total = one.agg(F.sum("weight").alias("total"), F.sum(F.col("weight") * F.col("mu")).alias("ret"), F.sum(F.col("weight") * F.col("cov_w")).alias("var"))
    slope = F.col("mu") / (F.col("ret") - rf * F.col("total")) - F.col("cov_w") / F.col("var") if sharpe else -F.col("cov_w") / F.col("var")
    one = one.join(F.broadcast(total)).withColumn("slope", slope)
    may_take, may_give = F.col("weight") < F.col("most") - near, F.col("weight") > F.col("least") + near
    rows = one.agg(F.max(F.abs(F.col("total") - 1)).alias("off"), F.min((F.col("weight") >= F.col("least") - near) & (F.col("weight") <= F.col("most") + near)).alias("within_rules"), F.max(F.when(may_take, F.col("slope"))).alias("take"), F.min(F.when(may_give, F.col("slope"))).alias("give"), F.max(F.abs(F.col("cov_w") / F.col("var"))).alias("scale"))
    return rows.select((F.col("off") < 1e-3).alias("sums_to_one"), "within_rules", F.coalesce(F.col("take") - F.col("give") <= 0.01 * F.col("scale"), F.lit(True)).alias("no_gain"))


def frontier_targets(mu: DataFrame, points: int = 50) -> DataFrame:
    """(point_id, target_ret): evenly from the least to the greatest expected return."""
    ends = mu.agg(F.min("mu").alias("lo"), F.max("mu").alias("hi"))
    return ends.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("point_id"), "lo", "hi").select("point_id", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point_id") / (points - 1)).alias("target_ret"))


def efficient_frontier(mu: DataFrame, cov: DataFrame, assets: list[str], points: int = 50, bounds=(0.0, 1.0)) -> DataFrame:
    """(point_id, target_ret, vol, weights); targets out of reach are left out, the inefficient branch is not.

    Each target is a programme of its own; the moments, one row, go along with each.
    """
    spark = mu.sparkSession
    moments = mu.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("asset", "mu"))).alias("mu")).join(cov.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "asset_i", "asset_j"), "cov"))).alias("cov")))
    rows = frontier_targets(mu, points).repartition(min(points, spark.sparkContext.defaultParallelism), "point_id").join(F.broadcast(moments))

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                m = np.array([dict(r.mu)[a] for a in assets])
                c = np.array([[dict(r.cov)[f"{a}\x1f{b}"] for b in assets] for a in assets])
                try:
                    w = qp.target_return(m, c, r.target_ret, bounds)
                except (qp.Infeasible, ArithmeticError):
                    continue
                out.append((r.point_id, r.target_ret, float(np.sqrt(w @ c @ w)), w.tolist()))
            yield pd.DataFrame(out, columns=["point_id", "target_ret", "vol", "weights"])

    return rows.mapInPandas(run, "point_id long, target_ret double, vol double, weights array<double>")


def capital_market_line(stats: DataFrame, frontier: DataFrame, benchmark: DataFrame, rf: float = 0.04) -> DataFrame:
    """(x, y): two points of the line through the risk-free rate and the portfolio of stats."""
    far = frontier.agg(F.max("vol").alias("f_vol")).join(benchmark.select(F.col("vol").alias("b_vol")))
    slope = F.try_divide(F.col("expected_return") - rf, F.col("volatility"))
    end = F.greatest(F.coalesce("f_vol", "b_vol"), "b_vol") * 1.1
    return stats.join(far).select(F.explode(F.array(F.lit(0.0), end)).alias("x"), slope.alias("slope")).select("x", (F.lit(rf) + F.col("slope") * F.col("x")).alias("y"))


def weights_dict(df: DataFrame) -> dict[str, float]:
    """Weights to the driver, one row for each asset, in their order."""
    return {r["asset"]: r["weight"] for r in df.orderBy("asset_ord").collect()}


def normalize_weights(weights: DataFrame) -> DataFrame:
    """weights with each portfolio's weight made to sum to 1; an error where the sum is 0."""
    total = F.sum("weight").over(_by_portfolio())
    return weights.withColumn("weight", F.when(total == 0, F.raise_error(F.lit("weights sum to 0")).cast("double")).otherwise(F.try_divide(F.col("weight"), total)))


def _by_portfolio():
    from pyspark.sql.window import Window

    return Window.partitionBy("portfolio")


def weights_table(spark: SparkSession, weights: dict[str, float], assets: list[str], strict: bool = True) -> DataFrame:
    """(asset, asset_ord, weight) in the order of assets; a missing one is a KeyError, or 0 if not strict."""
    if strict and (missing := [a for a in assets if a not in weights]):
        raise KeyError(f"no weight for {missing}")
    return spark.createDataFrame([(a, i, float(weights.get(a, 0.0))) for i, a in enumerate(assets)], _WEIGHTS)
