"""Densifying, returns, portfolio series, growth and drawdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.shared import stored
from tideline.operators.scan import SPAN, growth_scan, scan


def densify(prices: DataFrame, assets: list[str]) -> DataFrame:
    """A row for each day that has any price and each asset; close is null where it has none."""
    days = prices.where(F.col("close").isNotNull() & F.col("asset").isin(assets)).groupBy("day", "asset").agg(F.first("close").alias("close"))
    by_day = days.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("asset", "close"))).alias("m"))
    return by_day.select("day", "m", F.explode(F.array(*map(F.lit, assets))).alias("asset")).select("day", "asset", F.try_element_at("m", F.col("asset")).alias("close"))


def daily_returns(panel: DataFrame, span: int = SPAN, pad: bool = True) -> DataFrame:
    """(day, loc, asset, ret): change on the last known price; days without any return go.

    A gap counts as no change and the next price spans it; before its second price an
    asset's ret is null. Without `pad`, a change needs both days' prices. loc numbers the days that stay from 0. Last prices and numbers
    are running aggregates over spans of days, so no task takes an asset's history. The
    returns are written to the shared folder, as all that follows reads them several times.
    """
    known = F.col("close") if pad else F.struct("close")  # the day before's price, even if it is null
    r = scan(panel, ["asset"], "day", {"prev": ("last", known)}, before=True, span=span)
    prev, now = (F.col("prev"), F.coalesce("close", "prev")) if pad else (F.col("prev.close"), F.col("close"))
    r = stored(r.select("day", "asset", (F.try_divide(now, prev) - 1).alias("ret")), "returns")
    days = scan(r.where("ret is not null").select("day").distinct(), [], "day", {"loc": ("count", F.lit(1))}, before=True, span=span)
    return r.join(F.broadcast(days), "day").select("day", "loc", "asset", "ret")


def require(df: DataFrame, assets: list[str]) -> DataFrame:
    """Rows of the assets; KeyError for one that df lacks."""
    have = {r["asset"] for r in df.where(F.col("asset").isin(assets)).select("asset").distinct().collect()}
    if missing := [a for a in assets if a not in have]:
        raise KeyError(f"no rows for {missing}")
    return df.where(F.col("asset").isin(assets))


def asset_weights(weights: dict[str, float]) -> Column:
    """The weight of column asset; null for others."""
    table = F.create_map(*[F.lit(x) for a, w in weights.items() for x in (a, float(w))])
    return F.try_element_at(table, F.col("asset")) if weights else F.lit(None).cast("double")


def portfolio_series(returns: DataFrame, weights: dict[str, float], name: str = "portfolio", reweight: bool = False) -> DataFrame:
    """(day, series, ret): weighted sum of the assets' returns; a missing return counts 0, or has its weight spread over the others.

    The weights, a row for each asset, are sent to all executors and joined.
    """
    table = returns.sparkSession.createDataFrame([(a, float(w)) for a, w in weights.items()], "asset string, weight_ double")
    r = returns.join(F.broadcast(table), "asset")
    total = F.sum(F.col("ret") * F.col("weight_"))
    if reweight:
        total = F.try_divide(total * F.sum("weight_"), F.sum(F.when(F.col("ret").isNotNull(), F.col("weight_"))))
    return r.groupBy("day").agg(F.coalesce(total, F.lit(0.0)).alias("ret")).select("day", F.lit(name).alias("series"), "ret")


def asset_series(returns: DataFrame, asset: str, name: str | None = None) -> DataFrame:
    return returns.where(F.col("asset") == asset).select("day", F.lit(name or asset).alias("series"), "ret")


def growth(series: DataFrame, initial: float = 1.0, span: int = SPAN) -> DataFrame:
    """(day, series, ret, value): running product of 1 + ret; null on days without a return."""
    run = scan(series, ["series"], "day", {"value": ("product", 1 + F.col("ret"))}, span=span)
    return run.withColumn("value", F.when(F.col("ret").isNotNull(), initial * F.col("value")))


def drawdowns(series: DataFrame, span: int = SPAN, from_start: bool = False) -> DataFrame:
    """growth() with the fall from its highest value so far; the first value is the first peak, or, `from_start`, the money put in."""
    run = growth_scan(series, ["series"], "day", 1 + F.col("ret"), span)
    value = F.when(F.col("ret").isNotNull(), F.col("product"))
    peak = F.greatest("peak", F.lit(1.0)) if from_start else F.col("peak")
    return run.withColumn("value", value).withColumn("drawdown", F.col("value") / peak - 1).drop("product", "peak")


def growth_frame(series: dict[str, DataFrame], later: dict[str, DataFrame] | None = None) -> DataFrame:
    """One column of growth for each named series, on the union of their days; those `later` only on days of the others.

    A series without rows gives a column of nulls. All of them go through one scan.
    """
    parts = [s.select("day", F.lit(name).alias("series"), "ret", F.lit(first).alias("first_")) for first, some in ((True, series), (False, later or {})) for name, s in some.items()]
    run = growth(reduce(DataFrame.union, parts))
    names = [*series, *(later or {})]
    wide = run.groupBy("day").agg(F.max("first_").alias("first_"), *[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names])
    return wide.where("first_").select("day", *[F.col(f"`{n}`") for n in names])


def on_days_of(series: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of series on the days of another; KeyError for a day that series lacks."""
    wanted = days.select("day").distinct()
    if (missing := wanted.join(series, "day", "left_anti").orderBy("day").first()) is not None:
        raise KeyError(f"no row for {missing['day']}")
    return series.join(wanted, "day", "left_semi")
