"""Trailing windows: rolling statistics, rebalance dates and estimation samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.gram import window_co_moments
from tideline.operators.moments import shrinkage, shrunk
from tideline.operators.scan import scan


def window_states(rows: DataFrame, window: int, key: str = "asset", loc: str = "loc", value: str = "ret") -> DataFrame:
    """(key, loc, n, mean, m2) of the `window` positions before each row: known values, their mean, and the squares of what deviates from it.

    Positions are cut into stretches of `window`; what lies before a row is the end of one
    stretch and the start of the next. Both are running aggregates inside a stretch, one
    from its start and one from its end, and a row's two halves are merged: nothing is
    subtracted, every row is read twice however long the window, and a task takes a
    stretch of one key, not its history.
    """
    at, here = F.col(loc), F.floor(F.col(loc) / window)
    mine = rows.select(key, here.alias("stretch"), at.alias("at"), F.col(value).cast("double").alias("v"), at.alias("loc"))
    # what asks for the half in the stretch before stands at the first position of its window
    asks = rows.select(key, (here - 1).alias("stretch"), (at - window).alias("at"), F.lit(None).cast("double").alias("v"), at.alias("loc"))
    every = mine.withColumn("asks", F.lit(False)).union(asks.withColumn("asks", F.lit(True)))
    by = Window.partitionBy(key, "stretch")
    state = lambda w: F.struct(F.count("v").over(w).alias("n"), F.avg("v").over(w).alias("mean"), (F.var_pop("v").over(w) * F.count("v").over(w)).alias("m2"))
    onward = state(by.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = state(by.orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    half = every.select(key, "loc", F.when(F.col("asks"), onward).otherwise(before).alias("s")).select(key, "loc", "s.*")
    n, mean = F.sum("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    # of two halves the product of their counts is what the square of the sum has beyond the squares
    apart = F.coalesce(F.max("mean") - F.min("mean"), F.lit(0.0))
    m2 = F.coalesce(F.sum("m2"), F.lit(0.0)) + apart * apart * F.coalesce(F.try_divide((n * n - F.sum(F.col("n") * F.col("n"))) / 2, n), F.lit(0.0))
    return half.groupBy(key, "loc").agg(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def rolling_statistics(returns: DataFrame, window: int = 1260, days: int = 252) -> DataFrame:
    """(day, return, vol) from position `window` on, over the `window` days before that day.

    return is the mean of the assets' annual means; vol the root of their mean annual
    variance, correlation aside, and null if any asset's variance is.
    """
    s = window_states(returns, window).where(F.col("loc") >= window)
    s = s.select("loc", (F.col("mean") * days).alias("m"), (F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)) * days).alias("v"))
    whole = F.count("v") == F.count(F.lit(1))
    s = s.groupBy("loc").agg(F.avg("m").alias("return"), F.when(whole, F.sqrt(F.avg("v"))).alias("vol"))
    return s.join(returns.select("loc", "day").distinct(), "loc").select("day", "return", "vol")


def rebalance_dates(days: DataFrame, freq: str = "M", trading: bool = False) -> DataFrame:
    """Distinct days that are the last calendar day of their month, other months having none; or the last `trading` day of each month."""
    if freq.upper() not in ("M", "ME"):
        raise ValueError(f"unsupported frequency {freq!r}")
    if trading:
        return days.groupBy(F.last_day("day").alias("month")).agg(F.max("day").alias("day")).select("day")
    return days.select("day").distinct().where(F.col("day") == F.last_day("day"))


def eligible_dates(returns: DataFrame, window: int = 756, freq: str = "M", trading: bool = False) -> DataFrame:
    """(rebalance_date, loc) of rebalance dates with at least `window` days before them."""
    days = returns.select("day", "loc").distinct()
    return days.join(rebalance_dates(days, freq, trading), "day", "left_semi").where(F.col("loc") >= window).select(F.col("day").alias("rebalance_date"), "loc")


def window_samples(returns: DataFrame, dates: DataFrame, window: int = 756) -> DataFrame:
    """returns once for each rebalance date whose sample, that day and `window` days before it, holds them.

    The range of positions is a sequence, so the join is one of equal positions.
    """
    at = dates.select("rebalance_date", F.explode(F.sequence(F.col("loc") - window, F.col("loc"))).alias("loc"))
    return returns.join(at, "loc")


def window_means(returns: DataFrame, dates: DataFrame, window: int) -> DataFrame:
    """(rebalance_date, asset, mean) of each date's sample; null for an asset whose rows in it are all null.

    As window_states(), for the samples of the dates alone: rows that ask for one of a
    sample's halves go through the running sums of its stretch.
    """
    length = window + 1
    stretch = lambda c: F.floor(c / length)
    rows = returns.select("asset", stretch(F.col("loc")).alias("stretch"), F.col("loc").cast("long").alias("at"), F.col("ret").cast("double").alias("v"), F.lit(1).alias("one"))
    ends = dates.select("rebalance_date", F.col("loc").cast("long").alias("at"), F.lit(True).alias("upto"))
    begins = ends.select("rebalance_date", (F.col("at") - window).alias("at"), F.lit(False).alias("upto")).where(F.pmod("at", F.lit(length)) != 0)
    asks = ends.union(begins).withColumn("stretch", stretch(F.col("at")))
    asks = rows.select("asset", "stretch").distinct().join(asks, "stretch")
    every = rows.unionByName(asks, allowMissingColumns=True)
    by = Window.partitionBy("asset", "stretch")
    state = lambda w: F.struct(F.count("one").over(w).alias("rows"), F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("s"))
    up, down = (state(by.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for o in (F.asc("at"), F.desc("at")))
    half = every.select("rebalance_date", "asset", F.when(F.col("upto"), up).otherwise(down).alias("h")).where("rebalance_date is not null").select("rebalance_date", "asset", "h.*")
    return half.groupBy("rebalance_date", "asset").agg(F.sum("rows").alias("rows"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean")).where("rows > 0").drop("rows")


def window_moments(returns: DataFrame, dates: DataFrame, window: int = 756, days: int = 252, shrink: bool = False, assets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((rebalance_date, asset, mu), (rebalance_date, asset_i, asset_j, cov)) of every sample, from states merged from both of its ends."""
    mu = window_means(returns, dates, window).select("rebalance_date", "asset", (F.col("mean") * days).alias("mu"))
    parts = window_co_moments(returns if shrink else returns.where("ret is not null"), dates, window, assets, fourth=shrink)
    if not shrink:
        return mu, parts.select("rebalance_date", "asset_i", "asset_j", (F.try_divide("c", F.col("n") - 1) * days).alias("cov"))
    parts = parts.select("rebalance_date", "asset_i", "asset_j", "s", "q", "n")
    return mu, shrunk(parts, shrinkage(parts, "rebalance_date"), days, ("rebalance_date",))


def asof_weights(returns: DataFrame, history: DataFrame, next_day: bool = False) -> DataFrame:
    """(day, asset, ret, weight): each asset's last rebalanced weight up to the day, or before it; days before the first are left out."""
    h = history.select(F.col("rebalance_date").alias("day"), "asset", F.col("weight").alias("given"))
    filled = scan(returns.join(h, ["day", "asset"], "left"), ["asset"], "day", {"weight": ("last", F.col("given"))}, before=next_day)
    return filled.where("weight is not null").select("day", "asset", "ret", "weight")


def history_series(returns: DataFrame, history: DataFrame, name: str = "walkforward_portfolio", next_day: bool = False) -> DataFrame:
    """(day, series, ret) realised by the weights in force each day; a missing return counts 0."""
    return asof_weights(returns, history, next_day).groupBy("day").agg(F.coalesce(F.sum(F.col("ret") * F.col("weight")), F.lit(0.0)).alias("ret")).select("day", F.lit(name).alias("series"), "ret")
