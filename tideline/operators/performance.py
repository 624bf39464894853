"""Realised performance of return series, alone and against a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.config import SemanticsOptions
from tideline.operators.returns import drawdowns

#: Names of the nine metrics in the summary and in the current-portfolio report (fixed values).
SUMMARY = ("Annual Return", "Annual Vol", "Sharpe", "Max Drawdown", "Beta vs Benchmark", "Alpha vs Benchmark", "Correlation vs Benchmark", "Tracking Error", "Information Ratio")
CURRENT = ("Annual Return", "Annual Volatility", "Sharpe Ratio", *SUMMARY[3:])


def annual_stats(series: DataFrame, rf: float = 0.04, days: int = 252) -> DataFrame:
    """(series, annual_return, annual_vol, sharpe): geometric return, its exponent counting days without a return."""
    s = series.groupBy("series").agg((F.pow(F.product(1 + F.col("ret")), F.lit(float(days)) / F.count(F.lit(1))) - 1).alias("annual_return"), (F.stddev_samp("ret") * days**0.5).alias("annual_vol"))
    return s.withColumn("sharpe", F.try_divide(F.col("annual_return") - rf, F.col("annual_vol")))


def max_drawdown(series: DataFrame, from_start: bool = False) -> DataFrame:
    return drawdowns(series, from_start=from_start).groupBy("series").agg(F.min("drawdown").alias("max_drawdown"))


def against(series: DataFrame, benchmark: DataFrame, days: int = 252, over_rf: float = 0.0) -> DataFrame:
    """(series, beta, alpha, correlation, tracking_error, information_ratio) over days that both have; alpha is of returns over a yearly rate."""
    b = benchmark.select("day", F.col("ret").alias("b"))
    j = series.join(b, "day").where("ret is not null and b is not null")
    s = j.groupBy("series").agg(F.covar_samp("ret", "b").alias("c"), F.var_samp("b").alias("vb"), F.stddev_samp("ret").alias("sp"), F.stddev_samp("b").alias("sb"), F.avg("ret").alias("mp"), F.avg("b").alias("mb"), F.stddev_samp(F.col("ret") - F.col("b")).alias("sd"), F.avg(F.col("ret") - F.col("b")).alias("md"))
    beta = F.when(F.col("vb") > 0, F.try_divide("c", "vb"))
    te = F.col("sd") * days**0.5
    return s.select("series", beta.alias("beta"), ((F.col("mp") - beta * F.col("mb")) * days - over_rf * (1 - beta)).alias("alpha"), F.try_divide(F.col("c"), F.col("sp") * F.col("sb")).alias("correlation"), te.alias("tracking_error"), F.try_divide(F.col("md") * days, te).alias("information_ratio"))


def summary_table(series: DataFrame, benchmark: DataFrame, rf: float = 0.04, days: int = 252, labels: tuple[str, ...] = SUMMARY, semantics: SemanticsOptions = SemanticsOptions()) -> DataFrame:
    """(series, metric, value): the nine metrics of each series."""
    versus = against(series, benchmark, days, rf if semantics.alpha_over_rf else 0.0)
    one = annual_stats(series, rf, days).join(max_drawdown(series, semantics.peak_from_start), "series").join(versus, "series", "left")
    columns = ("annual_return", "annual_vol", "sharpe", "max_drawdown", "beta", "alpha", "correlation", "tracking_error", "information_ratio")
    named = one.select("series", *[F.col(c).alias(n) for c, n in zip(columns, labels, strict=True)])
    return named.unpivot(["series"], [F.col(f"`{n}`") for n in labels], "metric", "value")


def benchmark_point(benchmark: DataFrame, days: int = 252) -> DataFrame:
    """(ret, vol) of a chart: arithmetic mean and deviation, annualised."""
    return benchmark.agg((F.avg("ret") * days).alias("ret"), (F.stddev_samp("ret") * days**0.5).alias("vol"))
