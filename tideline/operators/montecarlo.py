"""Monte Carlo paths of a daily rebalanced portfolio and the statistics of their ends and drawdowns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.shared import stored
from tideline.operators.quantiles import quantile_columns

#: Labels of the risk report, in order, with the statistic of each (fixed values).
REPORT = {
    "Mean Terminal Value": "mean_terminal_value",
    "Median Terminal Value": "median_terminal_value",
    "5th Percentile Terminal Value": "p5_terminal_value",
    "25th Percentile Terminal Value": "p25_terminal_value",
    "75th Percentile Terminal Value": "p75_terminal_value",
    "95th Percentile Terminal Value": "p95_terminal_value",
    "Probability of Loss": "prob_loss",
    "Probability of Double": "prob_double",
    "Probability of 5x": "prob_5x",
    "Mean Max Drawdown": "mean_max_drawdown",
    "Median Max Drawdown": "median_max_drawdown",
    "95th Worst Drawdown": "p95_worst_drawdown",
    "Probability of 30% Drawdown": "prob_drawdown_30",
    "Probability of 50% Drawdown": "prob_drawdown_50",
    "Probability of 60% Drawdown": "prob_drawdown_60",
}


def simulate(stats: DataFrame, years: int = 10, sims: int = 10_000, days: int = 252, initial: float = 1.0, seed: int = 42, paths: bool = False) -> DataFrame:
    """(sim_id, terminal, max_drawdown) of each path, or (sim_id, step, value) of all steps.

    stats has one row with expected_return and volatility. Daily portfolio returns of
    normal asset returns are normal with the portfolio's own mean and variance, so one
    number a day is drawn. Every path has its own generator, seeded by (seed, sim_id):
    partitions do not matter, and a lost task draws the same again.
    """
    spark: SparkSession = stats.sparkSession
    steps = years * days
    parts = max(1, min(sims // 64, 4 * spark.sparkContext.defaultParallelism))
    rows = spark.range(0, sims, 1, parts).withColumnRenamed("id", "sim_id").join(F.broadcast(stats.select("expected_return", "volatility")))

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                z = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(steps) for i in part["sim_id"]])
                m, v = part["expected_return"].to_numpy()[:, None] / days, part["volatility"].to_numpy()[:, None] / np.sqrt(days)
                value = initial * np.cumprod(1 + m + v * z, axis=1)
                if paths:
                    yield pd.DataFrame({"sim_id": np.repeat(part["sim_id"].to_numpy(), steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(part)), "value": value.ravel()})
                else:
                    fall = (value / np.maximum.accumulate(value, axis=1) - 1).min(axis=1)
                    yield pd.DataFrame({"sim_id": part["sim_id"].to_numpy(), "terminal": value[:, -1], "max_drawdown": fall})

    return rows.mapInPandas(run, "sim_id long, step int, value double" if paths else "sim_id long, terminal double, max_drawdown double")


def path_names(paths: DataFrame) -> DataFrame:
    """paths with the name of each, sim_1 for sim_id 0 and so on, as column sim."""
    return paths.withColumn("sim", F.concat(F.lit("sim_"), (F.col("sim_id") + 1).cast("string")))


def summarize(paths: DataFrame) -> DataFrame:
    """(sim_id, terminal, max_drawdown) of stored paths (sim_id, step, value)."""
    peak = F.max("value").over(Window.partitionBy("sim_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    p = paths.withColumn("fall", F.col("value") / peak - 1)
    return p.groupBy("sim_id").agg(F.max_by("value", "step").alias("terminal"), F.min("fall").alias("max_drawdown"))


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def terminal_stats(ends: DataFrame, initial: float = 1.0) -> DataFrame:
    """One row of statistics of terminal; its thresholds are absolute, whatever the paths began at, unless `initial` is given.

    The quantiles are exact and made when this is called, by counts over ends, which
    should be a stored table.
    """
    t = F.col("terminal")
    q = quantile_columns(ends, "terminal", {"median_terminal_value": 0.5, "p5_terminal_value": 0.05, "p25_terminal_value": 0.25, "p75_terminal_value": 0.75, "p95_terminal_value": 0.95})
    one = ends.agg(F.avg(t).alias("mean_terminal_value"), _share(t < initial).alias("prob_loss"), _share(t >= 2 * initial).alias("prob_double"), _share(t >= 5 * initial).alias("prob_5x"))
    return one.select("mean_terminal_value", *[c.alias(n) for n, c in q.items()], "prob_loss", "prob_double", "prob_5x")


def drawdown_stats(ends: DataFrame) -> DataFrame:
    """One row of statistics of max_drawdown, as terminal_stats(); the worst 95 % is its 5 % quantile."""
    d = F.col("max_drawdown")
    q = quantile_columns(ends, "max_drawdown", {"median_max_drawdown": 0.5, "p95_worst_drawdown": 0.05})
    one = ends.agg(F.avg(d).alias("mean_max_drawdown"), _share(d <= -0.30).alias("prob_drawdown_30"), _share(d <= -0.50).alias("prob_drawdown_50"), _share(d <= -0.60).alias("prob_drawdown_60"))
    return one.select("mean_max_drawdown", *[c.alias(n) for n, c in q.items()], "prob_drawdown_30", "prob_drawdown_50", "prob_drawdown_60")


def risk_report(ends: DataFrame, initial: float = 1.0) -> DataFrame:
    """(metric, value): the fifteen rows of the risk report. ends is written to the shared folder first, as it is read several times."""
    ends = stored(ends, "path-ends")
    one = terminal_stats(ends, initial).join(drawdown_stats(ends))
    named = one.select(*[F.col(c).alias(n) for n, c in REPORT.items()])
    return named.unpivot([], [F.col(f"`{n}`") for n in REPORT], "metric", "value")
