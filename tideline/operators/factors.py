"""Factor regressions from a QR of all days, merged from the tasks' own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.kernels.special import f_upper, omnibus, t_quantile, t_two_sided
from tideline.operators.tall_qr import least_squares, tall_qr
from tideline.sources.factors import FF3, FF5


def factor_names(model: str) -> list[str]:
    name = model.lower().strip()
    if name not in ("ff3", "ff5"):
        raise ValueError(f"unknown model {model!r}")
    return [c for c in (FF3 if name == "ff3" else FF5) if c != "rf"]


def regression_rows(series: DataFrame, factors: DataFrame, model: str = "ff5") -> DataFrame:
    """(series, day, y, factors): excess returns on days that both have, without nulls."""
    names = factor_names(model)
    j = series.join(factors.select("day", *names, "rf"), "day")
    return j.select("series", "day", (F.col("ret") - F.col("rf")).alias("y"), *names).dropna()


def gram(rows: DataFrame, names: list[str]) -> DataFrame:
    """(series, n, and the sums of products of 1, the factors and y), in one aggregation."""
    cols = {"one": F.lit(1.0), **{n: F.col(n) for n in names}, "y": F.col("y")}
    keys = list(cols)
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), *[F.sum(cols[a] * cols[b]).alias(f"{a}__{b}") for i, a in enumerate(keys) for b in keys[i:]])


def regress(series: DataFrame, factors: DataFrame, model: str = "ff5") -> DataFrame:
    """(series, term, coef, t_stat, p_value) by ordinary least squares; terms const and the factors."""
    return coefficients(series, factors, model).select("series", "term", "coef", "t_stat", "p_value")


def coefficients(series: DataFrame, factors: DataFrame, model: str = "ff5", level: float = 0.95) -> DataFrame:
    """regress() with the standard error of each coefficient and its interval of that confidence."""
    terms = ["const", *factor_names(model)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for series_name, n, r in zip(pdf["series"], pdf["n"], pdf["r"], strict=True):
            k = len(terms)
            beta, se, _ = least_squares(np.array(r).reshape(-1, k + 1), n)
            t = np.divide(beta, se, out=np.full(k, np.inf), where=se > 0)
            far = t_quantile(level, n - k)
            out += [(series_name, a, b, e, x, t_two_sided(x, n - k) if math.isfinite(x) else 0.0, b - far * e, b + far * e) for a, b, e, x in zip(terms, beta, se, t, strict=True)]
        return pd.DataFrame(out, columns=["series", "term", "coef", "std_err", "t_stat", "p_value", "low", "high"])

    return factor(regression_rows(series, factors, model), model).groupBy("series").applyInPandas(run, "series string, term string, coef double, std_err double, t_stat double, p_value double, low double, high double")


def factor(rows: DataFrame, model: str) -> DataFrame:
    """(series, n, r): the R factor of the constant, the factors and y, for each series."""
    return tall_qr(rows.withColumn("one", F.lit(1.0)), "series", ["one", *factor_names(model), "y"])


def fit_statistics(series: DataFrame, factors: DataFrame, model: str = "ff5", known: DataFrame | None = None) -> DataFrame:
    """(series, metric, value) of the fit.

    R2 and its adjusted form, F, log likelihood, AIC, BIC, Durbin-Watson, degrees of
    freedom, the residuals' skewness and kurtosis with the Jarque-Bera and omnibus tests
    of them, and the condition number of the design. `known` are the series'
    coefficients() where they are at hand.
    """
    names = factor_names(model)
    rows = regression_rows(series, factors, model)
    coef = (regress(series, factors, model) if known is None else known).groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("term", "coef"))).alias("b"))
    fitted = F.col("b")["const"]
    for c in names:
        fitted = fitted + F.col("b")[c] * F.col(c)
    e = rows.join(F.broadcast(coef), "series").select("series", "day", "y", (F.col("y") - fitted).alias("e"))
    e = e.withColumn("step", F.col("e") - F.lag("e").over(Window.partitionBy("series").orderBy("day")))
    s = e.groupBy("series").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("e") * F.col("e")).alias("sse"), (F.var_samp("y") * (F.count(F.lit(1)) - 1)).alias("sst"), F.sum(F.col("step") * F.col("step")).alias("ssd"), F.avg(F.pow("e", F.lit(3))).alias("m3"), F.avg(F.pow("e", F.lit(4))).alias("m4"))
    k = len(names)
    s = s.join(factor(rows, model).select("series", "r"), "series")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            *_, condition = least_squares(np.array(r.r).reshape(-1, k + 2), int(r.n))
            n, m2 = r.n, r.sse / r.n
            r2 = 1 - r.sse / r.sst
            f = (r2 / k) / ((1 - r2) / (n - k - 1))
            ll = -n / 2 * (math.log(2 * math.pi) + math.log(r.sse / n) + 1)
            skew, kurt = r.m3 / m2**1.5, r.m4 / m2**2
            values = {"r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (n - 1) / (n - k - 1), "f_statistic": f, "f_p_value": f_upper(f, k, n - k - 1), "log_likelihood": ll, "aic": 2 * (k + 1) - 2 * ll, "bic": math.log(n) * (k + 1) - 2 * ll, "durbin_watson": r.ssd / r.sse, "skew": skew, "kurtosis": kurt, "jarque_bera": n / 6 * (skew**2 + (kurt - 3) ** 2 / 4), "observations": n, "df_model": float(k), "df_residuals": n - k - 1, "condition_number": condition}
            values["omnibus"] = omnibus(skew, kurt, n)
            # both tests have two degrees of freedom
            values |= {f"{m}_p_value": math.exp(-values[m] / 2) for m in ("jarque_bera", "omnibus")}
            out += [(r.series, m, v) for m, v in values.items()]
        return pd.DataFrame(out, columns=["series", "metric", "value"])

    return s.groupBy("series").applyInPandas(run, "series string, metric string, value double")
