"""Small tables, those bounded by the universe of assets and not by the data, and how they are printed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.shared import new_path

#: Rows that a small table has at most: the pairs of a thousand assets.
MOST = 1_000_000


def settle(df: DataFrame) -> DataFrame:
    """df computed once and held as literal rows, so that plans which use it often stay short.

    For moments, weights and targets; a table over MOST rows is written to the shared
    folder and read again instead.
    """
    rows = df.limit(MOST + 1).collect()
    if len(rows) <= MOST:
        return df.sparkSession.createDataFrame(rows, df.schema)
    path = new_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def printed(df: DataFrame, places: int = 4) -> DataFrame:
    """df with its doubles rounded to the places of a printed table, half to even."""
    return df.select(*[F.bround(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
