"""Factor tables: the text format with a preamble, one table of dated percentages, and a footer."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FF3 = ("mkt_rf", "smb", "hml", "rf")
FF5 = ("mkt_rf", "smb", "hml", "rmw", "cma", "rf")


def factor_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text or zip files; of a zip its first member, bytes that are not UTF-8 dropped."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if content[:4] == b"PK\x03\x04":
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        content = z.read(z.namelist()[0])
                lines = content.decode("utf-8", "ignore").splitlines()
                yield pd.DataFrame({"file": name, "line_no": range(len(lines)), "value": lines})

    return files.mapInPandas(run, "file string, line_no int, value string")


def parse_factors(lines: DataFrame, columns: tuple[str, ...] = FF5) -> DataFrame:
    """(day, *columns) as decimals from (line_no, value).

    The table starts at the first line whose first eight characters, at most, are all
    digits, and ends before the next blank line or line whose first field is not digits;
    short rows are skipped, further fields ignored. An empty result is for the caller:
    load_factors() makes it an error.
    """
    by = ["file"] if "file" in lines.columns else []
    value = F.trim("value")
    field = F.split(value, ",")
    one = lines.select(*by, "line_no", value.alias("value"), F.transform(field, lambda x: F.trim(x)).alias("fields"))
    one = one.withColumn("starts", F.substring("value", 1, 8).rlike("^[0-9]+$")).withColumn("goes", F.col("fields")[0].rlike("^[0-9]+$"))
    so_far = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("begun", F.max("starts").over(so_far))
    one = one.withColumn("ended", F.max(F.col("begun") & ~F.col("goes")).over(so_far))
    rows = one.where(F.col("begun") & ~F.col("ended") & (F.size("fields") >= len(columns) + 1))
    day = F.coalesce(F.try_to_timestamp(F.col("fields")[0], F.lit("yyyyMMdd"))).cast("date")
    return rows.select(day.alias("day"), *[(F.col("fields")[i + 1].try_cast("double") / 100.0).alias(c) for i, c in enumerate(columns)])


def load_factors(spark: SparkSession, path: str, model: str = "ff5") -> DataFrame:
    """Three- or five-factor daily table of a file; ValueError for another model or a file without a table."""
    name = model.lower().strip()
    if name not in ("ff3", "ff5"):
        raise ValueError(f"unknown model {model!r}")
    out = parse_factors(factor_lines(spark, path), FF3 if name == "ff3" else FF5)
    if not out.limit(1).count():
        raise ValueError(f"no factor table in {path}")
    return out
