"""Line deduplication over three-line windows [native]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import column, fresh, materialize


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text reduced to the lines that no later repeat covers, plus n_lines and n_removed.

    Lines are what "\\n" separates. Every run of `window` consecutive lines is hashed to
    128 bits, from two hashes of each line; of a run that occurs more than once, in any document, the first occurrence
    by (doc_id, line) stays and each later one marks its `window` lines. Marked positions
    of overlapping windows merge, and marked lines go.

    Null text stays null (n_lines 0). Fewer than `window` lines, or an empty text: kept
    whole. Rows that agree in id and text are one document and keep alike; a null id
    comes first. Columns n_lines and n_removed of the input are replaced.
    """
    d = docs.drop("n_lines", "n_removed")
    key = (column(d, id_col), F.xxhash64(column(d, text_col)))
    hashes = F.transform(F.split(column(d, text_col), "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b")))
    runs = d.select(key[0].alias("id"), key[1].alias("part"), hashes.alias("lh")).where(F.size("lh") >= window).distinct()
    at = lambda i, h: [F.col("lh")[i + k][h] for k in range(window)]
    starts = F.sequence(F.lit(0), F.size("lh") - window)
    runs = runs.select("id", "part", F.posexplode(F.transform(starts, lambda i: F.struct(F.xxhash64(*at(i, "a")).alias("h1"), F.xxhash64(*at(i, "b")).alias("h2")))).alias("pos", "h"))
    runs = materialize(runs.select("id", "part", "pos", "h.h1", "h.h2"), "line-runs")
    first = runs.groupBy("h1", "h2").agg(F.min(F.struct("id", "part", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = materialize(first, "line-first")  # a table of its own, so that Spark can split a hot window's side of the join
    later = runs.join(first, ["h1", "h2"]).where(~F.struct("id", "part", "pos").eqNullSafe(F.col("first")))
    marks = later.groupBy("id", "part").agg(F.collect_set("pos").alias("starts"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1))))
    m_id, m_part, gone = (fresh(d, x) for x in ("m_id", "m_part", "gone"))
    marks = marks.select(F.col("id").alias(m_id), F.col("part").alias(m_part), covered.alias(gone))
    lines = F.split(column(d, text_col), "\n", -1)
    out = d.join(marks, column(d, id_col).eqNullSafe(F.col(m_id)) & (F.xxhash64(column(d, text_col)) == F.col(m_part)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: lines[i]), "\n")
    n = F.when(column(d, text_col).isNull(), 0).otherwise(F.size(lines))
    new = F.when(F.col(gone).isNull(), column(d, text_col)).otherwise(kept)
    return out.select(*[new.alias(c) if c == text_col else column(d, c) for c in d.columns], n.cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
