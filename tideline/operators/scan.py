"""Running aggregates along a series in two levels: inside spans of it, and over the spans' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Calendar days, or positions, of a span; a task takes spans, not series.
SPAN = 1024


def _joined(both, carry: Column, local: Column) -> Column:
    """both(carry, local), or the one of them that is there."""
    return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(both(carry, local))


# Of each kind: its aggregate, and how a later part's value follows an earlier part's.
KINDS = {
    "product": (F.product, lambda carry, local: _joined(lambda a, b: a * b, carry, local)),
    "sum": (F.sum, lambda carry, local: _joined(lambda a, b: a + b, carry, local)),
    "count": (F.count, lambda carry, local: F.coalesce(carry, F.lit(0)) + local),
    "max": (F.max, lambda carry, local: F.greatest(carry, local)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda carry, local: F.coalesce(local, carry)),
}


def span_of(rows: DataFrame, order: str, span: int = SPAN) -> Column:
    at = F.unix_date(order) if rows.schema[order].dataType.typeName() == "date" else F.col(order)
    return F.floor(at / span).cast("long")


def _same(keys: list[str]) -> Column:
    same = F.col("span_") == F.col("span_of_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    return same


def _named(keys: list[str]) -> list[Column]:
    return [*(F.col(k).alias(f"{k}_of") for k in keys), F.col("span_").alias("span_of_")]


def scan(rows: DataFrame, keys: list[str], order: str, aggs: dict[str, tuple[str, Column]], before: bool = False, span: int = SPAN) -> DataFrame:
    """rows with a running aggregate for each of aggs, name to (kind, column): over all rows of the keys up to this one, or only those `before` it.

    Kinds are product, sum, count, max and last (the last known value); nulls are passed
    over. Rows of equal keys are cut into spans of the order column, a date or an integer
    without repeats. A window inside each span and a total of each span are made by as
    many tasks as there are spans; only the totals, a row for each key and span, are run
    over in order, and what comes before a span is joined to its rows.
    """
    rows = rows.withColumn("span_", span_of(rows, order, span))
    totals = rows.groupBy(*keys, "span_").agg(*[(F.max_by(c, F.when(c.isNotNull(), F.col(order))) if k == "last" else KINDS[k][0](c)).alias(n) for n, (k, c) in aggs.items()])
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(*_named(keys), *[(F.sum(n) if k == "count" else KINDS[k][0](F.col(n))).over(earlier).alias(f"{n}_carry") for n, (k, _) in aggs.items()])
    inside = Window.partitionBy(*keys, "span_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = rows.select("*", *[KINDS[k][0](c).over(inside).alias(f"{n}_local") for n, (k, c) in aggs.items()])
    both = local.join(carries, _same(keys))
    kept = [c for c in rows.columns if c != "span_" and c not in aggs]
    return both.select(*kept, *[KINDS[k][1](F.col(f"{n}_carry"), F.col(f"{n}_local")).alias(n) for n, (k, _) in aggs.items()])


def growth_scan(rows: DataFrame, keys: list[str], order: str, factor: Column, span: int = SPAN) -> DataFrame:
    """rows with `product`, the running product of factor, and `peak`, its highest value so far, in one scan.

    A span's products all get what comes before it as a factor, and so does its highest
    one, or its lowest where that factor is negative.
    """
    rows = rows.withColumn("span_", span_of(rows, order, span)).withColumn("factor_", factor)
    inside = Window.partitionBy(*keys, "span_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("local_", F.product("factor_").over(inside))
    local = local.withColumn("high_", F.max("local_").over(inside)).withColumn("low_", F.min("local_").over(inside))
    totals = local.groupBy(*keys, "span_").agg(F.max_by("local_", order).alias("all_"), F.max("local_").alias("high_"), F.min("local_").alias("low_"))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    lifted = lambda carry: F.when(carry < 0, carry * F.col("low_")).otherwise(F.coalesce(carry, F.lit(1.0)) * F.col("high_"))
    totals = totals.withColumn("carry_", F.product("all_").over(earlier)).withColumn("top_", lifted(F.col("carry_")))
    carries = totals.select(*_named(keys), "carry_", F.max("top_").over(earlier).alias("peak_"))
    both = local.join(carries, _same(keys))
    kept = [c for c in rows.columns if c not in ("span_", "factor_")]
    product = KINDS["product"][1](F.col("carry_"), F.col("local_"))
    return both.select(*kept, product.alias("product"), F.greatest("peak_", lifted(F.col("carry_"))).alias("peak"))
