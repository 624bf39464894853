"""Exact quantiles by repeated counts of buckets: no task and no driver holds the values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets that a round cuts a range of values into, about, and values that are listed instead of cut further.
BUCKETS, LISTED = 64, 2000


@dataclass
class Piece:
    """An open range of values: its bounds, None for none, its size, the rank of its first value, and the ranks wanted in it."""

    low: float | None
    high: float | None
    size: int
    first: int
    wanted: list[int]

    def holds(self, x: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (x > self.low)
        return out if self.high is None else out & (x < self.high)


def _inside(x: DataFrame, pieces: list[Piece]) -> DataFrame:
    """Rows that lie in some piece, with its number."""
    number = F.lit(None).cast("int")
    for k, p in enumerate(pieces):
        number = F.when(p.holds(F.col("x")), k).otherwise(number)
    return x.withColumn("piece", number).where("piece is not null")


def order_statistics(values: DataFrame, column: str, ranks: list[int], buckets: int = BUCKETS, listed: int = LISTED) -> dict[int, float]:
    """The values of some ranks, 0 the least, of the non-null values of a column.

    A round cuts every range of values that a wanted rank lies in at approximate quantiles
    of it, counts the pieces, a cutting value being a piece of its own, and goes on with
    those that hold a wanted rank. A piece holds about one part in `buckets` of its range,
    whatever the distribution, and heavy ties become pieces of one value; so a few rounds
    leave ranges of at most `listed` values, of which the distinct ones are listed. A round
    is two aggregations over all its ranges; the driver gets some counts for each.
    """
    x = values.select(F.col(column).cast("double").alias("x")).where("x is not null")
    found: dict[int, float] = {}
    size = x.count()
    if any(not 0 <= r < size for r in ranks):
        raise IndexError(f"ranks {ranks} of {size} values")
    pieces = [Piece(None, None, size, 0, sorted(set(ranks)))] if ranks else []
    while pieces:
        short, pieces = [p for p in pieces if p.size <= listed], [p for p in pieces if p.size > listed]
        if short:
            upto = [p.first for p in short]
            for r in _inside(x, short).groupBy("piece", "x").count().orderBy("piece", "x").collect():
                at = upto[r["piece"]]
                upto[r["piece"]] += r["count"]
                found |= {w: r["x"] for w in short[r["piece"]].wanted if at <= w < at + r["count"]}
        if not pieces:
            break
        part = _inside(x, pieces)
        shares = [k / buckets for k in range(buckets + 1)]
        of = {r["piece"]: r["q"] for r in part.groupBy("piece").agg(F.percentile_approx("x", shares, 20 * buckets).alias("q")).collect()}
        cuts = [sorted(set(of[k]), key=lambda v: (math.isnan(v), v)) for k in range(len(pieces))]
        mine = F.array(*[F.array(*map(F.lit, c)) for c in cuts])[F.col("piece")]
        # even places lie between two cuts, odd ones at a cut
        place = F.size(F.filter(mine, lambda c: F.col("x") >= c)) + F.size(F.filter(mine, lambda c: F.col("x") > c))
        smaller, upto = [], [p.first for p in pieces]
        for r in sorted(part.groupBy("piece", place.alias("place")).count().collect(), key=lambda r: (r["piece"], r["place"])):
            p, c, k, at = pieces[r["piece"]], cuts[r["piece"]], r["place"] // 2, upto[r["piece"]]
            upto[r["piece"]] += r["count"]
            wanted = [w for w in p.wanted if at <= w < at + r["count"]]
            if wanted and r["place"] % 2:
                found |= dict.fromkeys(wanted, c[k])
            elif wanted:
                smaller.append(Piece(c[k - 1] if k else p.low, c[k] if k < len(c) else p.high, r["count"], at, wanted))
        pieces = smaller
    return found


def quantiles(values: DataFrame, column: str, shares: list[float], **k) -> list[float | None]:
    """Exact quantiles with linear interpolation between two order statistics; None where there are no values. Nulls are left out, NaN is the greatest value."""
    n = values.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    places = [p * (n - 1) for p in shares]
    at = order_statistics(values, column, [r for p in places for r in (math.floor(p), math.ceil(p))], **k)
    return [at[math.floor(p)] if at[math.floor(p)] == at[math.ceil(p)] else (math.ceil(p) - p) * at[math.floor(p)] + (p - math.floor(p)) * at[math.ceil(p)] for p in places]


def quantile_columns(values: DataFrame, column: str, named: dict[str, float]) -> dict[str, Column]:
    """A literal column for each named share's quantile."""
    return {n: F.lit(q).cast("double") for n, q in zip(named, quantiles(values, column, list(named.values())), strict=True)}
