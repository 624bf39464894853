"""Moments kept as a table of states, to which a run adds the new days only."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.gram import finish_blocks, span_states
from tideline.operators.moments import shrinkage, shrunk
from tideline.operators.returns import daily_returns, densify
from tideline.sources.panel import SMOOTHING, part_sums, smoothed_prices

_COMMIT = "batch long, day date"
_STATES = "fourth boolean, span int, bi int, bj int, state binary"
_SUMS = "day date, asset string, v long, q long"


@dataclass(frozen=True)
class MomentStore:
    """Co-moment states of the returns of part prices, in a folder that driver and executors share.

    A batch holds the states of its days, which are added to those of other batches when
    they are read, and the sums that the next batch's first prices still need, the last
    64 rows of each asset. It counts once its commit, written last, is there: what a run
    that died has left is written over by the next. Days come in order; line items that
    arrive for a day already taken are not seen.
    """

    spark: SparkSession
    root: str
    assets: tuple[str, ...]
    benchmark: str

    def commits(self) -> list[tuple[int, dt.date]]:
        """(batch, its last day), in order: a row for each run."""
        rows = self._read("commits", _COMMIT)
        return sorted((r["batch"], r["day"]) for r in rows.collect()) if rows is not None else []

    def _read(self, name: str, schema: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else None

    def new_sums(self, sf_dir: str, upto: dt.date | None = None) -> DataFrame:
        """part_sums() of the days after the last commit; those days' line items alone are read."""
        done = self.commits()
        return part_sums(self.spark, sf_dir, done[-1][1] if done else None, upto)

    def add(self, sf_dir: str, upto: dt.date | None = None) -> int:
        """Add the days that are new, to and with `upto`; the number of rows of sums that were new."""
        done = self.commits()
        batch, last = (done[-1][0] + 1, done[-1][1]) if done else (0, None)
        self.new_sums(sf_dir, upto).write.mode("overwrite").parquet(f"{self.root}/sums/batch={batch}")
        new = self._read(f"sums/batch={batch}", _SUMS)
        n, day = new.agg(F.count(F.lit(1)), F.max("day")).first()
        if not n:
            return 0
        tail = self._read(f"tail/batch={batch - 1}", _SUMS)
        every = new if tail is None else tail.unionByName(new)
        newest = Window.partitionBy("asset").orderBy(F.desc("day"))
        kept = every.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= SMOOTHING + 1).drop("nth")
        kept.write.mode("overwrite").parquet(f"{self.root}/tail/batch={batch}")
        returns = daily_returns(densify(smoothed_prices(every), [*self.assets, *[self.benchmark] * (self.benchmark not in self.assets)]))
        if last is not None:
            returns = returns.where(F.col("day") > F.lit(last))
        states = None
        for fourth in (False, True):
            s = span_states(returns if fourth else returns.where("ret is not null"), [], list(self.assets), fourth).select(F.lit(fourth).alias("fourth"), "span", "bi", "bj", "state")
            states = s if states is None else states.union(s)
        states.write.mode("overwrite").parquet(f"{self.root}/states/batch={batch}")
        self.spark.createDataFrame([(batch, day)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return n

    def states(self, fourth: bool) -> DataFrame:
        """(bi, bj, state) of all committed batches."""
        done = [b for b, _ in self.commits()]
        every = self._read("states", f"{_STATES}, batch int")
        return every.where(F.col("batch").isin(done) & (F.col("fourth") == fourth)).select("bi", "bj", "state")

    def sample_cov(self, days: int = 252) -> DataFrame:
        """As moments.sample_cov() of all days so far."""
        rows = finish_blocks(self.states(False), [], list(self.assets), False)
        return rows.select("asset_i", "asset_j", (F.try_divide("c", F.col("n") - 1) * days).alias("cov"))

    def shrunk_cov(self, days: int = 252) -> DataFrame:
        """As moments.shrunk_cov() of all days so far."""
        parts = finish_blocks(self.states(True), [], list(self.assets), True).select("asset_i", "asset_j", "s", "q", "n")
        return shrunk(parts, shrinkage(parts), days)
