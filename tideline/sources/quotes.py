"""Stored quotes as a data source that takes filters and reads a partition for each asset and year."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

NAME = "tideline_quotes"
_PUSH = "spark.sql.python.filterPushdown.enabled"
_ONE = dt.timedelta(days=1)


@dataclass(frozen=True)
class Span(InputPartition):
    """Quotes of an asset, or of all, from one day to before another; None for no bound."""

    asset: str | None = None
    start: dt.date | None = None
    end: dt.date | None = None


@dataclass
class Wanted:
    """What filters leave of the quotes."""

    assets: tuple[str, ...] | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    known: set[str] = field(default_factory=set)

    def only(self, assets) -> None:
        mine = tuple(dict.fromkeys(a for a in assets if a is not None))
        self.assets = mine if self.assets is None else tuple(a for a in self.assets if a in mine)

    def since(self, day: dt.date) -> None:
        self.start = day if self.start is None else max(self.start, day)

    def until(self, day: dt.date) -> None:
        self.end = day if self.end is None else min(self.end, day)

    def take(self, f: Filter) -> bool:
        """Whether the source sees to the filter by itself."""
        match f:
            case In(("asset",), values):
                self.only(values)
            case EqualTo(("asset",), value):
                self.only([value])
            case GreaterThanOrEqual(("day",), value) if value is not None:
                self.since(value)
            case GreaterThan(("day",), value) if value is not None:
                self.since(value + _ONE)
            case LessThan(("day",), value) if value is not None:
                self.until(value)
            case LessThanOrEqual(("day",), value) if value is not None:
                self.until(value + _ONE)
            case EqualTo(("day",), value) if value is not None:
                self.since(value)
                self.until(value + _ONE)
            case IsNotNull((name,)):
                self.known.add(name)
            case _:
                return False
        return True

    def spans(self) -> list[Span]:
        """A partition for each asset and year where those are known."""
        if self.start is not None and self.end is not None:
            years = range(self.start.year, (self.end - _ONE).year + 1) if self.start < self.end else []
            times = [(max(self.start, dt.date(y, 1, 1)), min(self.end, dt.date(y + 1, 1, 1))) for y in years]
        else:
            times = [(self.start, self.end)]
        return [Span(a, *t) for a in (self.assets if self.assets is not None else [None]) for t in times]


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.zone = options["path"], options.get("zone", "UTC")
        self.names = {c: options.get(c, c) for c in ("day", "asset", "close")}
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Span]:
        # without any span nothing is wanted; Spark needs a partition to read
        return self.wanted.spans() or [Span(start=dt.date.max, end=dt.date.min)]

    def dataset(self):
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return ds.dataset(base, filesystem=files, format="parquet")

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        """Row groups without quotes of the partition are not read, nor are other columns."""
        if partition.start == dt.date.max:
            return
        data = self.dataset()
        day, asset = (pc.field(self.names[c]) for c in ("day", "asset"))
        kind = data.schema.field(self.names["day"]).type
        keep = pc.scalar(True)
        for name in sorted(self.wanted.known):
            keep = keep & pc.is_valid(pc.field(self.names[name]))
        if partition.asset is not None:
            keep = keep & (asset == partition.asset)
        for bound, compare in ((partition.start, pc.greater_equal), (partition.end, pc.less)):
            if bound is not None:
                keep = keep & compare(day, self.moment(bound, kind))
        for b in data.to_batches(columns=list(self.names.values()), filter=keep):
            if b.num_rows:
                days = b.column(0)
                if pa.types.is_timestamp(kind):
                    if self.instants(kind):
                        days = pc.local_timestamp(days.cast(pa.timestamp("us"), safe=False).cast(pa.timestamp("us", self.zone)))
                    days = pc.floor_temporal(days, unit="day")
                yield pa.RecordBatch.from_arrays([days.cast(pa.date32()), b.column(1).cast(pa.string()), b.column(2).cast(pa.float64())], names=["day", "asset", "close"])

    @staticmethod
    def instants(kind: pa.DataType) -> bool:
        """Whether a timestamp stands for an instant: one with a zone, or one of the old 96-bit form, which Arrow gives as nanoseconds without."""
        return kind.tz is not None or kind.unit == "ns"

    def moment(self, day: dt.date, kind: pa.DataType) -> pa.Scalar:
        """The start of a day as the stored column has it."""
        if not pa.types.is_timestamp(kind):
            return pa.scalar(day, kind)
        start = pa.array([dt.datetime(day.year, day.month, day.day)], pa.timestamp("us"))
        if self.instants(kind):
            start = pc.assume_timezone(start, self.zone, ambiguous="earliest", nonexistent="latest").cast(pa.timestamp("us", "UTC"))
            start = start if kind.tz else start.cast(pa.timestamp("us"))
        return start.cast(kind)[0]


class QuoteSource(DataSource):
    """Parquet quotes at `path`, in any store that Arrow opens, as (day, asset, close).

    Options day, asset and close name the stored columns; day is a date or a timestamp,
    whose dates are those of `zone`. Filters on asset and day are taken over: with both, a
    partition is planned for each asset and year.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        reader = QuoteReader(self.options)
        have = reader.dataset().schema.names
        if missing := [c for c in reader.names.values() if c not in have]:
            raise ValueError(f"the price table has no {', '.join(missing)} column")
        return "day date, asset string, close double"

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(self.options)


def read_quotes(spark: SparkSession, path: str, assets: list[str], start: str | None = None, end: str | None = None, **names: str) -> DataFrame:
    """As sources.panel.read_prices(), through the data source; end is excluded.

    Registers the source, and lets the session hand filters to Python sources.
    """
    from pyspark.sql import functions as F

    spark.dataSource.register(QuoteSource)
    spark.conf.set(_PUSH, "true")
    df = spark.read.format(NAME).options(zone=spark.conf.get("spark.sql.session.timeZone"), **names).load(path)
    df = df.where(F.col("asset").isin(assets))
    if start:
        df = df.where(F.col("day") >= F.lit(start).cast("date"))
    return df.where(F.col("day") < F.lit(end).cast("date")) if end else df
