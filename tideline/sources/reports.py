"""Tables of a report in a shared folder, each written as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "tideline_report"
#: Beside a table's parts, the list of those that count.
LIST = "_parts.json"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """A task's part and its rows."""

    part: str | None
    rows: int


@dataclass(frozen=True)
class Part(InputPartition):
    name: str | None


class ReportWriter(DataSourceArrowWriter):
    """Each task writes a part under a name of its own; the commit lists the parts, in one move, and an abort deletes them.

    What a task that was tried again, or a job that died, has left is in no list.
    """

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema.json(), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        fs, base = _store(self.path)
        fs.create_dir(base, recursive=True)
        name, rows, out = f"part-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=fs)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _store(self.path)
        fs.create_dir(base, recursive=True)
        before = [] if self.overwrite else listed(self.path).get("parts", [])
        parts = before + [m.part for m in messages if m is not None and m.part]
        temporary = f"{base}/_list-{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as f:
            f.write(json.dumps({"schema": self.schema, "parts": parts}).encode())
        fs.move(temporary, f"{base}/{LIST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _store(self.path)
        for m in messages:
            if m is not None and m.part:
                fs.delete_file(f"{base}/{m.part}")


def listed(path: str) -> dict:
    """The committed list of a table; empty where nothing was committed."""
    from pyarrow import fs as _fs

    fs, base = _store(path)
    if fs.get_file_info(f"{base}/{LIST}").type == _fs.FileType.NotFound:
        return {}
    with fs.open_input_stream(f"{base}/{LIST}") as f:
        return json.loads(f.read())


class ReportReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        return [Part(p) for p in listed(self.path).get("parts", [])] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if partition.name is not None:
            fs, base = _store(self.path)
            with fs.open_input_file(f"{base}/{partition.name}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class ReportSource(DataSource):
    """A report's table at `path`, in any store that Arrow opens; readers see committed parts only."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        found = listed(self.options["path"])
        if not found:
            raise ValueError(f"no report table was committed at {self.options['path']}")
        return StructType.fromJson(json.loads(found["schema"]))

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], schema, overwrite)


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table of a report under its name in a folder that driver and executors share, in place of one already there."""
    for name, df in tables.items():
        df.sparkSession.dataSource.register(ReportSource)
        df.write.format(NAME).mode("overwrite").save(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    spark.dataSource.register(ReportSource)
    return spark.read.format(NAME).load(f"{root}/{name}")
