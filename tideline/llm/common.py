"""What the training-data operators share: shared-folder tables, word hashing, graph components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: blank and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tideline-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in local mode only, one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tideline/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there and survives lost executors.

    Batches to Python are kept small meanwhile, as whole texts are in them.
    """
    path, conf = new_path(df.sparkSession, tag), df.sparkSession.conf
    before = conf.get(_BATCH)
    conf.set(_BATCH, "1000")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(_BATCH, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tideline_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df._tideline_path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def tidy(run):
    """run, a function of batches, that hands this worker's freed memory back to the system when its task ends.

    Workers live on after a task, and so would what Arrow and the C library keep of it.
    """

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return out


def small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast df if its counted rows are at most `most`; beyond that Spark shuffles the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def open_store(uri: str):
    """(file system, path) for the shared folder, for use in Python workers."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return df["`" + name.replace("`", "``") + "`"]


def fresh(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hash of each lower-cased word, remembered for a bounded number of words."""

    MOST = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = WordHashes()
_P = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; a text of fewer words has its whole sequence as one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    with np.errstate(over="ignore"):
        s = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            s = s * np.uint64(_P) + h[i : len(h) - k + 1 + i]
        return np.unique(mix64(s + np.uint64(k)))


def slices(batch: pa.RecordBatch, at: int, rows: int, chars: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(part, texts of its column `at`, null as "") of up to `rows` rows and about `chars` characters; a longer text is a part of its own."""
    i = 0
    while i < batch.num_rows:
        part, room, texts = batch.slice(i, rows), chars, []
        for t in part.column(at):
            text = t.as_py() or ""
            room -= len(text)
            if texts and room < 0:
                break
            texts.append(text)
        yield part.slice(0, len(texts)), texts
        i += len(texts)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): smallest id reachable over undirected edges; ids without edges are absent.

    Large-star and small-star passes in turn, each written to the shared folder, until
    the edges are stars. Nothing but a count and a checksum reaches the driver.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc")
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        star = materialize(star, "cc")
        drop_table(e)
        e = star
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("id")).distinct()
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
    out._tideline_path = e._tideline_path  # for drop_table()
    return out
