"""Vector codes: integer codebooks of a vector's parts, entries found by exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tideline.llm.common import column, drop_table, fresh, materialize

#: Labels whose sums are sent to all executors; the sums of more are joined by a shuffle.
MOST_LABELS = 100_000
#: Pieces that a label's rows are dealt to in that shuffle.
SALTS = 32


def whole_vectors(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


class Codebooks:
    """Integer entries, shaped (parts, entries, width), and each entry's others in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = entries[:, :, None, :] - entries[:, None, :, :]
        apart = (gap * gap).sum(axis=3)
        self.near = np.argsort(apart, axis=2, kind="stable")  # ties by index; an entry's equals, itself among them, come first
        self.apart = np.take_along_axis(apart, self.near, axis=2)

    def assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance), shaped (rows, parts), of the parts of vectors x, shaped (rows, parts, width).

        Exponion search: from the entry `start`, at distance d, any entry that is as near
        is at most 2 d from the start entry, so only the head of its list of neighbours is
        scanned, up to four times the squared distance. All numbers are integers, so that
        bound and all ties are exact; of equally near entries the lowest index wins.
        """
        code, error = np.empty(start.shape, np.int64), np.empty(start.shape, np.int64)
        for p, (entries, near, apart) in enumerate(zip(self.entries, self.near, self.apart, strict=True)):
            y, s = x[:, p], start[:, p]
            gap = y - entries[s]
            bound = 4 * (gap * gap).sum(axis=1)
            ahead = np.empty(len(y), np.int64)
            for e in np.unique(s):
                at = np.flatnonzero(s == e)
                ahead[at] = np.searchsorted(apart[e], bound[at], side="right")
            order = np.argsort(-ahead, kind="stable")
            y, s, left = y[order], s[order], np.sort(-ahead)
            best, found = bound[order] // 4, s.copy()
            for rank in range(int(-left[0]) if len(left) else 0):
                m = int(np.searchsorted(left, -rank, side="left"))  # those whose list is longer than rank
                e = near[s[:m], rank]
                gap = y[:m] - entries[e]
                d = (gap * gap).sum(axis=1)
                better = (d < best[:m]) | ((d == best[:m]) & (e < found[:m]))
                best[:m][better], found[:m][better] = d[better], e[better]
            code[order, p], error[order, p] = found, best
        return code, error

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _parts_of(lists: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors of integers as an array (rows, parts, width), shorter ones filled up with zeros."""
    length = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), parts * width), np.int64)
    out[np.arange(parts * width) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(len(lists), parts, width)


def _least(n: int):
    """Of a task's rows the least vector of each of its n least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            heads = sorted({*ids, *best}, key=lambda i: (i is None, i or 0))[:n]
            wanted = set(heads)
            at = [k for k, i in enumerate(ids) if i in wanted]
            for k, vec in zip(at, batch.column(1).take(pa.array(at, pa.int64())).to_pylist(), strict=True):
                best[ids[k]] = min(vec, best.get(ids[k], vec))
            best = {i: best[i] for i in heads}
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.list_(pa.int64()))], names=["vec_id", "ints"])

    return run


_CODED = "vec_id long, label {label}, ints array<long>, code binary, error long, at array<int>, total array<long>, times array<long>"


def _assign(books: Codebooks, last: bool, kind: pa.DataType, step: int = 4096):
    """Codes of a task's vectors; unless this is the last assignment, the sums of each entry's parts follow in one row."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width), np.int64)
        times = np.zeros(parts * entries, np.int64)
        types = [pa.int64(), kind, pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["vec_id", "label", "ints", "code", "error", "at", "total", "times"]
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                x = _parts_of(part.column(2), parts, width)
                before = [c or bytes(2 * parts) for c in part.column(3).to_pylist()]
                start = np.frombuffer(b"".join(before), "<u2").reshape(len(x), parts).astype(np.int64)
                code, error = books.assign(x, start)
                if not last:
                    flat = (code + np.arange(parts) * entries).ravel()
                    np.add.at(total, flat, x.reshape(-1, width))
                    times += np.bincount(flat, minlength=len(times))
                codes = pa.array([c.tobytes() for c in code.astype("<u2")], pa.binary())
                none = [pa.nulls(len(x), t) for t in types[5:]]
                ints = pa.nulls(len(x), types[2]) if last else part.column(2)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(kind), ints, codes, pa.array(error.sum(axis=1)), *none], names=names)
        if times.any():
            used = np.flatnonzero(times)
            row = [None, None, None, None, None, used.tolist(), total[used].ravel().tolist(), times[used].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return run


def _moved(books: Codebooks, coded: DataFrame) -> Codebooks:
    """Entries at the floor of the mean of their parts. Tasks have summed up theirs; the driver gets a row for each component of an entry."""
    parts, entries, width = books.entries.shape
    sums = coded.where("at is not null").select(F.posexplode("at").alias("k", "entry"), "total", "times")
    pos = F.posexplode(F.slice("total", F.col("k") * width + 1, width)).alias("pos", "part_sum")
    sums = sums.select("entry", F.col("times")[F.col("k")].alias("n"), pos)
    new = books.entries.reshape(-1, width).copy()
    for r in sums.groupBy("entry", "pos").agg(F.sum("part_sum").alias("s"), F.sum("n").alias("n")).collect():
        new[r["entry"], r["pos"]] = r["s"] // r["n"]
    return Codebooks(new.reshape(parts, entries, width))


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row whose vector is whole and finite.

    A component x becomes the integer floor(scale * x), and a vector `parts` equal parts.
    Each part position has a codebook of `entries` parts, at first those of the rows with
    the smallest ids. Each round assigns every part to its nearest entry and moves each
    entry to the floor of the mean of its parts, unused ones staying; a last assignment
    gives the codes, two hex digits a part (more where there are over 256 entries).

    Every assignment starts at the entry of the one before (the first at entry 0), reads
    the vectors and codes that the last one wrote to the shared folder, and sums up its
    parts by entry inside the task; a row for each entry's component reaches the driver.
    label_error sums `error` over equal labels, nulls together, whatever their share of
    the rows: sums are made before they are joined, by broadcast where labels are few and
    else in salted pieces.

    Vectors that are null or hold null or non-finite components give no row. Every other
    row counts, repeated ones too; equal ids stand for one entry, the least vector of
    them, and null ids come after all others. Where lengths differ, or are no multiple of
    `parts`, vectors are taken as followed by zeros up to the next multiple above the
    longest (a part has one component at least). Components so large that squared distances would not fit 64 bits are an error. An empty table gives no rows;
    other columns are ignored.
    """
    vec = column(vectors, vec_col).cast("array<double>")
    rows = vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, label_col).alias("label"), vec.alias("vec")).where(whole_vectors(F.col("vec")))
    ints = materialize(rows.select("vec_id", "label", F.transform("vec", lambda x: F.floor(x * scale).cast("long")).alias("ints")), "vector-ints")
    longest, low, high = ints.agg(F.max(F.size("ints")), F.min(F.array_min("ints")), F.max(F.array_max("ints"))).first()
    out = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    if longest is None:
        return ints.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).select(*out)
    width = max(1, -(-longest // parts))
    if 16 * max(-(low or 0), high or 0) ** 2 * width * parts >= 1 << 63:
        raise ValueError(f"components from {low} to {high}: squared distances do not fit 64 bits")
    least = ints.select("vec_id", "ints").mapInArrow(_least(entries), "vec_id long, ints array<long>").groupBy("vec_id").agg(F.min("ints").alias("ints"))
    least = least.orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).select("ints").collect()
    first = _parts_of(pa.array([r["ints"] for r in least], pa.list_(pa.int64())), parts, width)
    books, kind = Codebooks(first.transpose(1, 0, 2).copy()), vectors.schema[label_col].dataType
    schema = _CODED.format(label=kind.simpleString())
    table = ints.withColumn("code", F.lit(None).cast("binary"))
    for turn in range(rounds + 1):
        coded = materialize(table.select("vec_id", "label", "ints", "code").mapInArrow(_assign(books, turn == rounds, to_arrow_type(kind)), schema), "vector-coded")
        if turn < rounds:
            books = _moved(books, coded)
        drop_table(ints)
        ints, table = coded, coded.where("at is null")
    digits = 2 if entries <= 256 else 4
    code = F.lower(F.hex("code")) if digits == 4 else F.regexp_replace(F.lower(F.hex("code")), "(..)..", "$1")
    if digits == 4:  # stored low byte first
        code = F.regexp_replace(code, "(..)(..)", "$2$1")
    rows = table.select("vec_id", "label", code.alias("code"), "error", F.lit(books.digest()).alias("codebooks_sha256"))
    return _with_sums(rows, materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "vector-labels")).select(*out)


def _with_sums(rows: DataFrame, sums: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """label_error beside every row: by broadcast up to `most` labels, else by label and salt."""
    name = fresh(rows, "sum_label")
    sums = sums.withColumnRenamed("label", name)
    same = rows["label"].eqNullSafe(sums[name])
    if sums.count() <= most:
        return rows.join(F.broadcast(sums), same)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    sums = sums.withColumn("sum_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(sums.hint("shuffle_merge"), rows["label"].eqNullSafe(sums[name]) & (rows["salt"] == sums["sum_salt"]))
