"""QR of tall, narrow matrices: an R of each task's rows, merged in a tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that a key's partial factors are merged in before they meet, and keys that a task holds at once.
SALTS, HELD = 16, 50_000
_PARTS = "key string, salt int, n long, r array<double>"


def folded(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The R of r on top of rows: as many columns, at most as many rows, no negative diagonal."""
    out = np.linalg.qr(np.vstack([r, rows]), mode="r")
    return out * np.where(np.diag(out) < 0, -1.0, 1.0)[:, None] if out.shape[0] <= out.shape[1] else out


def _partial(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, tuple[int, np.ndarray]] = {}

        def out():
            keys, n, r = list(held), [n for n, _ in held.values()], [r.ravel() for _, r in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([salt] * len(keys), pa.int32()), pa.array(n, pa.int64()), pa.array(r, pa.list_(pa.float64()))], names=["key", "salt", "n", "r"])

        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            keys, at = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            order = np.argsort(at, kind="stable")
            for key, rows in zip(keys.tolist(), np.split(x[order], np.cumsum(np.bincount(at))[:-1]), strict=True):
                n, r = held.get(key, (0, np.empty((0, width))))
                held[key] = n + len(rows), folded(r, rows)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def _merge(width: int, salted: bool):
    def run(table: pa.Table) -> pa.Table:
        r = np.empty((0, width))
        for x in table.column("r").to_pylist():
            r = folded(r, np.array(x).reshape(-1, width))
        salt = [table.column("salt")[0]] if salted else []
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip([table.column("key")[0].as_py(), *(s.as_py() for s in salt), sum(table.column("n").to_pylist()), r.ravel()], [pa.string(), *[pa.int32()] * len(salt), pa.int64(), pa.list_(pa.float64())], strict=True)], names=["key", *["salt"] * len(salt), "n", "r"])

    return run


def tall_qr(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, r): the rows of each key and the R factor, row by row, of the matrix of some columns, which hold no nulls.

    Tasks fold their rows into one small R for each key they meet; those are merged by key
    and salt, and then by key. Rows never gather: a key's share of them does not matter.
    The factor has the matrix's own condition, where sums of products have its square.
    """
    width = len(columns)
    parts = rows.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double") for c in columns]).mapInArrow(_partial(width), _PARTS)
    some = parts.groupBy("key", "salt").applyInArrow(_merge(width, True), _PARTS)
    return some.groupBy("key").applyInArrow(_merge(width, False), "key string, n long, r array<double>").withColumnRenamed("key", key)


def least_squares(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, their standard errors, condition number) of the last column on those before it, from R."""
    k = r.shape[1] - 1
    if n <= k:
        raise ValueError("too few days for this many factors")
    x, size = r[:k, :k], np.linalg.svd(r[:k, :k], compute_uv=False)
    if size[-1] <= size[0] * np.finfo(float).eps:
        raise ValueError("some factors are combinations of others")
    beta = np.linalg.solve(x, r[:k, k])
    rest = float(r[k, k] ** 2) if len(r) > k else 0.0
    return beta, np.sqrt(rest / (n - k) * (np.linalg.inv(x) ** 2).sum(axis=1)), float(size[0] / size[-1])
