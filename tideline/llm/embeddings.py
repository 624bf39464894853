"""Embedding near-deduplication: inverted lists with product-quantised residuals, exact cosine at the end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import column, connected_components, materialize, small

#: Vectors that the quantisers are fitted on at most, and vectors for each of their lists.
FIT_ROWS, FIT_LIST = 65_536, 16
#: Vector lengths that get quantisers of their own; others are compared in one list.
FIT_LENGTHS = 8
#: Rows of a list, and queries of it, that meet in one group at about most.
CHUNK = 512
#: Rows of the table of lists that are sent to all executors; more are joined by a shuffle.
MOST_CHUNKS = 250_000


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centres by Lloyd's rounds from a seeded choice of distinct rows."""
    start = np.random.default_rng(seed).permutation(len(x))[:k]
    c = x[np.sort(start)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, step: int = 1024) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.empty(0, np.int64), *((half - x[i : i + step] @ c.T).argmin(axis=1) for i in range(0, len(x), step))])


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # or squares could be zero or infinite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Quantiser:
    """Coarse centres, and a codebook of residuals for each of some subspaces."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int = 8, codes: int = 256) -> Quantiser:
        centres = k_means(x, min(lists, len(x)))
        cuts = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int).tolist()
        rest = x - centres[nearest(x, centres)]
        return cls(centres, [k_means(rest[:, a:b], min(codes, len(x)), 6) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)

    @classmethod
    def single(cls, length: int) -> Quantiser:
        """One list around the origin, one code: rules nothing out."""
        return cls(np.zeros((1, length)), [np.zeros((1, length))], [0, length])

    def parts(self):
        return zip(self.cuts, self.cuts[1:], self.books, strict=False)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, distance to what the codes stand for) of unit vectors."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in self.parts()], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, i]] for i, (_, _, book) in enumerate(self.parts())], axis=1)
        return cell, codes, np.linalg.norm(rest - back, axis=1)

    def probes(self, x: np.ndarray, cell: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists whose region is at most `reach` away from each vector, its own among them.

        The way to another list's region is at least that to the plane between its centre and one's own.
        """
        size = (self.centres**2).sum(axis=1)
        d = size - 2 * x @ self.centres.T
        own = d[np.arange(len(x)), cell][:, None]
        c = self.centres[cell]
        apart = np.sqrt(np.maximum(0, size[cell][:, None] - 2 * c @ self.centres.T + size))
        near = d - own <= 2 * reach * apart + 1e-6
        near[np.arange(len(x)), cell] = True
        return [np.flatnonzero(row) for row in near]

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances, by table lookup, of queries to the coded vectors of a list."""
        rest = q - self.centres[cell]
        total = np.zeros((len(q), len(codes)))
        for i, (a, b, book) in enumerate(self.parts()):
            table = (rest[:, a:b] ** 2).sum(axis=1)[:, None] - 2 * rest[:, a:b] @ book.T + (book**2).sum(axis=1)
            total += table[:, codes[:, i]]
        return np.sqrt(np.maximum(total, 0))


class Models(dict):
    """A quantiser for each vector length; a length that none was fitted for has a single list."""

    def __missing__(self, length: int) -> Quantiser:
        return Quantiser.single(length)


def reach(least: float, length: int, sigmas: float | None) -> float:
    """How far from a vector lists are probed.

    The distance r of a linked pair in two lists is at least the sum of both ways to the
    plane between them, so that one way is at most r / 2: no pair is lost at that reach.
    With `sigmas`, only so many deviations of a random difference's share along the plane's
    normal are probed, which is less for long vectors and loses links of others: vectors
    near a circle or of low rank differ in the very directions that part the lists.
    """
    return float(np.sqrt(2 - 2 * least)) / 2 * (1.0 if sigmas is None else min(1.0, sigmas / np.sqrt(length)))


_INDEX = "vec_id long, label long, length int, times long, vec binary, cell int, codes binary, err double, probes array<int>"


def _index(models: Models, least: float, sigmas: float | None, wide: bool):
    kind = np.float64 if wide else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                lengths = pc.list_value_length(part.column(3)).to_numpy()
                for n in np.unique(lengths).tolist():
                    some = part.take(pa.array(np.flatnonzero(lengths == n)))
                    x = np.array(some.column(3).to_pylist(), kind)
                    model, u = models[n], unit(x.astype(np.float64))
                    cell, codes, err = model.encode(u)
                    probes = model.probes(u, cell, reach(least, n, sigmas))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.full(len(x), n, np.int32)), some.column(2), pa.array([r.tobytes() for r in x]), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in codes]), pa.array(err), pa.array(probes, pa.list_(pa.int32()))], names=[c.split()[0] for c in _INDEX.split(", ")])

    return run


def least_of_parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place that links (a, b) connect it with."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _meet(models: Models, least: float, wide: bool, step: int = 256):
    kind, radius = np.float64 if wide else np.float32, np.sqrt(2 - 2 * least)

    def vectors(column) -> np.ndarray:
        return unit(np.stack([np.frombuffer(v, kind) for v in column.to_pylist()]).astype(np.float64))

    def run(table: pa.Table) -> pa.Table:
        stored = table.column("stored").to_numpy(zero_copy_only=False).astype(bool)
        here, asks = table.filter(pa.array(stored)), table.filter(pa.array(~stored))
        out = [np.empty(0, np.int64)] * 3
        if len(here) and len(asks):
            cell, model = table.column("cell")[0].as_py(), models[table.column("length")[0].as_py()]
            x, y = vectors(asks.column("vec")), vectors(here.column("vec"))
            ids, at = np.unique(np.concatenate([asks.column("vec_id").to_numpy(), here.column("vec_id").to_numpy()]), return_inverse=True)
            qi, li = at[: len(x)], at[len(x) :]
            times = np.zeros(len(ids), np.int64)
            times[at] = np.concatenate([asks.column("times").to_numpy(), here.column("times").to_numpy()])
            codes = np.stack([np.frombuffer(v, np.uint8) for v in here.column("codes").to_pylist()])
            bound = radius + here.column("err").to_numpy() + 1e-9
            home = asks.column("home").to_numpy()
            sees = np.zeros((len(model.centres), len(y)), bool)  # whether a stored vector probes the list itself
            for j, p in enumerate(here.column("probes").to_pylist()):
                sees[p, j] = True
            n, a, b = np.zeros(len(ids), np.int64), [], []
            for i in range(0, len(x), step):
                q = qi[i : i + step]
                s, t = np.nonzero((model.distances(x[i : i + step], cell, codes) <= bound) & (q[:, None] != li))
                linked = np.einsum("ij,ij->i", x[i : i + step][s], y[t]) >= least
                s, t = s[linked], t[linked]
                np.add.at(n, q[s], times[li[t]])
                once = ~sees[home[i : i + step][s], t]  # such a pair meets here only, so both ends count it
                np.add.at(n, li[t[once]], times[q[s[once]]])
                a.append(q[s])
                b.append(li[t])
            root = least_of_parts(len(ids), np.concatenate(a), np.concatenate(b))
            some = np.flatnonzero((n > 0) | np.isin(np.arange(len(ids)), np.concatenate(b)))
            out = [ids[some], n[some], ids[root[some]]]
        return pa.table({"vec_id": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.int64())})

    return run


def similar_vectors(vectors: DataFrame, least: float = 0.93, sigmas: float | None = None, fit_rows: int = FIT_ROWS, chunk: int = CHUNK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector.

    Equal vectors of a label are one class, which its least id stands for and which
    counts as often as it occurs, so copies are never paired. Coarse centres and residual
    codebooks are fitted on at most fit_rows classes, in the order of a hash of their ids;
    every class is indexed and every class is a query. There are as many lists as the
    root of the largest label's classes, at most fit_rows / FIT_LIST.

    A query probes each list whose region is within half the distance r that the least
    cosine leaves two unit vectors, as one of a linked pair in two lists is so near the
    border: no link is lost, however the vectors lie. A pair meets where either probes the
    other's list; met once, both count it. Of a list all vectors whose table-lookup distance
    is within r and their own coding error get the exact cosine, in double precision: the
    codes lose nothing either. `sigmas` probes less and may lose links, see reach().

    Lists and queries meet in chunks of about `chunk` rows, each pair of chunks a task's
    group; links are counted there and leave as a count and a least id for each vector.

    Links need equal labels and lengths. Of a sample's lengths the FIT_LENGTHS commonest
    have quantisers; any other length is one list for each label, compared in full. A null
    label or id, and a vector that is null, empty, zero or has null or non-finite parts,
    links with nothing (component_id is its own id). Rows equal in id are one vector, the
    least usable (label, vector) of them, and get the same result. An empty table gives no
    rows; other columns are ignored.
    """
    wide = vectors.schema[vec_col].dataType.elementType.typeName() != "float"
    vec = column(vectors, vec_col)
    v = vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, label_col).cast("long").alias("label"), (vec.cast("array<double>") if wide else vec).alias("vec"))
    usable = v.where("vec_id is not null and label is not null and forall(vec, x -> x is not null and abs(x) < double('Infinity')) and exists(vec, x -> x <> 0)")
    one = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r"))
    one = materialize(one.select("vec_id", "r.*", F.xxhash64("r.vec").alias("h1"), F.xxhash64(F.lit("second"), "r.vec").alias("h2")), "vectors")
    same = one.groupBy("label", "h1", "h2").agg(F.min(F.struct("vec_id", "vec")).alias("r"), F.count(F.lit(1)).alias("times"))
    same = materialize(same.select("label", "h1", "h2", "times", "r.*"), "vector-classes")
    largest = same.groupBy("label").count().agg(F.max("count")).first()[0]
    every = v.select("vec_id")
    if not largest:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    lists = max(1, min(int(np.ceil(np.sqrt(largest))), fit_rows // FIT_LIST))
    sample = same.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(fit_rows, max(4096, 2 * FIT_LIST * lists))).select("vec").collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["vec"]), []).append(r["vec"])
    common = sorted(by_length, key=lambda n: (-len(by_length[n]), n))[:FIT_LENGTHS]
    models = Models({n: Quantiser.fit(unit(np.array(by_length[n], np.float64)), lists) for n in common})
    cells = vectors.sparkSession.sparkContext.broadcast(models)  # some megabytes at most

    index = same.select("vec_id", "label", "times", "vec").mapInArrow(lambda b: _index(cells.value, least, sigmas, wide)(b), _INDEX)
    index = materialize(index, "vector-index")
    place, rest = ["label", "length", "cell"], ["vec_id", "times", "vec"]
    asked = index.select("label", "length", F.explode("probes").alias("cell"), *rest, F.col("cell").alias("home"))
    parts = lambda df, name: df.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))
    chunks = small(materialize(parts(index, "l_chunks").join(parts(asked, "q_chunks"), place), "vector-chunks"), MOST_CHUNKS)
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = index.join(chunks, place).select(*place, *rest, "codes", "err", "probes", F.lit(None).cast("int").alias("home"), own("l_chunks", 1).alias("l"), all_of("q_chunks").alias("q"), F.lit(True).alias("stored"))
    asked = asked.join(chunks, place).select(*place, *rest, F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("err"), F.lit(None).cast("array<int>").alias("probes"), "home", all_of("l_chunks").alias("l"), own("q_chunks", 2).alias("q"), F.lit(False).alias("stored"))
    # one column, as rows that a join has dealt by label and cell would be left where they are
    met = stored.unionByName(asked).withColumn("group", F.struct(*place, "l", "q"))
    met = met.groupBy("group").applyInArrow(lambda t: _meet(cells.value, least, wide)(t), "vec_id long, n long, root long")
    met = materialize(met, "vector-links")
    n = met.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comp = connected_components(met.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "vec_id")
    of_class = same.select("label", "h1", "h2", "times", "vec_id").join(n, "vec_id", "left").join(comp, "vec_id", "left")
    of_class = of_class.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
    found = one.select("vec_id", "label", "h1", "h2").join(of_class, ["label", "h1", "h2"]).select("vec_id", "n_links", "component")
    component = F.coalesce("component", "vec_id")
    return every.join(found, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
