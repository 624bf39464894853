"""MinHash near-deduplication with tensored banding, every link confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import column, connected_components, drop_table, fresh, materialize, mix64, release, shingle_hashes, small, tidy

#: Hash collections and hashes in each. Two documents meet in a table if two of their
#: collections agree: at a similarity of 0.75 a collection agrees with probability
#: 0.75 ** 2, so 14 of them leave a pair unmet with probability 1.8e-4, at 0.8 with 1e-5.
#: 28 hashes make 91 tables of four hashes each, for which plain banding needs 364.
COLLECTIONS, HASHES = 14, 2
#: One-bit sketch: words of 64 bins.
SKETCH = 4
_BINS = 64 * SKETCH
#: Bitmap of a set: words of 64 places.
BITMAP = 32
#: Ids that are sent to all executors, to pick texts without a shuffle of all texts; more are joined by a shuffle.
MOST_IDS = 250_000
_SALT = np.array([int.from_bytes(hashlib.blake2b(b"minhash %d" % i, digest_size=8).digest(), "little") | 1 for i in range(2 * COLLECTIONS * HASHES)], np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """A collection's hash for each of COLLECTIONS, of a non-empty shingle set."""
    n = COLLECTIONS * HASHES
    with np.errstate(over="ignore"):
        low = np.array([((s ^ _SALT[i]) * _SALT[n + i]).min() for i in range(n)], np.uint64)
        out = np.arange(COLLECTIONS, dtype=np.uint64)
        for h in low.reshape(COLLECTIONS, HASHES).T:
            out = mix64(out ^ h)
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """One bit of the least hash in each bin; equal sets, equal sketches; a bin without hashes has 0."""
    with np.errstate(over="ignore"):
        h = s * np.uint64(0xD6E8FEB86659FD93)
    bins = (h >> np.uint64(56)).astype(np.int64)
    order = np.argsort(h)
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
    bits = np.zeros(_BINS, np.uint8)
    bits[bins[order][first]] = (mix64(h[order][first]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


_FEATURES = "doc_id long, n long, d1 long, d2 long, keys array<long>, sketch array<long>"


def _features(k: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                ns, ds, ks, sk = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_hashes(text, k)
                    ns.append(len(s))
                    ds.append(struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest()))
                    ks.append(signature(s).view(np.int64) if len(s) else None)
                    sk.append(sketch(s).view(np.int64) if len(s) else None)
                big = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int64()), pa.array([d[0] for d in ds], pa.int64()), pa.array([d[1] for d in ds], pa.int64()), pa.array(ks, big), pa.array(sk, big)], names=["doc_id", "n", "d1", "d2", "keys", "sketch"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_hashes(t, k).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "shingles"])

    return run


def _shingles(batches):
    """A row for each shingle of stored sets."""
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            sets = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
            ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.empty(0, np.int64), *sets]))], names=["doc_id", "s"])


def _bitmaps(batches):
    """A bit for each place that some shingle of a stored set hashes to."""
    for batch in batches:
        maps = np.zeros((batch.num_rows, 64 * BITMAP), np.uint8)
        for row, x in zip(maps, batch.column(1).to_pylist(), strict=True):
            row[np.frombuffer(x, np.uint64) % np.uint64(64 * BITMAP)] = 1
        maps = np.packbits(maps, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(maps), pa.list_(pa.int64()))], names=["doc_id", "bits"])


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            a, b, keep = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _likely(a: str, b: str, percent: int):
    """No pair at or over the similarity fails, but for a chance under 1e-6: sizes, and sketches within five deviations.

    Of the sketch's bins at most as many differ as there are shingles in one set only,
    and about 1 - similarity of all; half of those show in their bit.
    """
    p = percent / 100
    bins = F.least((F.col(f"{a}.n") + F.col(f"{b}.n")) * (1 - p) / (1 + p), F.lit(_BINS * (1 - p) + 5 * (_BINS * p * (1 - p)) ** 0.5))
    differ = sum(F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH))
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return sizes & (differ <= bins / 2 + 2.5 * F.sqrt(bins) + 1)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Documents with equal shingle sets form a class that its least doc_id stands for.
    A class with two collections that others share as well is put into the table of each
    pair of such collections. In a table's bucket the least doc_id is the pivot: all are
    held against it, which links most copies at once. Where a bucket's members then still
    lie in several components, the members outside the pivot's are held against all of
    other components; but what two documents share is at most what each of them shares
    with any other document of such buckets, and pairs for which that is too little are
    left out. So every pair of a bucket is compared, connected already or ruled out;
    buckets are never emitted as all pairs and have no cap. Pairs that sizes or sketches
    rule out aside, all are confirmed on the full sets, read from the texts again.

    Null texts and texts without words: n_shingles 0, linked with nothing, kept. Rows
    equal in doc_id get one row each; they are one document, which is linked where any of
    its texts is, so they share component and kept; other columns are
    ignored, an empty table gives no rows, and null ids are not supported as documents
    (their rows come back with null component and kept true).
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    feats = materialize(rows.mapInArrow(tidy(_features(k)), _FEATURES), "minhash")
    full = feats.where("n > 0 and doc_id is not null")
    first = materialize(full.groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", "n", "keys", "sketch"), "doc_id").alias("r")).select("d1", "d2", "r.*"), "minhash-class")

    # different texts of one id: their classes are linked
    text = F.struct("d1", "d2")
    several = full.groupBy("doc_id").agg(F.min(text).alias("x"), F.max(text).alias("most")).where("x <> most").select("doc_id", "x")
    several = materialize(full.select("doc_id", text.alias("y")).join(several, "doc_id").where("y <> x").select("x", "y").distinct(), "minhash-several")
    of = lambda c: first.select(text.alias(c), F.col("doc_id").alias(f"{c}_id"))
    given = materialize(several.join(of("x"), "x").join(of("y"), "y").select(F.col("x_id").alias("a"), F.col("y_id").alias("b")), "minhash-given")

    # collections that at least two classes share
    single = first.select("doc_id", F.posexplode("keys").alias("c", "key"))
    shared = materialize(single.groupBy("c", "key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("c", "key"), "minhash-shared")
    live = single.join(shared, ["c", "key"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("live")).where("size(live) > 1")
    pairs = F.flatten(F.transform("live", lambda x, i: F.transform(F.slice("live", i + 2, F.size("live")), lambda y: F.xxhash64(x["c"], x["key"], y["c"], y["key"]))))
    all_tables = materialize(live.select("doc_id", F.explode(pairs).alias("bucket")), "minhash-tables")
    pivots = materialize(all_tables.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("times")).where("times > 1").select("bucket", "pivot"), "minhash-pivots")
    tables = materialize(all_tables.join(pivots, "bucket"), "minhash-buckets")
    drop_table(several, shared, all_tables, pivots)

    brief = first.select("doc_id", "n", "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        out = pairs.join(brief.select(F.col("doc_id").alias("a"), F.struct("n", "sketch").alias("x")), "a")
        out = out.join(brief.select(F.col("doc_id").alias("b"), F.struct("n", "sketch").alias("y")), "b")
        return out.where(_likely("x", "y", percent)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "minhash-pairs")
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "minhash-wanted")
        sets = materialize(rows.join(small(wanted, MOST_IDS), "doc_id", "left_semi").mapInArrow(tidy(_sets(k)), "doc_id long, shingles binary"), "minhash-sets")
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        out = materialize(pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(tidy(_linked(percent)), "a long, b long"), "minhash-links")
        drop_table(pairs, wanted, sets)
        release(docs.sparkSession)
        return out

    to_pivot = tables.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    to_pivot = confirmed(likely(to_pivot))
    links = given.union(to_pivot)
    comp = connected_components(links)

    # buckets whose members lie in several components
    named = tables.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("bucket", "pivot", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    named = materialize(named, "minhash-named")
    drop_table(tables, comp)
    own = named.where("doc_id = pivot").select("bucket", F.col("comp").alias("home"))
    outside = materialize(named.join(own, "bucket").where("comp <> home").select("bucket", F.col("doc_id").alias("o"), F.col("comp").alias("o_comp"), "pivot"), "minhash-outside")
    mixed = materialize(outside.select("bucket").distinct(), "minhash-mixed")
    # shared with no other document of those buckets: what no link can count on
    there = named.join(mixed, "bucket")
    those = materialize(there.select("doc_id").distinct(), "minhash-there")
    sets = materialize(rows.join(small(those, MOST_IDS), "doc_id", "left_semi").mapInArrow(tidy(_sets(k)), "doc_id long, shingles binary"), "minhash-sets")
    parts = materialize(sets.mapInArrow(tidy(_shingles), "doc_id long, s long"), "minhash-shingles")
    bits = sets.mapInArrow(tidy(_bitmaps), "doc_id long, bits array<long>")
    known = materialize(parts.groupBy("s").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("s"), "minhash-known")
    held = materialize(parts.distinct().join(known, "s").groupBy("doc_id").agg(F.count(F.lit(1)).alias("held")), "minhash-held")
    seen = materialize(first.select("doc_id", "n").join(held, "doc_id").join(bits.distinct(), "doc_id").where(F.col("held") * 100 >= F.col("n") * percent), "minhash-seen")
    # plain columns that are never null: a condition on them compiles to little code
    flat = lambda side: [F.coalesce(c, F.lit(0)).alias(f"{side}_{n}") for n, c in [("n", F.col("n")), ("held", F.col("held")), *((i, F.col("bits")[i]) for i in range(BITMAP))]]
    there = there.where("doc_id <> pivot").select("bucket", F.col("doc_id").alias("m"), F.col("comp").alias("m_comp"))
    there = there.join(seen.withColumnRenamed("doc_id", "m"), "m").select("bucket", "m", "m_comp", *flat("y"))
    here = outside.join(seen.withColumnRenamed("doc_id", "o"), "o").select("bucket", "o", "o_comp", *flat("x"))
    both = F.col("x_n") + F.col("y_n")
    sizes = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    # each place that differs takes a shingle that only one of the two has
    differ = sum(F.bit_count(F.col(f"x_{i}").bitwiseXOR(F.col(f"y_{i}"))) for i in range(BITMAP))
    fits = sizes & (F.least("x_held", "y_held") * (100 + percent) >= both * percent) & (differ * (100 + percent) <= both * (100 - percent))
    more = here.join(there, "bucket").where((F.col("o_comp") != F.col("m_comp")) & fits)
    more = more.select(F.least("o", "m").alias("a"), F.greatest("o", "m").alias("b")).distinct()
    more = confirmed(more)
    comp = connected_components(links.union(more))
    drop_table(given, to_pivot, more, named, outside, mixed, those, sets, parts, known, held, seen)

    classes = first.select("d1", "d2", F.col("doc_id").alias("rep")).join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = feats.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs without the near-duplicates of a lower doc_id: one document of each component stays.

    Null and empty texts and null ids have no duplicates and stay; rows of one id stay or
    go together. An empty table gives no rows.
    """
    gone_id = fresh(docs, "gone_id")
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(small(materialize(gone, "minhash-gone"), MOST_IDS), docs["doc_id"] == F.col(gone_id), "left_anti")
