"""Exact repeated-window removal: a depth-limited radix sort of suffixes, most significant digits first, behind a filter by anchors."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import column, drop_table, materialize, mix64, release

#: Bytes of a repeated window, and of a digit.
DEPTH, DIGIT = 400, 100
#: Windows that one suffix stands for.
STEP = 12
#: Depths of the passes over a suffix: digit by digit through all that its windows share.
PASSES = {f"d{i + 1}": min((i + 1) * DIGIT, DEPTH - STEP + 1) for i in range(-(-(DEPTH - STEP + 1) // DIGIT))}
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _B, np.uint64), np.full(n, _B_INV, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


class Rolling:
    """64-bit hashes of any substrings of data, equal for equal substrings wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        size = 1 << max(16, (n + 1).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Hashes of all substrings of that width, by start."""
        m = max(0, len(self.sums) - width)
        with np.errstate(over="ignore"):
            return mix64((self.sums[width:] - self.sums[:m]) * self.down[:m])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    m = len(x) - width + 1
    pad = -len(x) % width
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:m], left[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, digit hash, first window, number of windows) of each anchor.

    A window of DEPTH bytes has as its anchor the first of the least digit hashes inside
    it. That depends on the window's bytes alone, so equal windows hold their anchors at
    equal places. The windows of one anchor follow each other.
    """
    if len(data) < DEPTH:
        empty = np.empty(0, np.int64)
        return empty, np.empty(0, np.uint64), empty, empty
    h = rolling.every(DIGIT)
    width = DEPTH - DIGIT + 1
    low = sliding_min(h, width)
    edge = np.zeros(width - 1, np.uint64)
    high = ~sliding_min(~np.concatenate([edge, low, edge]), width)  # the greatest least of the windows that hold a place
    places = np.flatnonzero(high == h)
    at = np.searchsorted(places, np.arange(len(low)))
    off = np.flatnonzero(h[places[at]] != low)
    while len(off):
        at[off] += 1
        off = off[h[places[at[off]]] != low[off]]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    place = places[at[first]]
    return place, h[place], first, np.diff(np.append(first, len(low)))


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b, as two columns, of the bytes between starts and ends with an offset each.

    What settles a window is this digest of the bytes themselves, not the rolling hash.
    """
    view, of = memoryview(data), hashlib.blake2b
    found = b"".join([of(view[a:b], digest_size=16, salt=o.to_bytes(8, "little")).digest() for a, b, o in zip(starts.tolist(), ends.tolist(), offsets.tolist(), strict=True)])
    return np.frombuffer(found, np.int64).reshape(-1, 2)


_ANCHORS = "id long, part long, pos int, x0 int, m int, g long, c long, c2 long"


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _find_anchors(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            found = []
            for id_, key, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                text = np.frombuffer(data, np.uint8)
                pos, g, x0, m = anchors(text, Rolling(text))
                if len(pos):
                    c = digests(data, x0, x0 + m - 1 + DEPTH, pos - x0)
                    found.append((np.full(len(pos), id_), np.full(len(pos), key), pos.astype(np.int32), x0.astype(np.int32), m.astype(np.int32), _signed(g), c[:, 0], c[:, 1]))
            if found:
                names = [x.split()[0] for x in _ANCHORS.split(", ")]
                yield _batch(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))


_BLOCKS = "id long, part long, pos int, o1 int, o2 int, g long, k int, " + "".join(f"{d} long, " for d in PASSES) + "sub long, sub2 long, mine boolean"


def _find_blocks(batches):
    """Suffixes for STEP neighbouring windows each, at the last of their starts, counted from the anchor.

    Their leading digits, as hashes of all bytes through each depth of PASSES, which all
    of the windows have; and the digest of the bytes that any of the windows has.
    """
    for batch in batches:
        for id_, key, data, wants in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rolling = Rolling(np.frombuffer(data, np.uint8))
            pos, x0, m, g, mine = (np.array([w[k] for w in wants]) for k in ("pos", "x0", "m", "g", "mine"))
            low, high = pos - (x0 + m - 1), pos - x0  # least and greatest distance of an anchor behind its window's start
            k0, k1 = low // STEP, high // STEP
            n = k1 - k0 + 1
            of = np.repeat(np.arange(len(pos)), n)
            k = np.repeat(k0, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            o1, o2, p = np.maximum(k * STEP, low[of]), np.minimum(k * STEP + STEP - 1, high[of]), pos[of]
            lead = {d: _signed(rolling.of(p - k * STEP, p - k * STEP + depth)) for d, depth in PASSES.items()}
            sub = digests(data, p - o2, p - o1 + DEPTH, o2)
            yield _batch({"id": np.full(len(of), id_), "part": np.full(len(of), key), "pos": p.astype(np.int32), "o1": o1.astype(np.int32), "o2": o2.astype(np.int32), "g": g[of], "k": k.astype(np.int32), **lead, "sub": sub[:, 0], "sub2": sub[:, 1], "mine": mine[of].astype(bool)})


_WINDOWS = "id long, part long, x int, g long, h long, h2 long, mine boolean"


def _find_windows(batches):
    for batch in batches:
        for id_, key, data, wants in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            pos, o1, o2, g, mine = (np.array([w[k] for w in wants]) for k in ("pos", "o1", "o2", "g", "mine"))
            n = o2 - o1 + 1
            of = np.repeat(np.arange(len(pos)), n)
            o = o1[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            x = pos[of] - o
            h = digests(data, x, x + DEPTH, o)
            yield _batch({"id": np.full(len(of), id_), "part": np.full(len(of), key), "x": x.astype(np.int32), "g": g[of], "h": h[:, 0], "h2": h[:, 1], "mine": mine[of].astype(bool)})


def merged(starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals [start, end)."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, text string"


def _cut(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part, rows = batch.slice(i, 500), []
            for id_, data, starts, ends in zip(*(part.column(j).to_pylist() for j in range(4)), strict=True):
                data = data or b""
                if starts is None:
                    rows.append((id_, len(data), 0, 0, data, data.decode(errors="replace")))
                    continue
                s, e = merged(starts, ends)
                kept = b"".join(data[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(data)], strict=True))
                rows.append((id_, len(data), len(data) - len(kept), len(s), kept, kept.decode(errors="replace")))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _KEPT.split(", ")])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, text): texts as UTF-8 without the bytes that repeated windows cover.

    Suffixes are sorted into groups only through DEPTH bytes, most significant digit
    first; a group of one ends, and the groups left are the repeated windows.

    1. Which windows can repeat at all: a window's anchor is the DIGIT bytes of least
       hash inside it, so windows of an anchor are neighbours and travel as one row with
       the anchor's digit and a digest of all their bytes. An anchor that occurs once ends
       its windows; bytes that occur twice settle all of them at once. Of bytes that
       occur more than once one row goes on, as the others' equal.
    2. The windows left are split, at places counted from the anchor, into STEP
       neighbours. The suffix at the last of their starts leads with bytes that all of
       them have; it goes through the passes over its digits, DIGIT bytes each, and
       leaves at the first digit at which its group is one, or only of rows kept for
       others.
    3. The last bytes: windows of suffixes that stayed are held against each other in
       full, all STEP at once where possible.

    The first pass is a filter by content and takes no leading digit: a row for each start
    would shuffle eight bytes for every byte of text.

    Groups are counted, never gathered: every pass is a count by key, summed before its
    shuffle, and a join with the counts. Bytes that settle a window are compared by 128
    bits of BLAKE2b of the bytes themselves; rolling hashes only rule windows out.

    kept holds the bytes that stay; text is the same as a string, where a character that
    a window's edge cuts in two is U+FFFD. A null text is empty. Texts under DEPTH bytes stay whole. Two rows with equal id and
    text are two documents and repeat each other; a null id is allowed. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    data = column(docs, text_col).cast("string")
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, id_col).cast("long"), F.lit(-1 << 63)).alias("id"), F.xxhash64(data).alias("part"), data.cast("binary").alias("data"))
    long = rows.where(F.length("data") >= DEPTH).select("id", "part", "data")
    every_anchor = materialize(long.select("id", "part", "data").mapInArrow(_find_anchors, _ANCHORS), "suffix-anchors")

    # pass 1
    counts = materialize(every_anchor.groupBy("g", "c", "c2").agg(F.count(F.lit(1)).alias("n")), "suffix-bytes")
    digits = counts.groupBy("g").agg(F.sum("n").alias("times"), F.min("n").alias("least")).where("times > 1")
    digits = materialize(digits.select("g", (F.col("least") == 1).alias("open")), "suffix-digits")
    same = materialize(counts.join(digits, "g"), "suffix-groups")
    found = materialize(every_anchor.join(same, ["g", "c", "c2"]), "suffix-found")
    drop_table(every_anchor, counts, digits, same)
    release(spark)
    span = lambda start, end: F.struct(start.cast("int").alias("s"), end.cast("int").alias("e"))
    settled = found.where("n > 1").select("id", "part", span(F.col("x0"), F.col("x0") + F.col("m") - 1 + DEPTH).alias("span"))
    place = ("pos", "x0", "m")
    alone = found.where("n = 1").select("id", "part", "g", *place, F.lit(True).alias("mine"))
    one = found.where("n > 1 and open").groupBy("g", "c", "c2").agg(F.min(F.struct("id", "part", *place)).alias("r")).select("r.id", "r.part", "g", *(f"r.{x}" for x in place), F.lit(False).alias("mine"))
    wants = alone.union(one).groupBy("id", "part").agg(F.collect_list(F.struct(*place, "g", "mine")).alias("wants"))
    texts = materialize(long.join(wants, ["id", "part"]).select("id", "part", "data", "wants"), "suffix-texts", compression="zstd")
    release(spark)

    # pass 2
    blocks = materialize(texts.mapInArrow(_find_blocks, _BLOCKS), "suffix-blocks")
    for digit in PASSES:
        key = ["g", "k", digit]
        twice = materialize(blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("mine").alias("any")).where("n > 1 and any").select(*key), "suffix-ranks")
        left = materialize(blocks.join(twice, key).drop(digit), "suffix-left")
        drop_table(blocks, twice)
        blocks = left
    every_block = blocks
    subs = materialize(blocks.groupBy("g", "sub", "sub2").agg(F.count(F.lit(1)).alias("n")), "suffix-subs")
    blocks = materialize(blocks.join(subs, ["g", "sub", "sub2"]), "suffix-blocks-found")
    release(spark)
    settled = settled.union(blocks.where("n > 1 and mine").select("id", "part", span(F.col("pos") - F.col("o2"), F.col("pos") - F.col("o1") + DEPTH)))
    place = ("pos", "o1", "o2")
    alone = blocks.where("n = 1").select("id", "part", "g", *place, "mine")
    one = blocks.where("n > 1").groupBy("g", "sub", "sub2").agg(F.min(F.struct("id", "part", *place)).alias("r")).select("r.id", "r.part", "g", *(f"r.{x}" for x in place), F.lit(False).alias("mine"))
    wants = alone.union(one).groupBy("id", "part").agg(F.collect_list(F.struct(*place, "g", "mine")).alias("wants"))

    # pass 3
    windows = materialize(texts.drop("wants").join(wants, ["id", "part"]).select("id", "part", "data", "wants").mapInArrow(_find_windows, _WINDOWS), "suffix-windows")
    twice = materialize(windows.groupBy("g", "h", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("mine").alias("any")).where("n > 1 and any").select("g", "h", "h2"), "suffix-twice")
    settled = settled.union(windows.where("mine").join(twice, ["g", "h", "h2"]).select("id", "part", span(F.col("x"), F.col("x") + DEPTH)))
    spans = materialize(settled.groupBy("id", "part").agg(F.collect_set("span").alias("spans")).select("id", "part", F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends")), "suffix-spans")
    drop_table(texts, every_block, subs, blocks, windows, twice, found)
    release(spark)
    out = rows.join(spans, ["id", "part"], "left").select("doc_id", "data", "starts", "ends")
    return out.mapInArrow(_cut, _KEPT)
