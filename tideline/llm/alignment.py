"""Alignment of two tokenizers' tokens over the same bytes, and counts of linked token pairs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import column, drop_table, materialize, open_store, slices
from tideline.llm.token_files import Encoder

#: Pieces that the counts of a pair are dealt to in the first of two shuffles.
SALTS = 16
#: Pairs whose counts a worker holds at most, the commonest; links of rarer pairs are joined by a shuffle.
HEAD_PAIRS = 2_000_000
#: Distinct pairs that a task gathers before it passes their counts on.
GATHERED = 2_000_000
_BLANK = re.compile("(?<! ) ")
_SPACE = "▁"


class ByteSide(Encoder):
    """Tokens of a byte-level vocabulary; strings of added tokens are plain text."""

    def __init__(self, path: str, most: int = 500_000):
        super().__init__(path, most)
        self.tokenizer.encode_special_tokens, self.added = True, []
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        other = [b for b in range(256) if b not in set(plain)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)


class PieceSide:
    """Tokens of a SentencePiece model that puts a blank before a text.

    Where no piece has a blank behind another character, no merge crosses the first blank
    of a run, so texts are cut there and each distinct word is encoded once; texts of
    other models, and texts with a U+2581 of their own, are encoded whole. `most` bounds
    the words remembered.
    """

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes, self.cuts = [], True
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(_SPACE, " ").encode())
                self.cuts &= _SPACE not in piece.lstrip(_SPACE)
        self.dtype = "<u2" if len(self.bytes) <= 1 << 16 else "<u4"
        blank = sp.piece_to_id(_SPACE)
        self.cuts &= blank != sp.unk_id()
        self.most, self.known = most, {"": np.array([blank], self.dtype).tobytes()}

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.sp.encode(texts, num_threads=1)
        data = np.fromiter(chain.from_iterable(found), self.dtype).tobytes()
        ends = (np.cumsum([0, *map(len, found)]) * np.dtype(self.dtype).itemsize).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of this vocabulary's dtype."""
        known, cut = self.known, []
        for t in texts:
            if not t or not self.cuts or _SPACE in t:
                cut.append(None)
            else:
                t = " " + t
                cut.append((_BLANK.split(t) if "  " in t else t.split(" "))[1:])
        new = list(set().union(*(c for c in cut if c)) - known.keys())
        known.update(zip(new, self._ids(new), strict=True))
        whole = [t if c is None else "" for t, c in zip(texts, cut, strict=True)]
        out = [b"".join(map(known.__getitem__, c)) if c else w for c, w in zip(cut, self._ids(whole), strict=True)]
        if len(known) > self.most:  # the words met first are the common ones
            self.known = dict(islice(known.items(), self.most // 2))
        return out


def token_links(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each A token, A token of each link, B token of each link): all pairs of tokens whose bytes overlap.

    Both sides cover the same bytes. Those B tokens overlap an A token that end behind its
    start, up to the first one that ends at or behind its end.
    """
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    first = np.searchsorted(end_b, end_a - length_a, side="right")
    times = np.searchsorted(end_b, end_a, side="left") - first + 1
    before = np.cumsum(times) - times
    return times, np.repeat(np.arange(len(length_a)), times), np.arange(int(times.sum())) + np.repeat(first - before, times)


class Aligner:
    """Alignment of batches of texts; both sides' vocabularies as tables."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.length = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        self.flat = [np.frombuffer(b"".join(side.bytes), np.uint8) for side in (self.a, self.b)]
        n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        number = lambda n, end: [b"%d" % i + end for i in range(n)]
        self.labels = number(n_a, b",") + number(n_a, b"|") + number(self.n_b, b",") + number(self.n_b, b";")

    def spelled(self, side: int, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, one after the other."""
        size = self.length[side]
        start, n = (np.cumsum(size) - size)[ids], size[ids]
        return self.flat[side][np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids of blank + text by A, and of the text by B; none where either spells other bytes than blank + text."""
        want = [(" " + t).encode() if t else b"" for t in texts]
        sides = self.a.encode([" " + t if t else "" for t in texts]), self.b.encode(texts)
        good = np.ones(len(texts), bool)
        size = np.array([len(w) for w in want], np.int64)
        for k, (side, found) in enumerate(zip((self.a, self.b), sides, strict=True)):
            n = np.array([len(f) for f in found], np.int64) // np.dtype(side.dtype).itemsize
            ids = np.frombuffer(b"".join(found), side.dtype)
            doc = np.repeat(np.arange(len(texts)), n)
            same = np.bincount(doc, self.length[k][ids], len(texts)).astype(np.int64) == size
            text = np.frombuffer(b"".join([w for w, ok in zip(want, same.tolist(), strict=True) if ok]), np.uint8)
            other = np.flatnonzero(self.spelled(k, ids[same[doc]]) != text)
            if len(other):
                same[np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), other, side="right")]] = False
            good &= same
        return tuple([f if ok else b"" for f, ok in zip(found, good.tolist(), strict=True)] for found in sides)

    def arrays(self, a: list[bytes], b: list[bytes]):
        """(A ids, B ids, A tokens of each text, B tokens of each text) of a batch."""
        ids, counts = [], []
        for side, found in ((self.a, a), (self.b, b)):
            ids.append(np.frombuffer(b"".join(found), side.dtype).astype(np.int64))
            counts.append(np.array([len(f) for f in found], np.int64) // np.dtype(side.dtype).itemsize)
        return *ids, *counts

    def links(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair of each link, text of each link): a pair is its A id times the size of B, plus its B id."""
        _, i, j = token_links(self.length[0][a], self.length[1][b])
        return a[i] * self.n_b + b[j], np.repeat(np.arange(len(n_a)), n_a)[i]

    def groups(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(groups of each text, SHA-256 of their ids): groups lie between the places where tokens of both sides end."""
        end_a, end_b = np.cumsum(self.length[0][a]), np.cumsum(self.length[1][b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        g_a, g_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=len(cuts))) for g in (g_a, g_b))
        order = np.empty(len(a) + len(b), np.int64)  # a group's A tokens, then its B tokens
        size = len(self.a.bytes)
        order[np.arange(len(a)) + np.concatenate([[0], upto_b])[g_a]] = a + size * (cuts[g_a] == end_a)
        order[np.arange(len(b)) + upto_a[g_b]] = b + 2 * size + self.n_b * (cuts[g_b] == end_b)
        ends = np.cumsum(n_a + n_b).tolist()
        text = map(self.labels.__getitem__, order.tolist())
        digests = [hashlib.sha256(b"".join(islice(text, e - s))[:-1]).hexdigest() if e > s else "" for s, e in zip([0, *ends], ends, strict=False)]
        last = np.concatenate([[0], np.cumsum(n_a)])
        return np.diff(np.concatenate([[0], g_a + 1])[last]), digests


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(path_a, path_b)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n[order], first)


_TOKENS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, salt int, pairs array<long>, times array<long>"


def _aligned(path_a: str, path_b: str, step: int = 1000, chars: int = 500_000):
    types = [*[pa.int64()] * 5, pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in _TOKENS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, salt = aligner(path_a, path_b), TaskContext.get().partitionId() % SALTS
        held = [np.empty(0, np.int64)] * 2
        parts = [held]

        def passed_on(keys, n, rows=20_000):
            for i in range(0, len(keys), rows):
                row = [*[None] * 8, salt, keys[i : i + rows], n[i : i + rows]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for part, texts in slices(batch, 1, step, chars):
                ids = al.encode(texts)
                a, b, n_a, n_b = al.arrays(*ids)
                n_groups, digests = al.groups(a, b, n_a, n_b)
                pairs, doc = al.links(a, b, n_a)
                parts.append(np.unique(pairs, return_counts=True))
                out = [part.column(0), n_a, n_b, n_groups, np.bincount(doc, minlength=len(texts)), digests, *ids, *(pa.nulls(len(texts), t) for t in types[8:])]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
                if sum(len(k) for k, _ in parts) > GATHERED + 2 * len(parts[0][0]):
                    parts = [summed(*map(np.concatenate, zip(*parts, strict=True)))]
                    if len(parts[0][0]) > GATHERED:
                        yield from passed_on(*parts[0])
                        parts = [held]
        yield from passed_on(*summed(*map(np.concatenate, zip(*parts, strict=True))))

    return run


class Counts:
    """Counts of the commonest pairs, looked up by open addressing."""

    _MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, keys: np.ndarray, n: np.ndarray, best: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.key, self.n, self.best = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.key[at] < 0
            self.key[at[free]] = keys[todo[free]]  # of several for a slot the last stays
            mine = self.key[at] == keys[todo]
            self.n[at[mine]], self.best[at[mine]] = n[todo[mine]], best[todo[mine]]
            at, todo = (at[~mine] + 1) % size, todo[~mine]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * self._MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or that of a free slot."""
        at = self._slot(keys)
        odd = np.flatnonzero((self.key[at] != keys) & (self.key[at] >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) % len(self.key)
            odd = odd[(self.key[at[odd]] != keys[odd]) & (self.key[at[odd]] >= 0)]
        return at


@lru_cache(maxsize=1)
def _counts(path: str) -> Counts:
    """The table of the commonest pairs that lies at a path of the shared folder."""
    import pyarrow.dataset as ds

    fs, base = open_store(path)
    t = ds.dataset(base, filesystem=fs, format="parquet").to_table(["pair", "n", "best"])
    return Counts(*(t.column(c).to_numpy() for c in ("pair", "n", "best")))


_SUMS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<long>, rare_times array<long>"


def _sums(path_a: str, path_b: str, heads: str, step: int = 1000, most: int = 1_000_000):
    """Sums over each text's links of common pairs; its rare pairs and how often it has them."""
    names = [x.split()[0] for x in _SUMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, counts = aligner(path_a, path_b), _counts(heads)
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                j = max(1, int(np.searchsorted(np.cumsum(batch.column(1).slice(i, step)), most)))
                part = batch.slice(i, j)
                i += j
                a, b, n_a, _ = al.arrays(part.column(6).to_pylist(), part.column(7).to_pylist())
                pairs, doc = al.links(a, b, n_a)
                at = counts.find(pairs)
                there = counts.key[at] == pairs
                n, best = np.where(there, counts.n[at], 0), there & counts.best[at]
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=part.num_rows))])
                of = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: B023, E731
                odd = np.flatnonzero(~there)
                odd = odd[np.lexsort((pairs[odd], doc[odd]))]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(pairs[odd]) != 0) | (np.diff(doc[odd]) != 0)])[: len(odd)])
                places = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[odd[first]], minlength=part.num_rows))]), pa.int32())
                rare, times = (pa.ListArray.from_arrays(places, pa.array(x)) for x in (pairs[odd[first]], np.diff(np.append(first, len(odd)))))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(5)), pa.array(of(best)), pa.array(of(n)), part.column(5), rare, times], names=names)

    return run


def pair_counts(tokens: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): corpus-wide links of each pair, and whether no other pair of its B id has more.

    Tasks have counted their own links. Two shuffles add those up, first by pair and salt,
    then by pair, so that a pair that every task has met does not gather in one.
    """
    met = tokens.where("pairs is not null").select("salt", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    some = met.select("salt", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n")).groupBy("pair", "salt").agg(F.sum("n").alias("n"))
    every = materialize(some.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.pmod("pair", F.lit(size_b))
    highest = every.groupBy(b.alias("b")).agg(F.max("n").alias("highest"))  # a row for each id of B
    out = every.join(F.broadcast(highest), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    out = materialize(out, "pair-best")
    drop_table(every)
    return out


def align_tokens(docs: DataFrame, vocabulary: str, model: str, head_pairs: int = HEAD_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text.

    A is a byte-level vocabulary's encoding of a blank and the text, B a SentencePiece
    model's of the text, before which it puts the blank itself. Cumulative sums of token
    lengths give the ends, ends common to both cut the tokens into groups, and binary
    searches give each A token's run of overlapping B tokens, which repeats expand into
    links. Texts go once through the tokenizers; their ids are kept in the shared folder
    beside each task's counts of linked pairs.

    The counts of the commonest pairs, head_pairs at most, are a table that each worker
    reads from the shared folder. Where there are more, a count is chosen below which pairs
    are rare; their links are joined with their counts by a shuffle, in which no pair has
    more rows than that count.

    n_links counts links, n_best those whose pair's count is the highest of its B id, ties
    included, count_sum sums the counts over links. Null and empty texts, and texts that
    either side spells with other bytes (a U+2581 of their own is read as a blank by B),
    have no tokens: zeros and an empty groups_sha256. One row for each row of docs, repeated
    ones too, whose links count each; null ids stay null. An empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    tokens = materialize(rows.mapInArrow(_aligned(vocabulary, model), _TOKENS), "aligned", compression="zstd")
    pairs = pair_counts(tokens, len(PieceSide(model).bytes))
    bits, least, room = F.length(F.bin("n")), 1 << 62, head_pairs
    for r in sorted(pairs.groupBy(bits.alias("bits")).count().collect(), key=lambda r: -r["bits"]):  # 64 rows at most
        room -= r["count"]
        if room < 0:
            break
        least = 1 << r["bits"] - 1
    heads = materialize(pairs.where(F.col("n") >= least), "pair-heads")
    out = tokens.where("pairs is null").select(*[x.split()[0] for x in _TOKENS.split(", ")][:8]).mapInArrow(_sums(vocabulary, model, heads._tideline_path), _SUMS)
    if room >= 0:
        return out.drop("rare", "rare_times")
    out = materialize(out.withColumn("row", F.monotonically_increasing_id()), "aligned-sums")
    rare = out.where("size(rare) > 0").select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row", F.col("r.rare").alias("pair"), F.col("r.rare_times").alias("times"))
    tail = rare.join(pairs.where(F.col("n") < least), "pair")
    more = tail.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"))
    plus = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return out.join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")
