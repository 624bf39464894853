"""Token ids in binary files: frequency-ranked ids, byte-aligned, with control bytes apart."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import column, drop_table, materialize, new_path, open_store

#: Lengths of the four ids that a control byte describes, two bits for each, lowest first.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)
_BYTES = np.arange(4, dtype=np.uint8)
MAGIC = b"TIDEIDS1"
_RAGGED = re.compile(r" (?=\s|\Z)")
#: Sentence marks and symbols that the pattern parts from letters before them; no apostrophe.
_ENDS = "!#$%&()*+,-./:;<=>?@[\\]^`{|}~"
_MARKS = frozenset(_ENDS)
#: Mark of a part without a blank before it. No decoded UTF-8 holds a surrogate.
_BARE = "\ud800"


def _padded(counts: np.ndarray) -> np.ndarray:
    """Places of the integers of several blocks, of `counts` each, when every block is padded to a multiple of four."""
    gaps = -counts % 4
    return np.arange(int(counts.sum())) + np.repeat(np.cumsum(gaps) - gaps, counts)


def pack_blocks(ranks: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A block for each run of `counts` unsigned integers of 16 or 32 bits: its control bytes, then its data bytes."""
    wide = ranks.dtype.itemsize > 2
    r = np.ascontiguousarray(ranks, "<u4" if wide else "<u2")
    more = (r > 0xFF).view(np.uint8)  # bytes after the first
    if wide:
        more = more + (r > 0xFFFF) + (r > 0xFFFFFF)
    quarter = -(-counts // 4)
    two = np.zeros(4 * int(quarter.sum()), np.uint8)
    two[_padded(counts)] = more
    two = two.reshape(-1, 4)
    control = (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()
    size = r.dtype.itemsize
    data = r.view(np.uint8).reshape(-1, size)[_BYTES[:size] <= more[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(more, dtype=np.int64) + np.arange(1, len(r) + 1)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    at = np.concatenate([[0], np.cumsum(quarter)]).tolist()
    return [control[a:b] + data[c:d] for a, b, c, d in zip(at, at[1:], ends, ends[1:], strict=False)]


def unpack_blocks(data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The integers, by table lookup, of blocks that begin at `starts` and fill data."""
    b = np.frombuffer(data, np.uint8)
    quarter = -(-counts // 4)
    at = np.arange(int(quarter.sum())) + np.repeat(starts - np.cumsum(quarter) + quarter, quarter)
    lengths = LENGTHS[b[at]].reshape(-1)[_padded(counts)]
    size = 2 if not len(lengths) or lengths.max() <= 2 else 4
    rest = np.ones(len(b), bool)
    rest[at] = False
    out = np.zeros((len(lengths), size), np.uint8)
    out[_BYTES[:size] < lengths[:, None]] = b[rest]
    return out.view(f"<u{size}").reshape(-1)


class _Known(dict):
    """Ids of parts as bytes. A part without ids is noted in `missing`, with a buffer that its ids will be put in."""

    def __init__(self, *args):
        super().__init__(*args)
        self.missing: dict[str, bytearray] = {}

    def __missing__(self, part: str) -> bytearray:
        return self.missing.setdefault(part, bytearray())


class Encoder:
    """Ids of whole texts, by the tokenizers library on the text's words.

    The vocabulary's splitting pattern puts a blank with the visible character after it,
    so a text may be cut before each such blank and the parts be encoded apart; a part
    that comes again is not encoded again. It also parts letters from the marks behind
    them, so a word with such an end needs only the word's and the end's ids. `most`
    bounds the parts remembered. A text that holds an added token, such as a literal
    <|endoftext|>, has that token's id there, as in the library, and is encoded whole.
    """

    def __init__(self, path: str, most: int = 1_600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.most, self.known = most, _Known()

    @staticmethod
    def parts(text: str) -> list[str]:
        """The parts after the first stand without their leading blank; the first has a mark instead."""
        out = text.split(" ")
        # a part that is empty or starts with ASCII white space is the least or has one before it
        if min(out)[:1] <= " " or not text.isascii() and _RAGGED.search(text):
            joined = out[:1]
            for p in out[1:]:
                if p == "" or p[0].isspace():
                    joined[-1] += " " + p
                else:
                    joined.append(p)
            out = joined
        out[0] = _BARE + out[0]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of this vocabulary's dtype."""
        known = self.known
        whole = {i: t for i, t in enumerate(texts) if any(a in t for a in self.added)}
        found = [list(map(known.__getitem__, self.parts(t))) if t and i not in whole else [] for i, t in enumerate(texts)]
        self._learn(known.missing)
        out = [b"".join(f) for f in found]
        for i, x in zip(whole, self.tokenizer.encode_batch_fast(list(whole.values()), add_special_tokens=False), strict=True):
            out[i] = np.array(x.ids, self.dtype).tobytes()
        known.missing = {}
        if len(known) > self.most:  # the parts met first are the common ones
            self.known = _Known(islice(known.items(), self.most // 2))
        return out

    def _learn(self, missing: dict[str, bytearray]) -> None:
        known, new, ended = self.known, {}, []
        for p in missing:
            if p[-1:] not in _MARKS:  # most parts
                new[p] = None
                continue
            word = p.rstrip(_ENDS)
            if word[-1:].isalpha():
                end = _BARE + p[len(word) :]
                ended.append((p, word, end))
                if word not in known:
                    new[word] = None
                if end not in known:
                    new[end] = None
            else:
                new[p] = None
        self._encode_parts(list(new))
        for p, word, end in ended:
            known[p] = known[word] + known[end]
        for buffer, ids in zip(missing.values(), map(known.__getitem__, missing), strict=True):
            buffer += ids

    def _encode_parts(self, parts: list[str], chunk: int = 100) -> None:
        """Encode parts; those without white space inside in chunks of one to a line, as a line's end is a token of its own."""
        known = self.known
        plain, other = [], []
        for p in parts:
            (plain if p.isprintable() and " " not in p else other).append(p)
        lines = [" " + "\n ".join(plain[i : i + chunk]) for i in range(0, len(plain), chunk)]
        for i, x in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(x.ids, self.dtype)
            size = ids.itemsize
            ends = [*np.flatnonzero(ids == self.line_end).tolist(), len(ids)]
            mine = plain[i * chunk : (i + 1) * chunk]
            if len(ends) != len(mine):
                raise ValueError("this vocabulary has no token of its own for a line's end")
            data, ends = ids.tobytes(), [size * e for e in ends]
            known.update(zip(mine, [data[a:b] for a, b in zip([0, *[e + size for e in ends]], ends, strict=False)], strict=True))
        found = self.tokenizer.encode_batch_fast([p[1:] if p[:1] == _BARE else " " + p for p in other], add_special_tokens=False)
        known.update((p, np.array(x.ids, self.dtype).tobytes()) for p, x in zip(other, found, strict=True))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def _ids(batch: pa.RecordBatch, vocabulary: str, end_id: int, step: int = 512) -> Iterator[tuple]:
    encoder = _encoder(vocabulary)
    tail = np.array([end_id], encoder.dtype).tobytes()
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        texts = [t or "" for t in part.column(1).to_pylist()]
        yield from zip(part.column(0).to_pylist(), (x + tail for x in encoder.encode(texts)), strict=True)


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, part, seq, ids, counts) in ascending doc_id order: the ids of a part's seq-th document.

    The last row of a part has counts alone: how often each id occurs in the part.
    """
    types = {"doc_id": pa.int64(), "part": pa.int32(), "seq": pa.int64(), "ids": pa.binary(), "counts": pa.list_(pa.int64())}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))

    def run(batches):
        part, seq, total = TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        for batch in batches:
            rows = []
            for doc_id, ids in _ids(batch, vocabulary, end_id):
                rows.append((doc_id, part, seq, ids, None))
                seq += 1
            if rows:
                c = np.bincount(np.frombuffer(b"".join([r[3] for r in rows]), _encoder(vocabulary).dtype), minlength=len(total))
                c[: len(total)] += total
                total = c
                yield batch_of(rows)
        if seq:
            yield batch_of([(None, part, None, None, total)])

    by = F.col("doc_id").asc_nulls_last()
    return docs.repartitionByRange(by).sortWithinPartitions(by, "text").mapInArrow(run, "doc_id long, part int, seq long, ids binary, counts array<long>")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents; one row for each id that occurs. A task adds up its parts' counts first."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                c = np.array(counts.values)
                c, total = (c, total) if len(c) > len(total) else (total.copy(), c)
                c[: len(total)] += total
                total = c
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return encoded.where("counts is not null").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


_INDEX = "doc_id long, file string, part int, seq long, offset long, length long, before long, n_tokens long"


def write_token_files(docs: DataFrame, root: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every text, in ascending doc_id order, and return the index of the files.

    Documents are range-partitioned by doc_id and encoded once, into a table in the
    shared folder. All its ids are counted (the driver gets one row for each id of the
    vocabulary); the commonest id becomes rank 0. Each split of that table then becomes
    one file: per document its control bytes, then its data bytes. `ranks.u32` beside
    the files holds the id of each rank. A null text is empty: one end id. Null doc_ids
    come last; rows equal in doc_id are ordered by text.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    encoded = materialize(_encoded(rows, vocabulary, end_id), "token-ids", compression="zstd")
    counts = sorted((-r["n"], r["id"]) for r in id_counts(encoded).collect())
    by_rank = np.array([i for _, i in counts], "<u4")
    dtype = _encoder(vocabulary).dtype
    dtype_size = np.dtype(dtype).itemsize
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, dtype)
    rank_of[by_rank] = np.arange(len(by_rank))
    fs, base = open_store(root)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/ranks.u32") as f:
        f.write(by_rank.tobytes())
    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def blocks(batch, step=500):
        for i in range(0, batch.num_rows, step):
            doc_ids, parts, seqs, ids = (c.to_pylist() for c in batch.slice(i, step).columns)
            counts = np.array([len(x) for x in ids], np.int64) // dtype_size
            ranks = rank_of[np.frombuffer(b"".join(ids), dtype)]
            yield from zip(doc_ids, parts, seqs, pack_blocks(ranks, counts), counts.tolist(), strict=True)

    def write(batches):
        fs, base = open_store(root)
        name, out, last, rows = None, None, None, []

        def end():
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for doc_id, part, seq, block, count in blocks(batch):
                if last != (part, seq - 1):  # another part, or another piece of one
                    yield from end()
                    name = f"ids-{part:08d}-{seq:012d}-{uuid.uuid4().hex}.bin"
                    out, at, before, rows = fs.open_output_stream(f"{base}/{name}"), len(MAGIC), 0, []
                    out.write(MAGIC)
                last = (part, seq)
                out.write(block)
                rows.append((doc_id, name, part, seq, at, len(block), before, count))
                at += len(block)
                before += count
        yield from end()

    documents = encoded.where("seq is not null").select("doc_id", "part", "seq", "ids")
    index = materialize(documents.mapInArrow(write, _INDEX), "token-index")
    drop_table(encoded)
    return index


def read_token_files(index: DataFrame, root: str, each, fields: str) -> DataFrame:
    """each(doc_id, start, ids) for every document of the files; start counts the ids of all documents before it.

    Ids before a file are summed over the files of its part, and over the parts before it
    (as many as the encoding had partitions); a table of the files is joined to the index.
    """
    files = materialize(index.groupBy("file").agg(F.first("part").alias("part"), F.min("seq").alias("seq"), F.sum("n_tokens").alias("n")), "token-file-sizes")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    files = files.select("file", "part", before(Window.partitionBy("part").orderBy("seq")).alias("inside"))
    starts = materialize(files.join(parts, "part").select("file", (F.col("base") + F.col("inside")).alias("start")), "token-file-starts")
    rows = index.join(starts, "file").select("doc_id", "file", "offset", "length", "n_tokens", (F.col("start") + F.col("before")).alias("start"))
    names = [x.split()[0] for x in fields.split(", ")]

    def neighbours(rows, most=1 << 20):
        """Runs of rows whose blocks follow each other in a file, up to some bytes."""
        run, size = [], 0
        for r in rows:
            if run and (r[1] != run[-1][1] or r[2] != run[-1][2] + run[-1][3] or size > most):
                yield run
                run, size = [], 0
            run.append(r)
            size += r[3]
        if run:
            yield run

    def read(batches):
        fs, base = open_store(root)
        with fs.open_input_file(f"{base}/ranks.u32") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        name, f = None, None
        for batch in batches:
            found = []
            for rows in neighbours(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                doc_ids, (file, *_), offsets, lengths, counts, begins = zip(*rows, strict=True)
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{base}/{file}")
                    if f.read_at(len(MAGIC), 0) != MAGIC:
                        raise ValueError(f"{file} is not a token file")
                counts = np.array(counts, np.int64)
                ids = by_rank[unpack_blocks(f.read_at(sum(lengths), offsets[0]), np.array(offsets) - offsets[0], counts)]
                ends = np.cumsum(counts).tolist()
                found += [each(d, s, ids[a:b]) for d, s, a, b in zip(doc_ids, begins, [0, *ends], ends, strict=False)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)
        if f is not None:
            f.close()

    return rows.mapInArrow(read, fields)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2, root: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files that hold its ids.

    One row for each row of docs; an empty table gives none. Other columns are ignored.
    """
    root = root or new_path(docs.sparkSession, "tokens")
    index = write_token_files(docs, root, vocabulary, end_id)

    def each(doc_id, start, ids):
        return doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())

    return read_token_files(index, root, each, "doc_id long, start long, n_tokens long, ids_crc32 long")
