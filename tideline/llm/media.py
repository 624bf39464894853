"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import column, drop_table, materialize, new_path, open_store

WIDTH = 64
#: Bytes of a stored file up to the end of its IHDR chunk: all that metadata needs.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """data with bytes 0 up to a positive multiple of unit."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """The payload as samples of an 8-bit grey PNG, 64 to a row, without loss."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first bytes of a stored file."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a stored media file")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a file that to_png() made."""
    width, height, bits = png_header(data)
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += n + 12
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width * bits // 8 + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not what this store writes")
    return rows[:, 1:].tobytes()


def feature(payload: bytes, width: int, height: int) -> str:
    """A few statistics of the samples, the same for equal payloads."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256) / len(x)
    p = counts[counts > 0]
    return f"gray8 {width}x{height} mean={x.mean():.3f} std={x.std():.3f} entropy={abs(float(-(p * np.log2(p)).sum())):.4f} distinct={len(p)}"


INDEX = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_INDEX_DDL = "doc_id long, digest binary, n_bytes long, payload_bytes long, shard string, offset long, length long"


def _pack(root: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(root)
        fs.create_dir(base, recursive=True)
        out, at, rows, seen = None, 0, [], {}

        def end():
            nonlocal out, rows, at
            if out is not None:
                out.write(b"\0" * 1024)
                out.close()
            done, rows, out, at = rows, [], None, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), INDEX.types, strict=True)], schema=INDEX)

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                payload = padded(data or b"")
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if out is None:
                        name = f"{uuid.uuid4().hex}.tar"
                        out = fs.open_output_stream(f"{base}/{name}")
                    stored = to_png(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(stored)
                    head = info.tobuf(tarfile.USTAR_FORMAT if len(stored) < 8 << 30 else tarfile.GNU_FORMAT)
                    out.write(head + stored + b"\0" * (-len(stored) % 512))
                    seen[digest] = (name, at + len(head), len(stored))
                    at += len(head) + len(stored) + -len(stored) % 512
                rows.append((doc_id, digest, len(data or b""), len(payload), *seen[digest]))
            if at >= shard_bytes:
                yield end()
        if rows:
            yield end()

    return run


def write_media(docs: DataFrame, root: str, shard_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text of docs under root; (doc_id, digest, n_bytes, payload_bytes, shard, offset, length).

    The index is written to the shared folder, so shards are written once. Payloads are
    addressed by their SHA-256: a task stores a payload once; copies that several tasks
    met are stored by each, of which places() names one. A shard's rows leave a task only
    after the shard is closed; what a lost task leaves behind is unreferenced.
    """
    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_pack(root, shard_bytes), _INDEX_DDL), "media-index")


def places(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length) of each payload: of its stored copies the least (shard, offset)."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


_PLACE = ["digest", "shard", "offset", "length"]
_META = "digest binary, shard string, offset long, length long, width long, height long, bits long"
_READ = _META + ", payload_sha256 binary, tail_crc32 long, media_sha256 binary, feature string"
#: Stored bytes that one task reads at about most while that leaves at most MOST_READERS tasks; beyond that tasks read more.
READ_BYTES, MOST_READERS = 16 << 20, 50_000


def _by_place(stored: DataFrame) -> DataFrame:
    """Payloads in the order of their places, as many partitions as their bytes need."""
    total = stored.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(1, min(-(-total // READ_BYTES), MOST_READERS))
    return stored.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _reader(root: str, fields: str, row):
    names, types = zip(*((f.split()[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in fields.split(", ")), strict=True)

    def run(batches):
        fs, base = open_store(root)
        shard, f = None, None
        for batch in batches:
            found = []
            for r in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if r[1] != shard:
                    if f is not None:
                        f.close()
                    shard, f = r[1], fs.open_input_file(f"{base}/{r[1]}")
                found.append((*r, *row(f, r)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=list(names))
        if f is not None:
            f.close()

    return run


def media_metadata(stored: DataFrame, root: str) -> DataFrame:
    """places() with width, height and bits of each stored file, from a range read of its first 33 bytes."""

    def row(f, r):
        return png_header(f.read_at(min(HEADER, r[3]), r[2]))

    return _by_place(stored.select(*_PLACE)).mapInArrow(_reader(root, _META, row), _META)


def read_media(described: DataFrame, root: str) -> DataFrame:
    """media_metadata() with what each payload's bytes, read back, hold."""

    def row(f, r):
        stored = f.read_at(r[3], r[2])
        payload = from_png(stored)
        return hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), hashlib.sha256(stored).digest(), feature(payload, r[4], r[5])

    columns = [x.split()[0] for x in _META.split(", ")]
    return _by_place(described.select(*columns)).mapInArrow(_reader(root, _READ, row), _READ)


def media_columns(docs: DataFrame, root: str | None = None) -> DataFrame:
    """Every row's payload stored, described by its header alone, and read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 and feature; then the media columns: digest, shard, offset and length,
    by which the payload is found, and width, height and bits from header range reads. A
    null text is an empty one: 64 zero bytes. Equal texts share one stored file; repeated
    rows stay, one row out for each row in. An empty table gives no rows; other columns
    of docs are ignored.
    """
    root = root or new_path(docs.sparkSession, "media")
    index = write_media(docs, root)
    stored = materialize(places(index), "media-places")
    described = materialize(media_metadata(stored, root), "media-headers")
    drop_table(stored)
    rows = index.select("doc_id", "digest", "n_bytes", "payload_bytes").join(read_media(described, root), "digest")
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select("doc_id", "n_bytes", "payload_bytes", text("payload_sha256"), "tail_crc32", F.col("length").alias("media_bytes"), text("media_sha256"), "feature", text("digest"), "shard", "offset", "length", "width", "height", "bits")
