import hashlib
import math
import pathlib
import tarfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideline.llm import media
from tideline.llm.common import new_path
from tideline.llm.token_files import Encoder, pack_blocks, read_token_files, token_files, unpack_blocks, write_token_files

BPE = str(public_tokenizers.path("byte_bpe_50k.json"))


def png(data):
    """(width, height, bits, colour, samples) of a PNG without interlacing, by the format's rules; checks every chunk."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, kinds, body = 8, [], b""
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        assert zlib.crc32(kind + content) == int.from_bytes(data[at + 8 + size : at + 12 + size], "big")
        kinds.append(kind)
        if kind == b"IHDR":
            head = content
        elif kind == b"IDAT":
            body += content
        at += 12 + size
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND" and head[10:] == bytes(3)
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    raw, samples = zlib.decompress(body), bytearray()
    assert len(raw) == height * (width + 1)
    for y in range(height):
        line = raw[y * (width + 1) : (y + 1) * (width + 1)]
        assert line[0] == 0  # no filter
        samples += line[1:]
    return width, height, head[8], head[9], bytes(samples)


def test_media_round_trip(spark, docs, corpus):
    """Every column, held against the tar members as the standard library reads them and an own PNG decoder."""
    root = new_path(spark, "test-media")
    rows = media.media_columns(docs, root).collect()
    assert len(rows) == docs.count()
    stored = {}
    for path in pathlib.Path(root.removeprefix("file://")).glob("*.tar"):
        with tarfile.open(path) as tar:
            for m in tar:
                stored[path.name, m.offset_data] = (m.name, tar.extractfile(m).read())
    for r in rows:
        data = ("a null id has words" if r.doc_id is None else corpus[r.doc_id] or "").encode()
        want = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        name, file = stored[r.shard, r.offset]
        assert (name, r.digest) == (f"{r.payload_sha256}.png", r.payload_sha256)
        assert (r.length, r.media_bytes, r.media_sha256) == (len(file), len(file), hashlib.sha256(file).hexdigest())
        width, height, bits, colour, samples = png(file)
        assert (r.width, r.height, r.bits, colour, samples) == (width, height, bits, 0, want)
        share = [n / len(want) for n in Counter(want).values()]
        mean = sum(want) / len(want)
        deviation = (sum((b - mean) ** 2 for b in want) / len(want)) ** 0.5
        said = dict(x.split("=") for x in r.feature.split()[2:])
        assert r.feature.startswith(f"gray8 {width}x{height} ") and said["distinct"] == str(len(share))
        for key, value in (("mean", mean), ("std", deviation), ("entropy", -sum(p * math.log2(p) for p in share))):
            assert float(said[key]) == pytest.approx(value, abs=1e-3)
    same = {r.media_sha256 for r in rows if r.doc_id in (60, 75)}
    assert len(same) == 1


def test_media_metadata_needs_the_header_only(spark, docs):
    root = new_path(spark, "test-media")
    index = media.write_media(docs, root)
    kept = media.places(index)
    meta = {bytes(r.digest): r for r in media.media_metadata(kept, root).collect()}
    for r in index.collect():
        m = meta[bytes(r.digest)]
        assert (m.width, m.height, m.bits) == (64, r.payload_bytes // 64, 8)
    assert media.png_header(media.to_png(b"a" * 128)[: media.HEADER]) == (64, 2, 8)
    with pytest.raises(ValueError):
        media.png_header(b"not a png" * 9)


def test_media_empty(no_docs):
    assert media.media_columns(no_docs).collect() == []


def test_token_files(docs, corpus):
    t = Tokenizer.from_file(BPE)
    texts = sorted([*corpus.items(), (81, corpus[81])]) + [(None, "a null id has words")]
    start, want = 0, []
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files(docs, BPE).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_token_files_read_back_ids(spark):
    root, text = new_path(spark, "test-tokens"), "so it goes, and so on"
    index = write_token_files(spark.createDataFrame([(3, text), (1, "x")], "doc_id long, text string"), root, BPE)
    out = read_token_files(index, root, lambda d, s, ids: (d, s, ids.tolist()), "doc_id long, start long, ids array<long>").collect()
    t = Tokenizer.from_file(BPE)
    assert {r.doc_id: r.ids for r in out} == {3: [*t.encode(text).ids, 2], 1: [*t.encode("x").ids, 2]}


def test_token_files_empty(no_docs):
    assert token_files(no_docs, BPE).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t.,'sab1é \x1c\x85²☃\0"), max_size=30), min_size=1, max_size=4))
def test_parts_are_encoded_as_the_whole(texts):
    e = _encoder()
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_literal_added_tokens_are_as_in_the_library(spark):
    t = Tokenizer.from_file(BPE)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "so<|endoftext|><|endoftext|>.\n\n  x", "one <|endoftext| > two |>", "plain <|text|>"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [505, 220, 50256, 734]
    for _ in range(2):
        assert [np.frombuffer(x, _encoder().dtype).tolist() for x in _encoder().encode(texts)] == want
    got = token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BPE).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got} == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for i, x in enumerate(want)}


def test_bounded_memory_of_parts():
    e = Encoder(BPE, most=50)
    for k in range(20):
        texts = [f"word{k * 10 + i} more. {k}" for i in range(10)]
        for t, got in zip(texts, e.encode(texts), strict=True):
            assert np.frombuffer(got, e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(e.known) <= 100


@given(st.lists(st.lists(st.integers(0, 32).map(lambda k: (1 << k) - 1) | st.integers(0, 2**32 - 1), max_size=11), max_size=6))
def test_packing(docs):
    for dtype in ("<u4", "<u2"):
        parts = [np.array(d, np.uint64).astype(dtype) for d in docs]
        counts = np.array([len(d) for d in docs], np.int64)
        blocks = pack_blocks(np.concatenate([np.empty(0, dtype), *parts]), counts)
        for block, x in zip(blocks, parts, strict=True):
            # control bytes first, two bits for an id's bytes less one, lowest first; then the bytes, little end first
            control, data, at = block[: -(-len(x) // 4)], block[-(-len(x) // 4) :], 0
            for i, v in enumerate(x.tolist()):
                n = (control[i // 4] >> 2 * (i % 4) & 3) + 1
                assert int.from_bytes(data[at : at + n], "little") == v and n == max(1, (v.bit_length() + 7) // 8)
                at += n
            assert at == len(data)
        starts = np.cumsum([0, *map(len, blocks)])[:-1]
        assert unpack_blocks(b"".join(blocks), starts, counts).tolist() == [v for x in parts for v in x.tolist()]


_made = []


def _encoder():
    if not _made:
        _made.append(Encoder(BPE))
    return _made[0]
