"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tideline.llm.common import column, mix64, slices, tidy

SPACE = 0x2581
#: A text's own U+2581: past Unicode, so that no piece has it and its bytes stand for it.
_OWN_SPACE = 0x110000
#: The first blank of a run, where a word begins.
_BLANK = re.compile("(?<! ) ")
#: Words filtered side by side from which a loop over lengths is faster than an array of them.
_MANY = 64
#: Mark of a word without a blank before it. No decoded UTF-8 holds a surrogate.
_BARE = "\ud800"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A character that its bytes' pieces spell: as an edge, and, more than the character, as a draw.
_SPELLED, _SPELL = -2, 1 << 22


class Lattice:
    """The pieces of a model, and sampling among the ways to write a text with them.

    A segmentation's probability is proportional to the product of its pieces' weights,
    (rank + 10) ** -theta for a piece of that rank in the model and FALLBACK for a
    character spelled in byte pieces. A model with a piece that has a blank behind another
    character is refused; without one the lattice falls apart into words, each with all blanks before it, so each distinct
    word of a batch is filtered once and its occurrences are sampled from the same sums.
    Words are whole, however long.
    """

    FALLBACK = 1e-6

    def __init__(self, path: str, theta: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = []
        self.byte_id = np.zeros(256, np.int64)
        found = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
                self.byte_id[self.bytes[-1][0]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                self.bytes.append(piece.replace(chr(SPACE), " ").encode())
                if chr(SPACE) in piece.lstrip(chr(SPACE)):
                    raise ValueError(f"{path} has a piece with a blank behind another character: {piece!r}")
                found.append((piece, i, (10.0 - sp.get_score(i)) ** -theta))
        self.id_type = np.int16 if n <= 1 << 15 else np.int32
        self.longest = max(len(p) for p, _, _ in found)
        cps = [np.frombuffer(p.encode("utf-32-le"), "<u4") for p, _, _ in found]
        hashes = []
        for c in cps:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for x in c:
                    h = h * _BASE + np.uint64(x) + np.uint64(1)
            hashes.append(h)
        # open addressing with linear probing
        self.bits = 18
        self.slot_hash = np.zeros(1 << self.bits, np.uint64)
        self.slot_id = np.full(1 << self.bits, -1, np.int32)
        self.slot_weight = np.zeros(1 << self.bits)
        for h, (_, i, w) in zip(hashes, found, strict=True):
            s = self._slot(h)
            while self.slot_id[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.slot_hash[s], self.slot_id[s], self.slot_weight[s] = h, i, w

    def _slot(self, h):
        with np.errstate(over="ignore"):
            return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, weight) of each hash."""
        at = self._slot(h)
        ids, weights = self.slot_id[at], self.slot_weight[at]
        odd = np.flatnonzero((ids >= 0) & (self.slot_hash[at] != h))
        at = at[odd]
        while len(odd):
            at = (at + 1) & ((1 << self.bits) - 1)
            ids[odd], weights[odd] = self.slot_id[at], self.slot_weight[at]
            on = (self.slot_id[at] >= 0) & (self.slot_hash[at] != h[odd])
            odd, at = odd[on], at[on]
        weights[ids < 0] = 0
        return ids, weights

    @staticmethod
    def words(text: str) -> list[str]:
        """Words without their first blank; the first, which has none, has a mark instead."""
        out = _BLANK.split(text) if "  " in text else text.split(" ")
        out[0] = _BARE + out[0]
        return out

    def edges(self, words: list[str]):
        """(first node of each word, its characters, all characters, ids, weights): edges from each node, one for each length."""
        bare = np.array([w[:1] == _BARE for w in words], bool)
        flat = np.frombuffer("".join(w[1:] if b else " " + w for w, b in zip(words, bare, strict=True)).encode("utf-32-le", "surrogatepass"), "<u4").copy()
        size = np.array([len(w) for w in words], np.int64) - bare + ~bare
        start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        flat[flat == SPACE] = _OWN_SPACE
        flat[flat == ord(" ")] = SPACE
        left = np.repeat(start + size, size) - np.arange(len(flat))
        n, most = len(flat), self.longest
        ids, weights = np.full((n, most), -1, np.int32), np.zeros((n, most), np.float32)
        h = np.zeros(n, np.uint64)
        at = np.arange(n)
        with np.errstate(over="ignore"):
            for k in range(1, most + 1):
                at = at[left[at] >= k]
                if not len(at):
                    break
                h[at] = h[at] * _BASE + flat[at + k - 1].astype(np.uint64) + np.uint64(1)
                ids[at, k - 1], weights[at, k - 1] = self.find(h[at])
        spell = np.flatnonzero(ids[:, 0] < 0)
        weights[spell, 0] = self.FALLBACK
        ids[spell, 0] = np.where(flat[spell] < 128, self.byte_id[np.minimum(flat[spell], 127)], _SPELLED)
        return start, size, flat, ids, weights

    def filtered(self, words: list[str], chunk: int = 160_000):
        """(start, size, characters, ids, sums).

        ids are those of edges(); sums are, for each node but a word's first, the running
        shares over the lengths of its last edge. Words are filtered in chunks of about
        `chunk` characters, as the weights are needed for a chunk only; a longer word is
        filtered over several.
        """
        parts, first, room = [], 0, chunk
        for i, w in enumerate([*words, ""]):
            room -= len(w)
            if i > first and (room < 0 or i == len(words)):
                some = words[first:i]
                parts.append(self._filtered(some) if len(some[0]) <= chunk else self._carried(some[0], chunk))
                first, room = i, chunk - len(w)
        before = np.cumsum([0] + [len(p[2]) for p in parts])
        start = np.concatenate([p[0] + b for p, b in zip(parts, before, strict=False)])
        return start, *(np.concatenate([p[k] for p in parts]) for k in range(1, 5))

    def _filtered(self, words: list[str]):
        start, size, flat, ids, weights = self.edges(words)
        order = np.argsort(-size, kind="stable")
        length = size[order]
        sums = self._sums(np.ones(len(ids) + 1), weights, start[order], length, 1, int(length[0]))
        return start, size, flat, ids.astype(self.id_type), sums

    def _carried(self, word: str, chunk: int):
        """_filtered() of one word, `chunk` characters at a time; the last nodes' alpha goes on to the next."""
        text, most, parts, known = word[1:] if word[:1] == _BARE else " " + word, self.longest, [], np.ones(1)
        for a in range(0, len(text), chunk):
            low, b = max(0, a + 1 - most), min(a + chunk, len(text))
            _, size, flat, ids, weights = self.edges([_BARE + text[low : b + most]])
            alpha = np.ones(len(ids) + 1)
            alpha[: len(known)] = known
            sums = self._sums(alpha, weights, np.zeros(1, np.int64), size, a - low + 1, b - low)
            parts.append([x[a - low : b - low] for x in (flat, ids.astype(self.id_type), sums)])
            known = alpha[max(0, b + 1 - most) - low : b - low + 1]
        return np.zeros(1, np.int64), np.array([len(text)]), *map(np.concatenate, zip(*parts, strict=True))

    def _sums(self, alpha: np.ndarray, weights: np.ndarray, begin: np.ndarray, length: np.ndarray, first: int, last: int) -> np.ndarray:
        """Running shares of the last edges' lengths, for the nodes behind characters `first` to `last` of each word, longest first.

        alpha is that of the node before each character, a word's first node having 1. A
        word's last alphas are scaled by a power of two time and again, which leaves the
        shares as they are and keeps long words from vanishing.
        """
        most = self.longest
        sums = np.ones((len(weights), most), np.float32)  # of the node behind each character
        back = np.arange(1, most + 1)
        for j in range(first, last + 1):
            m = int(np.searchsorted(-length, -j, side="right"))
            at = begin[:m] + j
            if m < _MANY:
                k = back[:j]
                run = (alpha[at[:, None] - k] * weights[at[:, None] - k, k - 1]).cumsum(axis=1).T
            else:
                run = np.empty((min(j, most), m))
                for k in range(1, len(run) + 1):
                    np.multiply(alpha[at - k], weights[at - k, k - 1], out=run[k - 1])
                    if k > 1:
                        run[k - 1] += run[k - 2]
            total = run[-1]
            sums[at - 1, : len(run)] = (run / total).T
            more = length[:m] > j
            at, total = at[more], total[more]
            alpha[at] = total
            if j % most == 0:
                near = at[:, None] + 1 - back
                alpha[near] = np.ldexp(alpha[near], -np.frexp(total)[1][:, None])
        return sums

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text, a draw from its segmentations that its seed determines."""
        split = [self.words(t) if t else [] for t in texts]
        words = list(set().union(*split))
        if not words:
            return [np.empty(0, np.int32) for _ in texts]
        index = dict(zip(words, range(len(words)), strict=True))
        start, size, flat, ids, sums = self.filtered(words)
        count = np.array([len(s) for s in split], np.int64)
        which = np.fromiter(map(index.__getitem__, chain.from_iterable(split)), np.int64, int(count.sum()))
        first = np.cumsum(count) - count
        long = size[which]
        turns = (long >> 20) + 1  # of 2**20 numbers, one for each character
        nth = np.cumsum(turns) - turns
        nth -= np.repeat(nth[np.minimum(first, len(nth) - 1)], count)
        with np.errstate(over="ignore"):
            seed = np.repeat(seeds, count) + nth.astype(np.uint64) * np.uint64(1 << 20)
        place = np.cumsum(long) - long
        out = np.full(int(long.sum()), -1, np.int64)
        at = np.flatnonzero(long)
        j = long[at]
        base = start[which]
        while len(at):
            node = base[at] + j - 1
            with np.errstate(over="ignore"):
                u = (mix64(seed[at] + j.astype(np.uint64)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            k = (sums[node] <= u[:, None]).sum(axis=1)
            over = np.flatnonzero(k >= self.longest)
            if len(over):
                k[over] = self.longest - 1 - (np.diff(sums[node[over]], axis=1, prepend=np.float32(0)) > 0)[:, ::-1].argmax(axis=1)
            j = j - 1 - k
            piece = ids[base[at] + j, k].astype(np.int64)
            spelled = np.flatnonzero(piece == _SPELLED)
            piece[spelled] = _SPELL + flat[base[at[spelled]] + j[spelled]]
            out[place[at] + j] = piece
            on = j > 0
            at, j = at[on], j[on]
        kept = out >= 0
        behind = np.cumsum(kept)
        chars = np.add.reduceat(np.append(long, 0), np.minimum(first, len(long))) * (count > 0)
        ends = np.cumsum(chars)
        bounds = np.concatenate([[0], np.where(ends > 0, behind[ends - 1], 0)])
        drawn = out[kept]
        return [self._spelled(drawn[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _spelled(self, ids: np.ndarray) -> np.ndarray:
        """ids with each character that no piece has as the pieces of its bytes."""
        if not (ids >= _SPELL).any():
            return ids.astype(np.int32)
        out = []
        for i in ids.tolist():
            if i < _SPELL:
                out.append(i)
            else:
                c = SPACE if i - _SPELL == _OWN_SPACE else i - _SPELL
                out.extend(self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass"))
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        """The text that the pieces spell."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def lattice(path: str, theta: float = 1.0) -> Lattice:
    return Lattice(path, theta)


def seeds_of(keys: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(str(k), seed) for k in keys], np.uint64)


_OUT = "doc_id long, n_pieces long, ids array<int>, ids_crc32 long, lossless boolean"


def encode_pieces(docs: DataFrame, model: str, theta: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", step: int = 400) -> DataFrame:
    """(doc_id, n_pieces, ids, ids_crc32, lossless) of every whole text.

    The draw depends on seed, id and text alone, not on partitions or batches; rows equal
    in both are drawn alike. lossless is whether the ids decode to the text, null for a
    null text. Null and empty texts have no pieces; null ids draw as "None". An empty table gives no rows;
    other columns are ignored.
    """

    def run(batches):
        lat = lattice(model, theta)
        for batch in batches:
            for part, texts in slices(batch, 1, step, 1_250_000):  # each character of a distinct word takes some 100 bytes
                found = lat.sample(texts, seeds_of(part.column(0).to_pylist(), seed))
                same = [lat.decode(x) == t if ok else None for x, t, ok in zip(found, texts, part.column(1).is_valid().to_pylist(), strict=True)]
                crc = [zlib.crc32(np.ascontiguousarray(x, "<i4").tobytes()) for x in found]
                sizes = np.array([len(x) for x in found], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *found])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), lists, pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "ids_crc32", "lossless"])

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), _OUT)


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows that have doc_id and ids: null for null ids, empty for none; null and repeated doc_ids stay as they are."""

    def run(batches):
        lat = lattice(model)
        for batch in batches:
            texts = [None if x is None else lat.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
