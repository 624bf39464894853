"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import column, slices

# Classes of characters: letters, those of them that contractions are made of, digits and so on.
LETTER, DIGIT, OTHER, BLANK, SPACE, QUOTE, ENDS, R, V, L, E, NOTHING = range(12)
# States of the splitter, by what was read last. FRESH: what follows begins a part. QUOTED: a
# quote that begins a part; the last three: such a quote and r, v or l.
FRESH, LETTERS, DIGITS, OTHERS, BLANKS, SPACES, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(10)
#: What a transition says: a part begins at the character read, or at the one before it.
HERE, BEFORE = 1, 2
_UNKNOWN = 255


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what it says) by state and class, of the transducer that cuts texts into parts.

    Parts are contractions ('s 't 'm 'd 're 've 'll), runs of letters, of digits or of other
    marks with the blank before them, and runs of white space, whose last character stays
    apart where something follows. NOTHING pads texts: it changes no state.
    """
    step = np.zeros((10, 12), np.uint8)
    says = np.zeros((10, 12), np.uint8)
    run_of = {LETTER: LETTERS, ENDS: LETTERS, R: LETTERS, V: LETTERS, L: LETTERS, E: LETTERS, DIGIT: DIGITS, OTHER: OTHERS}
    for state in range(10):
        for kind in range(11):
            if kind in (BLANK, SPACE):
                step[state, kind] = BLANKS if kind == BLANK else SPACES
                says[state, kind] = 0 if state in (BLANKS, SPACES) else HERE
            elif kind == QUOTE:
                step[state, kind] = OTHERS if state in (OTHERS, BLANKS, QUOTED) else QUOTED
                says[state, kind] = BEFORE if state == BLANKS else 0 if state in (OTHERS, QUOTED) else HERE | BEFORE * (state == SPACES)
            else:
                to = run_of[kind]
                step[state, kind] = to
                says[state, kind] = BEFORE if state == BLANKS else HERE | BEFORE if state == SPACES else 0 if state == to or (state, to) == (QUOTED, OTHERS) else HERE
    step[QUOTED, ENDS], says[QUOTED, ENDS] = FRESH, 0
    for kind, pending in ((R, QUOTED_R), (V, QUOTED_V), (L, QUOTED_L)):
        step[QUOTED, kind], says[QUOTED, kind] = pending, 0
        step[pending], says[pending] = step[LETTERS], says[LETTERS] | BEFORE  # no contraction: the letter begins a part
        second = L if kind == L else E
        step[pending, second], says[pending, second] = FRESH, 0
    step[:, NOTHING], says[:, NOTHING] = np.arange(10), 0
    return step, says


class Monoid:
    """All maps of states that texts can make, numbered, and the number of a map after another.

    Map 0 changes nothing; map k + 1 is that of class k. There are few, so a chunk's map is
    one number, and maps compose by a look into a table.
    """

    def __init__(self, step: np.ndarray):
        number, self.maps = {tuple(range(len(step))): 0}, [tuple(range(len(step)))]

        def named(m):
            if m not in number:
                number[m] = len(self.maps)
                self.maps.append(m)
            return number[m]

        self.of_class = np.array([named(tuple(step[:, k].tolist())) for k in range(step.shape[1])])
        k = 0
        while k < len(self.maps):  # close under one more character
            for c in range(step.shape[1]):
                named(tuple(step[s, c] for s in self.maps[k]))
            k += 1
        self.then = np.array([[number[tuple(b[s] for s in a)] for b in self.maps] for a in self.maps], np.int32)
        self.state = np.array(self.maps, np.uint8)

    def scan(self, maps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The composition of all maps before each one, back to the `first` of its run: a prefix scan in log steps."""
        at = np.arange(len(maps))
        out = np.where(at > first, np.concatenate([[0], maps[:-1]]), 0)
        far = 1
        while far < len(maps):
            reach = at - far >= first
            if not reach.any():
                break
            behind = out[at[reach] - far]
            out = out.copy()
            out[reach] = self.then[behind, out[reach]]
            far *= 2
        return out


class Merges:
    """The merges of a vocabulary, and which tokens can stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {}
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault((vocab[a], vocab[b]), k)
        self.bytes = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        # (token, rank of the merge that it goes into) from the whole token down its right or left edge
        never = len(pairs)
        self.right = {i: ((i, never),) for i, b in self.bytes.items() if len(b) == 1}
        self.left = dict(self.right)
        for k, (a, b) in enumerate(pairs):
            x, y, whole = vocab[a], vocab[b], vocab[a + b]
            if whole not in self.right and x in self.right and y in self.right and not self.crossed(x, y, k):
                self.right[whole] = ((whole, never), (y, k), *self.right[y][1:])
                self.left[whole] = ((whole, never), (x, k), *self.left[x][1:])
        self._known: dict[tuple[int, int], bool] = {}

    def crossed(self, x: int, y: int, top: int) -> bool:
        """Whether some merge across the border of tokens x and y comes before those inside them, or before rank `top`.

        Merges go by rank, equal ones from the left: the piece at the end of x is still there
        for a merge of lower rank than its own, that at the start of y for one of equal rank too.
        """
        rank = self.rank
        for p, p_gone in self.right[x]:
            for q, q_gone in self.left[y]:
                k = rank.get((p, q))
                if k is not None and k < min(p_gone, top) and k <= q_gone:
                    return True
        return False

    def fit(self, x: int, y: int) -> bool:
        """Whether the bytes of x and y together are encoded as x, y; -1 stands for the start of a part."""
        if x < 0:
            return True
        known = self._known.get((x, y))
        if known is None:
            if len(self._known) > 1_000_000:
                self._known.clear()
            known = self._known[(x, y)] = not self.crossed(x, y, 1 << 62)
        return known


class PartCounter:
    """A deterministic transducer over the bytes of a part, each transition giving the tokens it adds.

    A state is what can still matter of the bytes read: each place from which some longer
    token may begin (its node in the tree of tokens), the last token before that place, and
    how many tokens lie before it, against all tokens so far. The encoding of a prefix ends
    with the one token, of those ending there, that fits the last token before it; so the
    next state and the change of the count follow from a state and a byte. States are made
    when first met and looked up by open addressing afterwards; beyond `most` of them all
    are forgotten and made again, which changes no count.
    """

    _MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, merges: Merges, most: int = 400_000):
        self.merges, self.most = merges, most
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for i in merges.right:
            node = 0
            for b in merges.bytes[i]:
                self.inner[node] = True
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = nxt
            self.token[node] = i
        self.forget()

    def forget(self) -> None:
        start = (0, -1, 0)
        self.number, self.states = {start: 0}, [start]
        self.bits, self.filled = 16, 0
        self.key, self.next, self.adds = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def advance(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """(next state, change of the count)."""
        child, tokens, inner, fit = self.child, self.token, self.inner, self.merges.fit
        on, last, more = [], -1, 0
        for k in range(0, len(state), 3):
            node = child.get(state[k] << 8 | byte)
            if node is None:
                continue
            if tokens[node] >= 0 and last < 0 and fit(state[k + 1], tokens[node]):
                last, more = tokens[node], state[k + 2] + 1
            if inner[node]:
                on += node, state[k + 1], state[k + 2]
        on[2::3] = [d - more for d in on[2::3]]
        return (*on, 0, last, 0), more

    def _named(self, state: tuple) -> int:
        n = self.number.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * self._MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or that of a free slot."""
        at = self._slot(keys)
        there = self.key[at]
        odd = np.flatnonzero((there != keys) & (there >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & ((1 << self.bits) - 1)
            there = self.key[at[odd]]
            odd = odd[(there != keys[odd]) & (there >= 0)]
        return at

    def _put(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        while 2 * (self.filled + len(keys)) > 1 << self.bits:
            old = np.flatnonzero(self.key >= 0)
            held = self.key[old], self.next[old], self.adds[old]
            self.bits += 1
            self.key, self.next, self.adds = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            self.filled = 0
            self._put(*held)
        self.filled += len(keys)
        while len(keys):
            at = self.find(keys)
            self.key[at] = keys  # of several for a slot the last stays
            mine = self.key[at] == keys
            self.next[at[mine]], self.adds[at[mine]] = to[mine], adds[mine]
            keys, to, adds = keys[~mine], to[~mine], adds[~mine]

    def _learn(self, keys: np.ndarray) -> None:
        found = [self.advance(self.states[k >> 8], k & 255) for k in keys.tolist()]
        self._put(keys, np.array([self._named(s) for s, _ in found], np.int32), np.array([n for _, n in found], np.int32))

    def counts(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, few: int = 24) -> np.ndarray:
        """Tokens of the parts that begin at `start` in data and have `size` bytes each: all side by side, the last few long ones apart."""
        if len(self.states) > self.most:
            self.forget()
        order = np.argsort(-size, kind="stable")
        begin, left = start[order], -size[order]
        state, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        j = 0
        while (m := int(np.searchsorted(left, -j, side="left"))) > few:
            keys = state[:m] << 8 | data[begin[:m] + j]
            at = self.find(keys)
            new = self.key[at] != keys
            if new.any():
                self._learn(np.unique(keys[new]))
                at = self.find(keys)
            state[:m] = self.next[at]
            n[:m] += self.adds[at]
            j += 1
        for k in range(m):
            n[k] += self._alone(self.states[state[k]], data[begin[k] + j : begin[k] - left[k]].tobytes())
        out = np.empty_like(n)
        out[order] = n
        return out

    def _alone(self, state: tuple, rest: bytes) -> int:
        """Tokens that the rest of one part adds; its transitions are remembered apart, `most` at most."""
        known, n = {}, 0
        for b in rest:
            found = known.get((state, b))
            if found is None:
                if len(known) > self.most // 4:
                    known.clear()
                found = known[(state, b)] = self.advance(state, b)
            state, more = found
            n += more
        return n


class Counter:
    """Token counts of texts by the compiled transducers of one vocabulary file."""

    def __init__(self, path: str, chunk: int = 256):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        added = spec.get("added_tokens") or []
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that strip or need words")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.step, self.says = splitter()
        self.monoid, self.chunk = Monoid(self.step), chunk
        self.kinds = np.full(0x110000, _UNKNOWN, np.uint8)
        for kind, chars in ((BLANK, " "), (QUOTE, "'"), (ENDS, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e")):
            self.kinds[[ord(c) for c in chars]] = kind
        self.parts = PartCounter(Merges(model["vocab"], model["merges"]))
        if set(range(256)) - {b[0] for b in self.parts.merges.bytes.values() if len(b) == 1}:
            raise ValueError(f"{path} lacks tokens for some bytes")

    def kind_of(self, char: str) -> int:
        """The class that the library has a character in, by what it joins it with."""
        joins = lambda with_: len(self.pre.pre_tokenize_str(with_ + char)) == 1
        return LETTER if joins("a") else DIGIT if joins("0") else OTHER if joins("!") else SPACE

    def classes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out = self.kinds[points]
        if (out == _UNKNOWN).any():
            for c in np.unique(points[out == _UNKNOWN]).tolist():
                self.kinds[c] = self.kind_of(chr(c))
            out = self.kinds[points]
        return out

    def starts(self, kinds: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a part begins at each character of texts that lie one after the other, `size` characters each.

        Texts are cut into chunks. All chunks are read side by side, first into the map of
        states that each makes; a prefix scan composes the maps of a text's chunks into the
        state that each chunk starts in, and a second reading says where parts begin.
        """
        chunks = -(-size // self.chunk)
        text = np.repeat(np.arange(len(size)), chunks)
        first = np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = (np.cumsum(size) - size)[text] + (np.arange(len(text)) - first) * self.chunk
        end = np.minimum(begin + self.chunk, np.cumsum(size)[text])
        longest = int((end - begin).max(initial=0))
        at = begin[:, None] + np.arange(longest)
        lanes = np.where(at < end[:, None], kinds[np.minimum(at, len(kinds) - 1)], NOTHING).T.astype(np.int64)
        then, of_class = self.monoid.then.ravel(), self.monoid.of_class
        maps = np.zeros(len(text), np.int64)
        for row in lanes:
            maps = then[maps * len(self.monoid.maps) + of_class[row]]
        state = self.monoid.state[self.monoid.scan(maps, first), FRESH].astype(np.int64)
        step, says = self.step.ravel().astype(np.int64), self.says.ravel()
        said = np.empty(lanes.shape, np.uint8)
        for j, row in enumerate(lanes):
            k = state * self.step.shape[1] + row
            said[j], state = says[k], step[k]
        told = np.zeros(len(kinds) + 1, np.uint8)
        told[1:] = said.T[at < end[:, None]]
        out = (told[1:] & HERE > 0) | (np.append(told[2:], 0) & BEFORE > 0)
        last = np.flatnonzero(np.diff(text, append=-1) != 0)
        out[end[last[state[last] >= QUOTED_R]] - 1] = True  # a text ends with a quote and a letter
        return out

    def pieces(self, text: str, most: int) -> Iterator[str]:
        """A text's segments between its added tokens, in pieces of about `most` characters that end before a blank within a line, where a part begins."""
        for segment in self.added.split(text) if self.added else [text]:
            at, room = 0, most
            while len(segment) - at > room:
                k = self.classes(segment[at : at + room])
                full = (k != BLANK) & (k != SPACE)
                cut = np.flatnonzero((k[1:-1] == BLANK) & full[:-2] & full[2:])
                if len(cut):
                    yield segment[at : at + int(cut[-1]) + 1]
                    at, room = at + int(cut[-1]) + 1, most
                else:
                    room *= 2
            yield segment[at:]

    def count(self, texts: list[str], most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, tokens) of each text."""
        n_bytes, n = np.array([len(t.encode()) for t in texts], np.int64), np.zeros(len(texts), np.int64)
        run, of, room = [], [], most
        for i, text in enumerate(texts):
            if self.added:
                n[i] += len(self.added.findall(text))
            for piece in self.pieces(text, most) if len(text) > most or self.added and self.added.search(text) else [text]:
                if piece:
                    if room < len(piece) and run:
                        np.add.at(n, of, self._count(run))
                        run, of, room = [], [], most
                    run.append(piece)
                    of.append(i)
                    room -= len(piece)
        if run:
            np.add.at(n, of, self._count(run))
        return n_bytes, n

    def _count(self, texts: list[str]) -> np.ndarray:
        joined = "".join(texts)
        data = np.frombuffer(joined.encode(), np.uint8)
        begins = np.flatnonzero(self.starts(self.classes(joined), np.array([len(t) for t in texts], np.int64)))
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        start = heads[begins]
        parts = self.parts.counts(data, start, np.diff(start, append=len(data)))
        ends = np.cumsum([len(t) for t in texts])
        upto = np.concatenate([[0], np.cumsum(parts)])
        return np.diff(upto[np.searchsorted(begins, np.concatenate([[0], ends]))])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


_OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", step: int = 2000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, for a byte-level BPE vocabulary file.

    The vocabulary is compiled into two transducers: one over classes of characters, which
    cuts texts into parts, and one over the bytes of a part, whose transitions carry the
    tokens they add. No text is encoded. Strings of added tokens count as one token, as in
    the library; nothing is added, cut or padded. Texts of any length are read in pieces.

    Null and empty texts have no tokens. One row for each row of docs, null and repeated ids
    included; an empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(vocabulary)
        for batch in batches:
            for part, texts in slices(batch, 1, step, 1_000_000):
                n_bytes, n = of.count(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=[x.split()[0] for x in _OUT.split(", ")])

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _OUT)
