"""Quality classifier: a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from tideline.llm.common import column, slices, tidy

#: Rows the classifier is fitted on at most, the longest text among them and the characters of all.
FIT_ROWS, FIT_CHARS, FIT_ALL = 6000, 20_000, 40_000_000
#: Rows and characters that are scored at once; a character takes some 40 bytes meanwhile.
SCORE_ROWS, SCORE_CHARS = 500, 600_000
_KINDS = 0x3000
_POWERS = np.random.default_rng(11).integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 lower-case or other letter, 1 upper-case, 2 digit, 3 white space, 4 sentence mark, 5 other symbol."""
    def kind(c: str) -> int:
        if c.isspace():
            return 3
        if c.isdigit():
            return 2
        if c.isalpha():
            return int(c.isupper())
        return 4 if c in ".,;:'-\"()?" else 5

    return np.array([kind(chr(i)) for i in range(_KINDS)] + [0], np.uint8)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its characters, lines of each text); a text has at least one line."""
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    cps = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.flatnonzero(cps == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    kinds = _kinds()[np.minimum(cps, _KINDS)]
    chars = (ends - starts).astype(np.float64)
    part = lambda mask: np.add.reduceat(mask.astype(np.int32), starts)
    of = np.maximum(chars, 1)
    blank = kinds == 3
    begin = ~blank & np.concatenate([[True], blank[:-1]])
    at = np.flatnonzero(begin)
    words = part(begin).astype(np.float64)
    rep1 = rep2 = np.zeros(len(starts))
    if len(at):
        pos = np.arange(len(cps)) - at[np.maximum(np.cumsum(begin) - 1, 0)]
        with np.errstate(over="ignore"):
            h = np.add.reduceat(np.where(blank, 0, cps).astype(np.uint64) * _POWERS[pos & 63], at)
        line = np.searchsorted(ends, at)
        rep1, rep2 = (np.bincount(line[k:][(h[k:] == h[:-k]) & (line[k:] == line[:-k])], minlength=len(starts)) for k in (1, 2))
    per_word = np.maximum(words, 1)
    own = np.column_stack([np.log1p(chars), np.log1p(words), part(kinds == 1) / of, part(kinds == 2) / of, part(kinds == 4) / of, part(kinds == 5) / of, (chars - part(blank) + 1) / per_word / 10, rep1 / per_word, rep2 / per_word])
    first = np.zeros(len(starts), bool)
    first[np.cumsum(counts)[:-1]] = True
    first[0] = True
    last = np.concatenate([first[1:], [True]])
    before = np.vstack([own[:1], own[:-1]])
    after = np.vstack([own[1:], own[-1:]])
    before[first] = 0
    after[last] = 0
    return np.column_stack([own, before, after, first, last]), chars, counts


class Chains:
    """Lines of many texts, so laid out that one step handles the n-th line of all texts."""

    def __init__(self, counts: np.ndarray):
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.order = np.argsort(-counts, kind="stable")
        self.begin, lengths = begin[self.order], counts[self.order]
        longest = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(longest), side="left")

    def steps(self):
        for t, n in enumerate(self.active):
            yield t, int(n)

    def messages(self, s: np.ndarray, tr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the forward (with the line's own score) and backward messages."""
        fwd, bwd = np.empty_like(s), np.zeros_like(s)
        prev = None
        for t, n in self.steps():
            at = self.begin[:n] + t
            now = s[at]
            if t:
                p = prev[:n]
                now = now + np.logaddexp(tr[1, 1] + p, tr[0, 1]) - np.logaddexp(tr[1, 0] + p, tr[0, 0])
            fwd[at] = prev = now
        for t, n in reversed(list(self.steps())):
            if t:
                at = self.begin[:n] + t
                nxt = s[at] + bwd[at]
                bwd[at - 1] = np.logaddexp(tr[1, 1] + nxt, tr[1, 0]) - np.logaddexp(tr[0, 1] + nxt, tr[0, 0])
        return fwd, bwd


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class LineField:
    """Weights of standardised line features and the chain's 2 x 2 transition scores (bad, good)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def score(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean, over a text's lines, of the marginal probability of good."""
        x, chars, counts = line_features(texts)
        fwd, bwd = Chains(counts).messages(self._design(x) @ self.weights, self.transitions)
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
        weight = chars + 1e-9
        return np.add.reduceat(_sigmoid(fwd + bwd) * weight, begin) / np.add.reduceat(weight, begin)

    @classmethod
    def fit(cls, texts: list[str], labels: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> LineField:
        """Maximum conditional likelihood of the lines' labels, each line taking its document's.

        Lines weigh such that every document counts alike. The weights start from a
        ridge regression on the logistic scale; then weights and transitions are
        climbed together by Adam on the exact gradient from the marginals.
        """
        parts = [line_features(texts[i : i + 200]) for i in range(0, len(texts), 200)]
        x, _, counts = map(np.concatenate, zip(*parts, strict=True))
        doc = np.repeat(np.arange(len(counts)), counts)
        y = labels[doc].astype(np.float64)
        line_weight = (1.0 / counts)[doc]
        model = cls(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(x.shape[1] + 1), np.zeros((2, 2)))
        d = model._design(x)
        w = model.weights
        for _ in range(12):
            p = _sigmoid(d @ w)
            v = line_weight * np.maximum(p * (1 - p), 1e-4)
            g = d.T @ (line_weight * (y - p)) - ridge * len(counts) * w
            w = w + np.linalg.solve((d * v[:, None]).T @ d + ridge * len(counts) * np.eye(len(w)), g)
        chains, tr = Chains(counts), np.array([[0.5, -0.5], [-0.5, 0.5]])
        inner = np.ones(len(doc), bool)
        inner[np.concatenate([[0], np.cumsum(counts)[:-1]])] = False
        after = np.flatnonzero(inner)
        m1 = m2 = 0.0
        for step in range(1, steps + 1):
            s = d @ w
            fwd, bwd = chains.messages(s, tr)
            gw = d.T @ (line_weight * (y - _sigmoid(fwd + bwd))) / len(counts) - ridge * w
            b, a = fwd[after - 1], s[after] + bwd[after]
            joint = np.stack([np.full(len(after), tr[0, 0]), tr[0, 1] + a, tr[1, 0] + b, tr[1, 1] + a + b])
            joint = np.exp(joint - joint.max(axis=0))
            joint /= joint.sum(axis=0)
            seen = np.stack([1 - y[after], 0 * y[after], 0 * y[after], y[after]])
            gt = ((seen - joint) * line_weight[after]).sum(axis=1).reshape(2, 2) / len(counts) - ridge * tr
            g = np.concatenate([gw, gt.ravel()])
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
            w, tr = w + move[:-4], tr + move[-4:].reshape(2, 2)
        return cls(model.mean, model.scale, w, tr)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> LineField:
    """Fit on labelled documents that are not held out, in the order of a hash of their ids.

    At most fit_rows of them, of at most FIT_CHARS characters each and FIT_ALL together.
    Of rows equal in doc_id the greatest label and the least text count.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text")).where(F.length("text") <= FIT_CHARS)
    taught = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    taught = taught.withColumn("upto", F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)))  # of fit_rows rows
    sample = sorted((r["doc_id"], r["text"], r["quality"]) for r in taught.where(F.col("upto") <= FIT_ALL).select("doc_id", "text", "quality").collect())
    if not sample:
        raise ValueError("no labelled documents to fit on")
    return LineField.fit([t for _, t, _ in sample], np.array([q for _, _, q in sample]))


def score_quality(docs: DataFrame, model: LineField) -> DataFrame:
    """(doc_id, score) of every whole text by the fitted field; null and empty texts have one empty line."""
    cell = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, 1, SCORE_ROWS, SCORE_CHARS):
                scores = cell.value.score(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(scores, 0.0, 1.0))], names=["doc_id", "score"])

    rows = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Labels of rows that are not held out teach the field, a bounded number of them
    (FIT_ROWS); only the text enters a score. Null and empty texts are scored as one
    empty line. One row for each row of docs; repeated and null ids stay. An empty
    table gives no rows but needs labelled documents to fit on.
    """
    out = score_quality(docs, fit_quality(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs, all columns, without the documents that the classifier rejects."""
    if docs.limit(1).count() == 0:
        return docs
    model = fit_quality(docs, labels)
    cell = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, at, SCORE_ROWS, SCORE_CHARS):
                scores = cell.value.score(texts)
                yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
