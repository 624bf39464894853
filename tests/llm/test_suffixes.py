import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm.suffixes import DEPTH, Rolling, anchors, merged, remove_repeats


def brute(texts):
    """{row: (n_bytes, n_removed, n_spans, kept)} of a list of texts."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + DEPTH] for d in data for i in range(len(d) - DEPTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - DEPTH + 1):
            if seen[d[i : i + DEPTH]] > 1:
                gone[i : i + DEPTH] = True
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), len(d) - len(kept), int((gone[1:] < gone[:-1]).sum()), kept))
    return out


def check(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, want in enumerate(brute(texts)):
        assert got[i] == want, i


def test_corpus(spark, corpus):
    check(spark, list(corpus.values()))


def test_passages_and_periods(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh éü") for _ in range(n))
    passage, long = make(420), make(900)
    texts = [make(rng.randrange(0, 300)) + passage + make(rng.randrange(0, 300)) for _ in range(40)]
    texts += [make(50) + long[: rng.randrange(380, 900)] + make(50) for _ in range(20)]
    texts += ["ab" * rng.randrange(150, 400) + make(5) for _ in range(10)] + ["Is onhe. " * 90, make(100) + "Is onhe. " * 60 + make(100)]
    texts += [make(399) * 2, "x" * 399, "x" * 400, "x" * 401, passage[:399], passage[5:405], None, ""]
    check(spark, texts)


def test_rows_and_empty(docs, no_docs):
    out = remove_repeats(docs).collect()
    assert len(out) == docs.count() and sum(r.doc_id is None for r in out) == 1
    assert remove_repeats(no_docs).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=DEPTH, max_size=1500), st.integers(0, 40))
def test_every_window_has_its_anchor(data, period):
    data = np.frombuffer((data[:period] * 200)[:1500] if period else data, np.uint8)
    if len(data) < DEPTH:
        return
    rolling = Rolling(data)
    place, digit, first, count = anchors(data, rolling)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(data) - DEPTH + 1
    h = rolling.every(100)
    for p, d, a, n in zip(place, digit, first, count, strict=True):
        for x in (a, a + n - 1):
            window = h[x : x + DEPTH - 99]
            assert d == window.min() and p == x + int(window.argmin())


def test_merged():
    s, e = merged([5, 0, 3, 10], [7, 3, 4, 12])
    assert (s.tolist(), e.tolist()) == ([0, 5, 10], [4, 7, 12])
