import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tideline.llm import token_counts as tc
from tideline.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "r", "e", "v", "l", "'re", "'ll", "'v", "1", "22", "é", "日本", "😀", "　", ".", "!!", "</s>", "<|endoftext|>", "ǅ", "²", "Ⅷ", "\x85", "\x1c", "xxxxx", "aaaa", "ababab", "----", "\0"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(PATH, chunk=5)  # so that texts have many chunks


def test_counts_as_the_library(counter, library):
    rng = random.Random(3)
    for most in (30, 1000):
        for _ in range(60):
            texts = ["".join(rng.choices(PIECES, k=rng.randrange(40))) for _ in range(40)]
            n_bytes, n = counter.count(texts, most)
            assert n.tolist() == library(texts)
            assert n_bytes.tolist() == [len(t.encode()) for t in texts]


def test_parts_as_the_library(counter):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices([p for p in PIECES if p != "<|endoftext|>"], k=rng.randrange(1, 30)))
        at = np.flatnonzero(counter.starts(counter.classes(text), np.array([len(text)])))
        assert at.tolist() == [a for _, (a, _) in counter.pre.pre_tokenize_str(text)], text


def test_random_bytes_and_letters(counter, library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(s, k=rng.randrange(1, 60))) for s in ("abcde", "aA ", "etaoinshr", "0123456789", "".join(map(chr, range(128))), "éàüßñ日本語한국", " \n\t") for _ in range(150)]
    assert counter.count(texts)[1].tolist() == library(texts)


def test_long_parts_and_texts(counter, library):
    rng = random.Random(6)
    texts = ["a" * 30_000, "".join(rng.choices("abcdefghij", k=20_000)), " " * 9000 + "x", "word " * 50_000, "\n".join(["line of it"] * 20_000), "ab" * 9999 + " end"]
    assert counter.count(texts, 4000)[1].tolist() == counter.count(texts)[1].tolist() == library(texts)


def test_forgotten_states_change_nothing(library):
    c = tc.Counter(PATH)
    c.parts.most = 50
    rng = random.Random(7)
    for _ in range(20):
        texts = ["".join(rng.choices(PIECES, k=30)) for _ in range(10)] + ["".join(rng.choices("abcdefgh", k=300))]
        assert c.count(texts)[1].tolist() == library(texts)


def test_maps_compose(counter):
    m, rng = counter.monoid, np.random.default_rng(1)
    classes, first = rng.integers(0, 11, 200), np.repeat([0, 1, 40, 199], [1, 39, 159, 1])
    before = m.scan(m.of_class[classes], first)
    for k in range(200):
        state = np.arange(10)
        for c in classes[first[k] : k]:
            state = counter.step[state, c]
        assert (m.state[before[k]] == state).all()


def test_table(spark, docs, no_docs, library):
    rows = docs.collect()
    got = tc.token_counts(docs.repartition(3), PATH).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, library([r.text or "" for r in rows]), strict=True)), key=repr)
    assert any(r.over_limit for r in got)
    assert tc.token_counts(no_docs, PATH).collect() == []
    assert [r.over_limit for r in tc.token_counts(docs.where("doc_id = 81"), PATH, limit=0).collect()] == [True, True]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        tc.Counter(vocabulary("word_bpe_49k.json"))
