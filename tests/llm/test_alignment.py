import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tideline.llm import alignment
from tideline.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def spelled(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        x = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, spelled(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        return (x, y) if all(b"".join(t for _, t in side) == want for side in (x, y)) else ([], [])

    return tokens


def placed(tokens):
    end, out = 0, []
    for i, t in tokens:
        out.append((i, end, end := end + len(t)))
    return out


def brute(texts, tokens):
    """The contract's columns of each text, by comparing all its pairs of tokens."""
    found, count = [], Counter()
    for t in texts:
        x, y = map(placed, tokens(t))
        links, j = [], 0
        for i, s, e in x:
            while j and y[j][1] > s:
                j -= 1
            while j < len(y) and y[j][2] <= s:
                j += 1
            links += [(i, k) for k, s2, e2 in y[j : j + 200] if s2 < e and s < e2]
        count.update(links)
        groups, cuts = [], sorted({e for *_, e in x} & {e for *_, e in y})
        for s, e in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, s2, e2 in side if s <= s2 and e2 <= e) for side in (x, y)))
        found.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    highest = Counter()
    for (_, k), n in count.items():
        highest[k] = max(highest[k], n)
    return [(n_a, n_b, g, len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links), sha) for n_a, n_b, g, links, sha in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("head_pairs", [2_000_000, 40, 0])
def test_brute_force(spark, docs, sides, head_pairs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000, "a▁b"), (1001, "<|endoftext|> <s> x</s>"), (1002, "  　x \xa0y\t\r\n  "), (1003, " "), (1004, "don't  won't 12345 naïve café"), (1005, "\0"), (1006, "日本 語"), (1007, "x" * 300)]
    df = spark.createDataFrame([(*r, 1, "!") for r in rows], "doc_id long, text string, pair int, rare string").repartition(3)
    want = sorted(zip([str(i) for i, _ in rows], brute([t for _, t in rows], sides), strict=True))
    got = alignment.align_tokens(df, A, B, head_pairs=head_pairs).collect()
    assert sorted((str(r.doc_id), tuple(r[c] for c in COLUMNS)) for r in got) == want
    assert sum(w[0] > 0 for _, w in want) > 80


def test_empty_tables(spark, no_docs):
    assert alignment.align_tokens(no_docs, A, B).collect() == []
    got = alignment.align_tokens(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, got)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_sides_encode_as_the_libraries(sides):
    rng = random.Random(8)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "1", "é", "日", "😀", "　", ".", "</s>", "<|endoftext|>", "▁"]
    al = alignment.Aligner(A, B)
    al.b.most = al.a.most = 50  # so that words are forgotten
    for _ in range(40):
        texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(20)]
        for t, x, y in zip(texts, *al.encode(texts), strict=True):
            a, b = sides(t)
            assert np.frombuffer(x, al.a.dtype).tolist() == [i for i, _ in a], t
            assert np.frombuffer(y, al.b.dtype).tolist() == [i for i, _ in b], t


def test_rare_pairs_and_flushes(spark, docs, sides, monkeypatch):
    """Tasks that pass their counts on time and again give the same sums."""
    df = docs.repartition(2)
    want = sorted(map(tuple, alignment.align_tokens(df, A, B).collect()), key=repr)
    monkeypatch.setattr(alignment, "GATHERED", 100)
    run = alignment._aligned
    monkeypatch.setattr(alignment, "_aligned", lambda a, b: run(a, b, step=7, chars=2000))
    assert sorted(map(tuple, alignment.align_tokens(df, A, B, head_pairs=200).collect()), key=repr) == want


def test_counts_by_open_addressing():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    c = alignment.Counts(keys, np.arange(len(keys)), keys % 2 == 0)
    at = c.find(keys)
    assert (c.key[at] == keys).all() and (c.n[at] == np.arange(len(keys))).all() and (c.best[at] == (keys % 2 == 0)).all()
    other = np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)
    assert (c.key[c.find(other)] == -1).all()
    none = alignment.Counts(keys[:0], keys[:0], keys[:0] > 0)
    assert (none.key[none.find(other)] == -1).all()
