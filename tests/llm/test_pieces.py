from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm.pieces import Lattice, decode_pieces, encode_pieces, lattice, seeds_of

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


def ways(lat, word):
    """Every segmentation of one word with its weight."""
    _, (size,), _, ids, weights = lat.edges([word])

    def go(at):
        if at == size:
            yield (), 1.0
        for k in range(1, min(lat.longest, size - at) + 1):
            if weights[at, k - 1] > 0:
                for rest, w in go(at + k):
                    yield (int(ids[at, k - 1]), *rest), w * weights[at, k - 1]

    return dict(go(0))


@pytest.mark.parametrize("word", ["then", "onhe", "zé!"])
def test_draws_follow_the_lattice(word):
    lat = lattice(MODEL)
    want = ways(lat, word)
    total = sum(want.values())
    n = 30_000
    got = Counter(tuple(x[len(lat.sample(["a"], np.array([0], np.uint64))[0]) :].tolist()) for x in lat.sample([f"\n {word}"] * n, seeds_of(range(n), 3)))
    for s, w in want.items():
        assert abs(got[s] / n - w / total) < 5 * (w / total / n) ** 0.5 + 1e-3
    assert set(got) <= set(want)


def crossings(lat, word):
    """Probability, by sums in logarithms, that a piece ends at each node inside one word."""
    _, (size,), _, _, weights = lat.edges([word])
    steps = [(a, a + k, np.log(float(weights[a, k - 1]))) for a in range(size) for k in range(1, min(lat.longest, size - a) + 1) if weights[a, k - 1] > 0]
    to, past = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    to[0] = past[size] = 0
    for a, b, w in steps:
        to[b] = np.logaddexp(to[b], to[a] + w)
    for a, b, w in reversed(steps):
        past[a] = np.logaddexp(past[a], past[b] + w)
    return np.minimum(np.exp(to + past - to[size])[1:-1], 1)


@pytest.mark.parametrize("word", ["thenotherwise" * 9, "x\tthen\nonhe" * 8, "日本語の文は長い" * 12])
def test_long_words_are_not_cut(word):
    lat, n = lattice(MODEL), 4000
    want, got = crossings(lat, word), np.zeros(len(word) + 1)
    for ids in lat.sample([f"\n {word}"] * n, seeds_of(range(n), 3)):
        ends = np.cumsum([len(lat.bytes[i]) for i in ids.tolist()])
        got += np.isin(np.cumsum([1] + [len(c.encode()) for c in " " + word])[1:], ends)
    assert (abs(got[:-1] / n - want) < 5 * (want * (1 - want) / n) ** 0.5 + 1e-3).all()


def test_runs_of_blanks_are_in_the_lattice():
    lat, n = lattice(MODEL), 30_000
    want = ways(lat, "   on")
    total = sum(want.values())
    assert any(lat.bytes[s[0]] == b"    " for s in want)
    got = Counter(tuple(x[1:].tolist()) for x in lat.sample(["\n    on"] * n, seeds_of(range(n), 3)))
    for s, w in want.items():
        assert abs(got[s] / n - w / total) < 5 * (w / total / n) ** 0.5 + 1e-3
    assert set(got) <= set(want)


def whole_ways(text):
    """Every segmentation of a whole text with its weight, from the library's list of pieces alone."""
    sp, pieces, of_byte = sentencepiece.SentencePieceProcessor(model_file=MODEL), {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            of_byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[sp.id_to_piece(i).replace("\u2581", " ")] = (i, 1 / (10 - sp.get_score(i)))
    longest = max(map(len, pieces))

    def go(at):
        if at == len(text):
            yield (), 1.0
        for end in range(at + 1, min(at + longest, len(text)) + 1):
            if text[at:end] in pieces:
                (i, w), spelled = pieces[text[at:end]], None
            elif end == at + 1:
                spelled, w = tuple(of_byte[b] for b in text[at].encode()), Lattice.FALLBACK
            else:
                continue
            for rest, v in go(end):
                yield (*(spelled or (i,)), *rest), w * v

    return dict(go(0))


@pytest.mark.parametrize("text", ["a    b", "on  to it", "a\t  so", "\u2603 at\u2603", "no\nso on"])
def test_draws_follow_the_library_pieces(text):
    want, n = whole_ways(text), 20_000
    total = sum(want.values())
    got = Counter(tuple(x.tolist()) for x in lattice(MODEL).sample([text] * n, seeds_of(range(n), 5)))
    assert set(got) <= set(want)
    for s, w in want.items():
        assert abs(got[s] / n - w / total) < 5 * (w / total / n) ** 0.5 + 1e-3


def test_chunks_do_not_matter():
    lat = lattice(MODEL)
    words = ["then", "otherwise日本" * 70, "\ud800so", "", "a  b\n" * 33, "\ud800", "x" * 300]
    whole = lat.filtered(words)
    for chunk in (7, 50, 301):
        start, size, flat, ids, sums = lat.filtered(words, chunk)
        assert all((a == b).all() for a, b in zip((start, size, flat, ids), whole, strict=False))
        assert abs(sums - whole[4]).max() < 1e-6


def test_very_long_word():
    lat, text = lattice(MODEL), "".join(np.random.default_rng(0).choice(list("abc\n/é日😀"), 170_000))
    (ids,) = lat.sample([text], seeds_of([1], 0))
    assert lat.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80), st.integers(0, 10))
def test_lossless_and_reproducible(text, key):
    lat = lattice(MODEL)
    a, other = lat.sample([text, "so it goes " * 5], seeds_of([key, 1], 0))
    assert lat.decode(a) == text
    (b,) = lat.sample([text], seeds_of([key], 0))
    assert a.tolist() == b.tolist()


def test_library_decodes_the_pieces():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    lat = Lattice(MODEL)
    text = "it was\nthat. Onhe és 日本"
    (ids,) = lat.sample([text], seeds_of([7], 0))
    assert sp.decode(ids.tolist()) == text


def test_query_form(docs, no_docs, corpus):
    out = encode_pieces(docs, MODEL).cache()
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.lossless is (None if r.doc_id == 77 else True) and r.n_pieces == len(r.ids) for r in rows)
    assert all(r.ids == [] for r in rows if r.doc_id in (77, 78))
    other = encode_pieces(docs.repartition(5), MODEL, step=3).collect()
    assert {(r.doc_id, r.ids_crc32) for r in rows} == {(r.doc_id, r.ids_crc32) for r in other}
    assert {(r.doc_id, r.ids_crc32) for r in rows} != {(r.doc_id, r.ids_crc32) for r in encode_pieces(docs, MODEL, seed=1).collect()}
    back = {r.doc_id: r.text for r in decode_pieces(out, MODEL).collect()}
    assert all(back[i] == (t or "") for i, t in corpus.items())
    assert encode_pieces(no_docs, MODEL).collect() == []


def test_a_model_with_blanks_inside_pieces_is_refused(monkeypatch):
    import sentencepiece

    from tideline.llm.pieces import Lattice
    from tideline.llm.queries import vocabulary

    whole = sentencepiece.SentencePieceProcessor.id_to_piece
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "id_to_piece", lambda self, i: "of▁the" if i == 5000 else whole(self, i))
    with pytest.raises(ValueError, match="of▁the"):
        Lattice(vocabulary("piece_bpe_32k.model"))
