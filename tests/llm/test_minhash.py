import random

from tideline.llm.minhash import keep_one, near_duplicates

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    comp = {i: i for i in texts}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return sets, {i: find(i) for i in texts}


def test_brute_force(docs, corpus):
    sets, comp = components(corpus)
    rows = [r for r in near_duplicates(docs).collect() if r.doc_id is not None]
    assert len(rows) == len(corpus) + 1  # a repeated row
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id), r


def test_family_of_variants(spark):
    """Variants of one text whose pairs lie on both sides of the threshold."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    _, comp = components(texts)
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == comp


def test_threshold_is_met_exactly(spark):
    """Six of eight shingles shared: linked; six of nine: not."""
    a = "a b c d e f g h i j k"  # seven shingles
    rows = [(1, a), (2, a + " l"), (3, "q r s t u v w x y z"), (4, "q r s t u v w x y 1 2 3")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_rows_of_one_id_are_one_document(spark):
    """Id 5 has four texts: two that are others' copies, one near a third document, one alone."""
    rng = random.Random(9)
    a, b, c = (" ".join(f"{k}{rng.randrange(999)}" for _ in range(60)) for k in "abc")
    rows = [(2, a), (5, a), (5, b), (9, b), (5, c), (7, c + " more"), (5, "quite another thing altogether here"), (8, "it stands alone"), (None, a), (None, b)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id)
    assert got == [(2, 2, True), *[(5, 2, False)] * 4, (7, 2, False), (8, 8, True), (9, 2, False)]


def test_empty_and_keep_one(docs, no_docs, corpus):
    assert near_duplicates(no_docs).collect() == []
    out = keep_one(docs)
    assert out.columns == docs.columns
    _, comp = components(corpus)
    assert {r.doc_id for r in out.collect()} - {None} == {i for i, c in comp.items() if i == c}
