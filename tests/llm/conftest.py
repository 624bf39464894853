import random

import pytest

#: Columns whose names operators use inside.
EXTRA = ("n", "size", "h", "part", "id", "slot", "target", "taken", "digest", "gone", "m_id", "source_size", "component", "bucket", "a", "b", "spans", "kept", "n_removed", "n_lines", "finish", "score", "key")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts by id: copies, near copies, short, empty and long ones, a null, ragged white space, many scripts."""
    rng = random.Random(5)
    out = {i: words(rng, rng.randrange(1, 120), 5000) for i in range(1, 60)}
    base = words(rng, 200, 5000).split()
    for i in range(60, 75):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{i}"
        out[i] = " ".join(w)
    out |= {75: out[60], 76: out[60].upper(), 77: None, 78: "", 79: "   \n\t ", 80: "one", 81: "one two", 82: "one two", 83: words(rng, 9000), 84: "é▁ñ  日本語 😀\n\n x", 85: " ".join(["so"] * 900), 86: "a\n" * 400}
    out[87] = out[83][:6000] + " tail"
    block = "\n".join(f"line {k} " + words(rng, 12, 5000) for k in range(6))
    out |= {88: block, 89: "head\n" + block + "\nend", 90: block + "\n" + block, 91: "x\ny\nz"}
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with a repeated row, a null id and columns of clashing names."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", len(t or "")) for i, t in corpus.items()]
    rows += [(81, corpus[81], "en", "src0", 7), (None, "a null id has words", "en", "src1", 19)]
    extra = [tuple("!" for _ in EXTRA)]
    return spark.createDataFrame([(*r, *extra[0]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA))


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
