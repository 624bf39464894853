import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.llm.common import slices
from tideline.llm.quality import Chains, LineField, keep_good, line_features, quality


def make(rng, good):
    lines = []
    for _ in range(rng.randrange(1, 9)):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(3, 15))]
        lines.append(" ".join(w).capitalize() + "." if good else " ".join(x + "***" for x in w))
    return "\n".join(lines)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = [(i, make(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(800)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int").cache()


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([4, 1, 6, 2])
    s, tr = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    fwd, bwd = Chains(counts).messages(s, tr)
    got = 1 / (1 + np.exp(-(fwd + bwd)))
    at = 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=int(n)):
            p = np.exp(sum(s[at + i] * y[i] for i in range(n)) + sum(tr[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            good += p * np.array(y)
        assert np.allclose(got[at : at + n], good / total)
        at += n


def test_features_of_lines():
    x, chars, counts = line_features(["AB cd\n\nx x x", "", "é1"])
    assert counts.tolist() == [3, 1, 1] and chars.tolist() == [5, 0, 5, 0, 2]
    assert x[0, 2] == pytest.approx(2 / 5) and x[2, 7] == pytest.approx(2 / 3) and x[4, 3] == pytest.approx(1 / 2)
    one, _, _ = line_features(["é1"])
    assert np.allclose(one[0], x[4])


def test_held_out_accuracy(labelled):
    out = quality(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out) and len(held) > 100
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)


def test_held_out_labels_do_not_matter(labelled):
    df = labelled.select("doc_id", "text")
    a = quality(df, labelled.select("doc_id", "quality")).collect()
    flipped = labelled.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    b = quality(df, flipped).collect()
    assert sorted(a) == sorted(b)


def test_edges(docs, no_docs, labelled):
    labels = labelled.select("doc_id", "quality")
    teach = labelled.select("doc_id", "text")
    out = quality(docs.select("doc_id", "text").unionByName(teach), labels).collect()
    assert len(out) == docs.count() + 800 and all(r.score is not None for r in out)
    assert quality(no_docs.select("doc_id", "text").unionByName(teach), labels).count() == 800
    assert keep_good(no_docs, labels).collect() == []
    kept = keep_good(labelled, labels).collect()
    assert sum(r.quality for r in kept) >= 590 and len(kept) - sum(r.quality for r in kept) <= 10
    with pytest.raises(ValueError):
        quality(teach, labels.limit(0)).collect()


def test_extra_columns_and_repeated_ids(spark, docs, labelled):
    """Columns that clash with the operator's names, labels with nulls and repeats, several texts of an id."""
    labels = labelled.select("doc_id", "quality", F.lit(1).alias("text"), F.lit("x").alias("score")).union(spark.createDataFrame([(None, 1, 1, "x"), (3, None, 1, "x"), (4, 0, 1, "x"), (4, 0, 1, "x")], "doc_id long, quality int, text int, score string"))
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]
    teach = labelled.select("doc_id", "text", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in extra])
    both = docs.unionByName(teach).unionByName(teach.limit(50))
    out = quality(both, labels).collect()
    assert len(out) == docs.count() + 850 and all(r.score is not None for r in out)
    kept = keep_good(both, labels)
    assert kept.columns == both.columns
    assert kept.count() == sum(r.predicted for r in out)


def test_slices_bound_rows_and_characters():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "x" * 50, "", "c", "d"])], names=["t"])
    found = [t for part, t in slices(batch, 0, 3, 10)]
    assert found == [["ab", ""], ["x" * 50], ["", "c", "d"]]
    assert [part.num_rows for part, _ in slices(batch, 0, 2, 1000)] == [2, 2, 2]


def test_score_is_between_lines():
    f = LineField.fit(["good words here.\nand more"] * 20 + ["x*** y*** z***"] * 20, np.array([1] * 20 + [0] * 20))
    a, b, c = f.score(["good words here.\nand more", "x*** y*** z***", ""])
    assert a > 0.7 and b < 0.3 and 0 <= c <= 1
