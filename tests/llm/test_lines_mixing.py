from collections import defaultdict

import duckdb
import pytest

from tideline.llm.line_dedup import dedup_lines
from tideline.llm.mixing import mix_sources, source_targets
from tideline.llm.queries import OP6_SQL, OP9_SQL


def brute_lines(texts):
    """Kept text of each (id, text), windows of three lines in order of (id, line)."""
    seen, gone = set(), defaultdict(set)
    for i, t in sorted(texts.items()):
        lines = (t or "").split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone[i] |= {k, k + 1, k + 2}
            seen.add(w)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def test_lines_brute_force(docs, corpus):
    out = dedup_lines(docs)
    assert set(docs.columns) | {"n_lines", "n_removed"} == set(out.columns)
    want = brute_lines(corpus)
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert r.text == want[r.doc_id], r.doc_id
            assert r.n_lines == (0 if corpus[r.doc_id] is None else corpus[r.doc_id].count("\n") + 1)


def test_lines_equal_rows_keep_alike(spark):
    t = "a\nb\nc\nd"
    out = dedup_lines(spark.createDataFrame([(1, t), (1, t), (2, "x\n" + t), (3, "a\nb\nc")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in out) == [(1, t, 0), (1, t, 0), (2, "x", 4), (3, "", 3)]


def test_lines_empty(no_docs):
    assert dedup_lines(no_docs).collect() == []


def targets(spark, sizes, **k):
    return {r.source: r.target for r in source_targets(spark.createDataFrame(sizes, "source string, source_size long"), **k).collect()}


def test_targets_water_level(spark):
    # by code point: A, a, b, null with weights 1, 2, 3, 1
    sizes = [("a", 10), ("A", 500), (None, 90), ("b", 0)]
    got = targets(spark, sizes)
    assert got["a"] == 30 and got["b"] == 0  # full at three times their size
    assert got["A"] == pytest.approx(285) and got[None] == pytest.approx(270) or got[None] == 270
    assert sum(got.values()) <= 600 + 1e-6


def test_targets_share_all(spark):
    got = targets(spark, [("a", 100), ("b", 100), ("c", 100)])
    assert got == pytest.approx({"a": 50, "b": 100, "c": 150})


def test_mix_matches_sql(spark, docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "source", "text").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [tuple(r) for r in rows])
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP9_SQL})").fetchall()
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert sorted(map(tuple, got.collect())) == [pytest.approx(w) for w in sorted(want)]
    lines = con.execute(f"SELECT doc_id, n_removed FROM ({OP6_SQL})").fetchall()
    assert dict(lines) == {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "a", "one two three four")],
        [(1, "a", "one two three four"), (2, "b", "")],
        [(1, "a", "one two three four"), (2, "b", None)],
        [(1, "a", ""), (2, None, None)],
        [(1, "a", "one"), (2, "b", "one two three four five six seven eight nine ten")],
        [(i, f"s{i}", " ".join(["w"] * n)) for i, n in enumerate([1, 50, 7, 7, 300, 2, 1])],
        [(i, "only", " ".join(["w"] * n)) for i, n in enumerate([5, 1, 1, 90, 3])],
        [(1, None, "a b"), (2, None, "c d e")],
    ],
    ids=["one document", "an empty source", "a null text", "no words", "two documents", "a document a source", "one source", "null source"],
)
def test_small_mixes_match_sql(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({OP9_SQL})").fetchall()
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert sorted(map(tuple, got)) == [pytest.approx(w, nan_ok=True) for w in sorted(want)]
    assert sum(r.taken for r in got) <= sum({r.source_size for r in got}) * 3


def test_mix_takes_come_near_targets(spark):
    rows = [(i, ("a", "b", "c", None)[min(i % 10, 3)], " ".join(["w"] * (1 + (i * i + i // 10) % 50))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, two = mix_sources(df).collect(), mix_sources(df.repartition(13)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    by = defaultdict(int)
    for r in one:
        assert r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0
        by[(min(r.doc_id % 10, 3), r.target)] += r.taken
    assert len(by) == 4
    for (_, target), taken in by.items():
        assert abs(taken - target) <= 60
    assert sum(by.values()) <= sum(r.size for r in one)


def test_mix_edges(docs, no_docs):
    assert mix_sources(no_docs).collect() == []
    out = mix_sources(docs).collect()
    assert len(out) == docs.count()
    assert all(r.size == r.taken == 0 for r in out if r.doc_id in (77, 78, 79))
    assert len({(r.size, r.taken) for r in out if r.doc_id == 81}) == 1
