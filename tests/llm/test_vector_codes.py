import hashlib
import math

import duckdb
import numpy as np
import pytest

from tideline.llm import vector_codes as vc
from tideline.llm.queries import OP11_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, ints int, code string, salt int, error long, sum_label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, k, 0, "!", 0, 0, 0) for i, v, k in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    """{place of a kept row: (vec_id, code, error, label_error, digest)}, every part held against every entry."""
    kept = [(i, [math.floor(256 * float(x)) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    cut = [[tuple((v + [0] * (parts * width))[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    ids = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i or 0))[:entries]
    least = [min(v for j, v, _ in kept if j == i) for i in ids]
    books = [[tuple((v + [0] * (parts * width))[p * width : (p + 1) * width]) for v in least] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            found = [near(c[p], books[p])[1] for c in cut]
            for e in set(found):
                mine = [c[p] for c, f in zip(cut, found, strict=True) if f == e]
                books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    last = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in x) for x in last]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in x), d, sum(o for (_, _, j), o in zip(kept, error, strict=True) if j == k), digest) for (i, _, k), x, d in zip(kept, last, error, strict=True)), key=repr)


def run(spark, rows, **k):
    return sorted(map(tuple, vc.vector_codes(table(spark, rows).repartition(3), **k).collect()), key=repr)


def draw(n, length=32, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, length)).astype(np.float32) / 4
    x[::7] = x[0]  # repeats, so that entries are equal and ties arise
    x[1::9] = np.round(x[1::9] * 4) / 4
    return [(int(i), v.tolist(), None if i % 6 == 0 else int(i % 3)) for i, v in zip(rng.permutation(n * 2)[:n] - 40, x, strict=True)]


def test_brute_force(spark):
    rows = draw(300)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, parts=4, entries=10, rounds=4) == brute(rows, 4, 10, 4)


def test_few_rows_repeats_and_odd_vectors(spark):
    rows = draw(20, 16)
    v = rows[3][1]
    rows += [(5000, None, 1), (5001, [*v[:-1], None], 1), (5002, [*v[:-1], float("nan")], 1), (5003, [*v[:-1], float("inf")], 1), (rows[0][0], v, 2), rows[1], (None, v, None), (None, rows[2][1], 1), (5004, v[:5], 1), (5005, [], 0)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(None, v, 1), (None, rows[1][1], 1)]) == brute([(None, v, 1), (None, rows[1][1], 1)])
    assert run(spark, [(1, [], 1)]) == brute([(1, [], 1)])
    assert run(spark, rows[:0]) == run(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(1, [1e30] * 16, 1)])


def test_search_is_exact_from_any_start():
    rng = np.random.default_rng(3)
    books = vc.Codebooks(rng.integers(-4, 5, (3, 20, 2)))
    x, start = rng.integers(-6, 7, (500, 3, 2)), rng.integers(0, 20, (500, 3))
    code, error = books.assign(x, start)
    d = ((x[:, :, None] - books.entries) ** 2).sum(axis=3)
    assert (code == d.argmin(axis=2)).all() and (error == d.min(axis=2)).all()


def test_sums_by_a_shuffle(spark, monkeypatch):
    rows = draw(90, 16)
    monkeypatch.setattr(vc._with_sums, "__defaults__", (1,))
    assert run(spark, rows) == brute(rows)


def test_matches_sql(spark):
    rows = draw(150)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    got = vc.vector_codes(table(spark, rows))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({OP11_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
