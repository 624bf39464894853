import numpy as np
import pytest

from tideline.llm.embeddings import Quantiser, similar_vectors, unit


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n int, root int, cell int")


def brute(ids, x, label, least=0.93):
    n, comp = dict.fromkeys(ids, 0), {i: i for i in ids}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    u = unit(x)
    for a in range(len(ids)):
        for b in range(a):
            if label[a] == label[b] and u[a] @ u[b] >= least:
                n[ids[a]] += 1
                n[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                comp[max(p, q)] = min(p, q)
    return n, {i: find(i) for i in ids}


@pytest.mark.parametrize("noise", [0.02, 0.04])
def test_brute_force(spark, noise):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    x = np.concatenate([unit(c + rng.normal(size=(n, 64)) * noise * np.linalg.norm(c)) for c, n in zip(centres, [300, 40, 20, *[5] * 9], strict=True)] + [unit(rng.normal(size=(200, 64)))]).astype(np.float32)
    label = rng.integers(0, 3, len(x)).tolist()
    ids = rng.permutation(5000)[: len(x)].tolist()
    rows = [(i, v.tolist(), k, 0, 0, 0) for i, v, k in zip(ids, x, label, strict=True)]
    n, comp = brute(ids, x.astype(float), label)
    got = {r.vec_id: r for r in similar_vectors(table(spark, rows), chunk=64).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], comp[i], comp[i] == i) for i in ids}


def test_both_sides_of_a_border_count_their_links(spark):
    turn = np.random.default_rng(4).uniform(0, 2 * np.pi, 500)
    x = np.stack([np.cos(turn), np.sin(turn)], axis=1).astype(np.float32)
    ids = list(range(len(x)))
    n, comp = brute(ids, x.astype(float), [1] * len(x), 0.995)
    got = similar_vectors(table(spark, [(i, v.tolist(), 1, 0, 0, 0) for i, v in zip(ids, x, strict=True)]), least=0.995).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (n[i], comp[i]) for i in ids}


def shaped(kind, n=900, length=64):
    rng = np.random.default_rng(9)
    if kind == "circle":
        turn, plane = rng.uniform(0, 2 * np.pi, n), np.linalg.qr(rng.normal(size=(length, 2)))[0]
        return np.stack([np.cos(turn), np.sin(turn)], axis=1) @ plane.T + rng.normal(size=(n, length)) * 0.01
    if kind == "half circle and noise":
        return np.concatenate([shaped("circle", n // 2), rng.normal(size=(n - n // 2, length))])
    return rng.normal(size=(n, int(kind))) @ rng.normal(size=(int(kind), length))


@pytest.mark.parametrize("kind", ["circle", "half circle and noise", "4", "64"])
def test_no_link_is_lost_however_vectors_lie(spark, kind):
    """Long vectors near a circle or of low rank: their differences lie along the directions that part the lists."""
    x = shaped(kind).astype(np.float32)
    label = (np.arange(len(x)) % 10 == 0).astype(int)
    linked = (unit(x.astype(float)) @ unit(x.astype(float)).T >= 0.93) & (label[:, None] == label)
    got = {r.vec_id: r.n_links for r in similar_vectors(table(spark, [(i, v.tolist(), int(k), 0, 0, 0) for i, (v, k) in enumerate(zip(x, label, strict=True))])).collect()}
    assert [got[i] for i in range(len(x))] == (linked.sum(axis=1) - 1).tolist()


def test_odd_vectors(spark):
    v = [1.0] + [0.0] * 7
    rows = [(1, v, 1, 0, 0, 0), (2, v, 1, 0, 0, 0), (3, None, 1, 0, 0, 0), (4, [0.0] * 8, 1, 0, 0, 0), (5, [float("nan")] + v[1:], 1, 0, 0, 0), (6, [None, *v[1:]], 1, 0, 0, 0), (7, v, None, 0, 0, 0), (8, v, 2, 0, 0, 0), (None, v, 1, 0, 0, 0), (9, [1.0], 1, 0, 0, 0), (2, v, 1, 0, 0, 0), (10, [float("inf")] + v[1:], 1, 0, 0, 0)]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in similar_vectors(table(spark, rows)).collect())
    alone = [(str(i), 0, str(i), True) for i in (3, 4, 5, 6, 7, 8, 9, 10, None)]
    assert got == sorted([("1", 1, "1", True), ("2", 1, "1", False), ("2", 1, "1", False), *alone])
    assert similar_vectors(table(spark, rows).limit(0)).collect() == []


def test_equal_vectors_are_one_class(spark):
    """6,000 equal vectors and 30 near them; equal ids with other vectors are the least of them."""
    rng = np.random.default_rng(6)
    v = unit(rng.normal(size=(1, 16)))[0].astype(np.float32)
    near = [unit((v + rng.normal(size=16) * 0.03)[None])[0].astype(np.float32).tolist() for _ in range(30)]
    far = (-v).tolist()
    rows = [(i, v.tolist(), 1, 0, 0, 0) for i in range(6000)] + [(6000 + i, x, 1, 0, 0, 0) for i, x in enumerate(near)] + [(7000, far, 1, 0, 0, 0), (7001, far, 1, 0, 0, 0), (7001, [2.0] * 16, 2, 0, 0, 0)]
    x = np.array([r[1] for r in rows[6000:6030]] + [v.tolist()], float)
    linked = unit(x) @ unit(x).T >= 0.93
    got = {r.vec_id: r for r in similar_vectors(table(spark, rows), chunk=50).collect()}
    assert {got[i].n_links for i in range(6000)} == {5999 + int(linked[30, :30].sum())}
    assert [got[6000 + i].n_links for i in range(30)] == [6000 * int(linked[i, 30]) + int(linked[i, :30].sum()) - 1 for i in range(30)]
    assert all(got[i].component_id == 0 for i in range(6000)) and [(got[i].n_links, got[i].component_id) for i in (7000, 7001)] == [(1, 7000), (1, 7000)]


def test_lengths_are_apart(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        n = (8, 8, 8, 5, 3, 1)[i % 6]
        rows.append((i, rng.normal(size=n).tolist(), int(rng.integers(2)), 0, 0, 0))
    n, comp = {}, {}
    for length in (8, 5, 3, 1):
        some = [r for r in rows if len(r[1]) == length]
        a, b = brute([r[0] for r in some], np.array([r[1] for r in some], np.float32).astype(float), [r[2] for r in some])
        n, comp = n | a, comp | b
    assert any(n[r[0]] for r in rows if len(r[1]) == 1)
    for doubles in (False, True):
        df = table(spark, rows)
        if doubles:
            df = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding", "label")
        assert {r.vec_id: (r.n_links, r.component_id) for r in similar_vectors(df).collect()} == {i: (n[i], comp[i]) for i in n}


def test_sizes_do_not_overflow(spark):
    rows = [(1, [1e30, 1e30], 1, 0, 0, 0), (2, [1e-30, 1e-30], 1, 0, 0, 0), (3, [1e-30, -1e30], 1, 0, 0, 0)]
    assert sorted((r.vec_id, r.component_id) for r in similar_vectors(table(spark, rows)).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_no_vector_is_ruled_out_by_its_code():
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(500, 32)))
    q = Quantiser.fit(x, 8)
    cell, codes, err = q.encode(x)
    for c in range(8):
        at = np.flatnonzero(cell == c)
        d = q.distances(x[:50], c, codes[at])
        true = np.linalg.norm(x[:50, None] - x[at][None], axis=2)
        assert (np.abs(d - true) <= err[at] + 1e-9).all()
    for i, p in enumerate(q.probes(x, cell, 0.37)):
        near = np.flatnonzero(np.linalg.norm(x - x[i], axis=1) <= 0.37)
        assert set(cell[near]) <= set(p)
