import numpy as np
import pytest

from lodestar.llm import embed_dedup as E
from lodestar.llm.common import local_labels

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    s = x @ x.T >= threshold
    np.fill_diagonal(s, False)
    i, j = np.nonzero(np.triu(s))
    order = np.argsort(ids, kind="stable")
    place = np.argsort(order)
    label = local_labels(len(ids), place[i], place[j])
    comp = ids[order][label][place]
    out = {i: (0, i) for i, _ in rows}
    out |= {int(k): (int(n), int(c)) for k, n, c in zip(ids, s.sum(axis=1), comp, strict=True)}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    out = E.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


def test_clusters_copies_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(E, "KEY_CHUNK", 50)
    monkeypatch.setattr(E, "CHUNK", 64)
    rng = np.random.default_rng(0)
    rows = []
    for size, noise in ((300, 0.02), (40, 0.03), (5, 0.01), (2, 0.02)):
        c = rng.standard_normal(64)
        rows += [(1000 - len(rows) - k, (c / np.linalg.norm(c) + noise * rng.standard_normal(64)).tolist()) for k in range(size)]
    rows += [(2000 + k, rng.standard_normal(64).tolist()) for k in range(400)]
    rows += [(3000 + k, rows[3][1]) for k in range(50)] + [(3100, [3 * x for x in rows[3][1]])]
    rows += [(4000, None), (4001, [0.0] * 64), (4002, [None] + [1.0] * 63), (4003, [float("nan")] * 64), (4004, [float("inf")] + [1.0] * 63), (4005, []), (4006, [1.0, 2.0]), (4007, [2.0, 4.0])]
    got, ok = run(spark, rows), [r for r in rows if r[0] not in (4006, 4007)]
    assert {k: got[k] for k in got if k not in (4006, 4007)} == brute(ok)
    assert got[4006] == (1, 4006) and got[4007] == (1, 4006)


def test_recall_at_the_threshold(spark):
    """Pairs at cosines just above the threshold, the hardest to find: recall against brute force, and no false link."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(1200):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        c = rng.uniform(0.9, 0.93)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist())]
    got, want = run(spark, rows), brute(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in got)
    assert found / there >= 0.98, found / there


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    est, bound = E.estimates(x, *E.codes_of(x))
    error = (est - x @ x.T)[~np.eye(400, dtype=bool)]
    assert abs(error.mean()) < 0.002
    assert (np.abs(est - x @ x.T) <= bound).mean() > 0.99


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None)]) == {1: (0, 1)}


def test_close_pairs_meet_at_any_size():
    """Isotropic pairs at a cosine of 0.9: nearly all share a key and have close codes, for thousands and for billions of vectors."""
    rng = np.random.default_rng(6)
    for dim in (16, 64, 300):
        a, b = rng.standard_normal((2, 1000, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= a * (a * b).sum(axis=1, keepdims=True)
        b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
        for n in (1000, 1_000_000, 10_000_000_000):
            blocks = E.Blocks(n, 0.9)
            x, y = (E.votes_of(v, 64 * blocks.words) for v in (a, b))
            close = ((x > 0) != (y > 0)).sum(axis=1) <= blocks.scheme.radius
            met = [bool(np.intersect1d(p, q).size) for p, q in zip(blocks.keys(x), blocks.keys(y), strict=True)]
            assert (np.array(met) & close).mean() >= 0.97, (dim, n)


def test_ids_and_clashing_columns(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(5, v, "a", 1, 2), (5, v, "b", 3, 4), (3, [2.0, 4.0, 6.1], None, 5, 6), (9, [-1.0, 0.0, 0.0], None, 7, 8)], "vec_id long, embedding array<double>, id string, vec int, rep int")
    assert sorted(map(tuple, E.near_duplicates(df).collect())) == [(3, 2, 3, True), (5, 2, 3, False), (5, 2, 3, False), (9, 0, 9, True)]
    with pytest.raises(ValueError, match="no id"):
        E.near_duplicates(spark.createDataFrame([(None, v)], "vec_id long, embedding array<double>"))
