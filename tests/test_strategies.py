import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import classifiers as C
from lodestar.operators import diverse as D
from lodestar.operators import informative as I
from lodestar.operators import multiannotator as M
from lodestar.operators import pairs as P
from lodestar.operators import regressors as R

TINY = [(0, [1.0, 2.0], 0), (1, [5.0, 8.0], 1), (2, [8.0, 4.0], None), (3, [5.0, 4.0], None)]


def pool(spark, rows=TINY, kind="int"):
    return spark.createDataFrame([(i, x, y, 1.0) for i, x, y in rows], f"id long, x array<double>, y {kind}, w double")


def by_id(df, col="utility"):
    return {r.id: r[col] for r in df.collect()}


def test_kernel_frequencies(spark):
    rows = [(0, [0.0], "tokyo"), (1, [0.0], None), (2, [0.0], "paris")]
    df = pool(spark, rows, "string").withColumn("w", F.when(F.col("id") == 0, 2.0).otherwise(1.0))
    ask = spark.createDataFrame([(9, [0.0])], "id long, x array<double>")
    clf = C.ParzenWindow(["new york", "paris", "tokyo"])
    assert clf.freq(ask, df).first().freq == [0.0, 1.0, 2.0]
    assert clf.freq(ask, df.filter("false")).first().freq == [0.0, 0.0, 0.0]
    assert clf.probas(ask, df.filter("false")).first().p == pytest.approx([1 / 3] * 3)
    assert C.ParzenWindow(["paris", "tokyo"]).probas(ask, df).first().p == pytest.approx([1 / 3, 2 / 3])
    near = C.ParzenWindow(["new york", "paris", "tokyo"], n_neighbors=1, metric=lambda a, b: np.tile([1.0, 0.0, 0.0], (len(a), 1)))
    assert near.freq(ask, df).first().freq == [0.0, 0.0, 2.0]


def test_mean_gamma():
    assert C.gamma_of(3, 2 / 3, 1) == pytest.approx(6.907755278982137, rel=1e-7)
    assert C.gamma_of(2, 2 / 3, 1) == pytest.approx(5.050851362881613, rel=1e-7)
    assert C.gamma_of(3, 0.5 + 1.1875, 3) == pytest.approx(2.7289897398447946)
    assert C.gamma_of(3, 0, 2) == 0.5


def test_reference_side_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(3).tolist(), int(i % 3) if i % 2 else None) for i in range(60)]
    df = pool(spark, rows)
    lab, cand = df.filter("y is not null"), df.filter("y is null")
    whole = [by_id(C.ParzenWindow([0, 1, 2]).freq(cand, lab), "freq"), by_id(C.ParzenWindow([0, 1, 2], n_neighbors=4).freq(cand, df), "freq"), by_id(D.nearest_distance(cand, lab), "d"), by_id(D.neighbours(cand.select("id", "x"), lab.select("id", "x"), 3, []), "nn")]
    monkeypatch.setattr(P, "SHIP_BYTES", 400)
    parts = [by_id(C.ParzenWindow([0, 1, 2]).freq(cand, lab), "freq"), by_id(C.ParzenWindow([0, 1, 2], n_neighbors=4).freq(cand, df), "freq"), by_id(D.nearest_distance(cand, lab), "d"), by_id(D.neighbours(cand.select("id", "x"), lab.select("id", "x"), 3, []), "nn")]
    for a, b in zip(whole, parts, strict=True):
        assert a.keys() == b.keys()
        for k in a:
            np.testing.assert_allclose(np.array(a[k]), np.array(b[k]))


def test_committee_scores(spark):
    m = spark.createDataFrame([(0, 0, [0.3, 0.7]), (0, 1, [0.4, 0.6]), (1, 0, [0.2, 0.8]), (1, 1, [0.5, 0.5])], "member int, id long, p array<double>")
    assert by_id(I.committee_kl(m, 2)) == pytest.approx({0: 0.00670178182226764, 1: 0.005059389928987596})
    rows = [(i, k, v) for k, vs in enumerate([(0, 1, 2), (0, 0, 1), (2, 2, 2)]) for i, v in enumerate(vs)]
    v = spark.createDataFrame(rows, "member int, id long, vote int")
    assert by_id(I.vote_entropy(v)) == pytest.approx({0: math.log(3), 1: -2 / 3 * math.log(2 / 3) - 1 / 3 * math.log(1 / 3), 2: 0})
    rows = [(i, k, v) for k, vs in enumerate([(0, 0, 2), (1, 0, 2), (2, 1, 2), (0, 0, 0)]) for i, v in enumerate(vs)]
    assert by_id(I.variation_ratios(spark.createDataFrame(rows, "member int, id long, vote int"))) == pytest.approx({0: 1 / 3, 1: 2 / 3, 2: 1 / 3, 3: 0})


def test_batch_bald_maxima(spark):
    p = np.random.RandomState(0).random((10, 200, 2))
    p /= p.sum(axis=2, keepdims=True)
    m = spark.createDataFrame([(k, i, p[k, i].tolist()) for k in range(10) for i in range(200)], "member int, id long, p array<double>")
    got = [r.utility for r in I.batch_bald(m, 2, 2).orderBy("step").collect()]
    assert len(got) == 2 and got[1] > got[0] > 0
    h = lambda q: -(q * np.log(q)).sum(axis=-1)
    first = (h(p.mean(axis=0)) - h(p).mean(axis=0))
    s = first.argmax()
    joint = np.einsum("ka,kib->iab", p[:, s], p) / 10
    second = h(joint.reshape(200, 4)) - h(p).mean(axis=0) - h(p[:, s]).mean()
    second[s] = -1
    assert got == pytest.approx([first.max(), second.max()])


def test_expected_average_precision(spark):
    df = spark.createDataFrame([(0, [0.4, 0.6]), (1, [0.3, 0.7])], "id long, p array<double>")
    assert by_id(I.expected_average_precision(df, 2)) == pytest.approx({0: 2.0, 1: 2.0})


def test_mcpal(spark):
    def best(cand, lab):
        df = pool(spark, [(i, [float(x)], None) for i, x in enumerate(cand)])
        f = C.ParzenWindow([0, 1]).freq(df.select("id", "x"), pool(spark, [(9 + k, [float(x)], y) for k, (x, y) in enumerate(lab)]))
        return by_id(I.cost_reduction(f))

    u = best([0, 1, 2, 5], [(1, 0)])
    assert max(u, key=u.get) == 3 and min(u, key=u.get) == 1
    u = best([0, 1, 2], [(0, 0), (2, 1)])
    assert max(u, key=u.get) == 1
    assert len({round(v, 9) for v in best([0, 1, 2, 5], []).values()}) == 1


def test_expected_error_equals_refitting(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(2).tolist(), int(i % 2) if i < 4 else None) for i in range(10)]
    df = pool(spark, rows)
    lab, cand = df.filter("y is not null"), df.filter("y is null")
    got = by_id(I.expected_error(cand, lab, cand, C.ParzenWindow([0, 1], gamma=0.5)))
    x = np.array([r[1] for r in rows])
    k = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))

    def probas(known):
        f = np.array([[sum(k[e, i] for i, y in known if y == c) for c in (0, 1)] for e in range(4, 10)])
        return f / f.sum(axis=1, keepdims=True)

    known = [(i, i % 2) for i in range(4)]
    now = np.minimum(*probas(known).T).sum()
    for c in range(4, 10):
        p = probas(known)[c - 4]
        future = sum(p[y] * np.minimum(*probas([*known, (c, y)]).T).sum() for y in (0, 1))
        assert got[c] == pytest.approx(now - future)


def test_quire(spark):
    df = pool(spark, [(0, [1.0, 2.0], 0), (1, [5.0, 8.0], None), (2, [8.0, 4.0], 1), (3, [5.0, 4.0], None)])
    u = by_id(D.quire(df, [0, 1], 1.0, lambda a, b: np.zeros((len(a), len(b)))))
    assert u == pytest.approx({1: -3.0, 3: -3.0})


def test_greedy_distances(spark):
    df = pool(spark)
    lab, cand = df.filter("y is not null"), df.filter("y is null")
    d = lambda i, j: math.dist(TINY[i][1], TINY[j][1])
    first = {i: min(d(i, 0), d(i, 1)) for i in (2, 3)}
    got = D.core_set(cand, lab, 2).orderBy("step").collect()
    assert got[0].id == max(first, key=first.get) and got[0].utility == pytest.approx(max(first.values()))
    none = lab.filter("false")
    assert D.core_set(df, none, 1).first().utility == 0
    sums = {i: -sum(d(i, j) for j in range(4)) for i in range(4)}
    assert D.greedy_x(df, none, 1).first().id == max(sums, key=sums.get)
    assert D.greedy_x(cand, lab, 9).count() == 2


def test_no_labels(spark):
    df = pool(spark).withColumn("p", F.array(F.lit(0.5), F.lit(0.5)))
    none = df.filter("false")
    assert set(by_id(D.contrastive(df, none, 2)).values()) == {0.0}
    assert by_id(D.falcun_first(df.select("id", F.array(F.lit(0.5), F.lit(0.5)).alias("p")))) == pytest.approx({i: 0.25 for i in range(4)})


def test_regressors(spark):
    lab = pool(spark, [(0, [0.0], 0.0), (1, [0.0], 1.0), (2, [0.0], 2.0)], "double")
    ask = spark.createDataFrame([(9, [0.0])], "id long, x array<double>")
    assert R.nadaraya_watson().predict(ask, lab).first().pred == pytest.approx(1.0)
    assert R.NormalInverseChi().predict(ask, lab.filter("false")).first().pred == 0
    assert R.nadaraya_watson().predict(ask, lab.filter("false")).first().pred is None
    weighted = lab.withColumn("w", F.when(F.col("id") == 2, 1.0).otherwise(0.0))
    assert R.NormalInverseChi(kappa_0=1e-12).predict(ask, weighted).first().pred == pytest.approx(2.0)


def test_expectations(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.5, 9.0)], "id long, loc double, scale double, nu double")
    e = lambda m, **kw: R.expectation(rows, lambda y: y * y, m, **kw).first().e
    assert e("assume_linear") == 4.0
    assert e("gauss_hermite") == pytest.approx(4.25)
    assert e("monte_carlo", n=200) == pytest.approx(4.25, abs=0.4)
    assert e("quantile", n=200) == pytest.approx(4 + 0.25 * 9 / 7, abs=0.02)
    assert M.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)


def test_leaf_acquisitions(spark):
    rows = [(leaf, y) for leaf, ys in enumerate([(0.0, 2.0, None), (10.0, 12.0, None), (20.0, 22.0, None)]) for y in ys]
    got = R.leaf_acquisitions(spark.createDataFrame(rows, "leaf int, y double"), 1).collect()
    assert [r.n for r in got] == pytest.approx([1 / 3] * 3)


def test_annotators(spark):
    rows = [(i, a, y) for i, ys in enumerate([(1, 1, 0), (1, 1, 1), (0, 0, 0), (0, None, 0)]) for a, y in enumerate(ys)]
    ann = spark.createDataFrame(rows, "id long, annotator int, y int")
    perf = {r.annotator: r.perf for r in M.interval_estimation(ann, [0, 1], mode="mean").collect()}
    assert perf == pytest.approx({0: 5 / 6, 1: 4 / 5, 2: 4 / 6})
    low = {r.annotator: r.perf for r in M.interval_estimation(ann, [0, 1], mode="lower").collect()}
    assert all(low[a] < perf[a] for a in perf)
    u = spark.createDataFrame([(0, 0.5), (1, 0.9), (2, 0.1)], "id long, utility double")
    p = M.interval_estimation(ann, [0, 1], mode="mean").select("annotator", "perf")
    assert [(r.id, r.annotator) for r in M.interval_threshold(u, p, batch_size=4).orderBy("step").collect()] == [(1, 0), (1, 1), (1, 2), (0, 0)]
    assert [(r.id, r.annotator) for r in M.single_annotator(u, p, batch_size=2, perf="perf").orderBy("step").collect()] == [(1, 0), (0, 0)]
    assert {r.id: r["rank"] for r in M.ranks(u).collect()} == {2: 1, 0: 2, 1: 3}


def test_annotator_logistic_learns_confusions(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 2))
    y = (x[:, 0] > 0).astype(int)
    rows = [(i, a, int(y[i] if rng.random() > e else 1 - y[i])) for i in range(200) for a, e in enumerate((0.05, 0.1, 0.4))]
    w, alpha = C.annotator_logistic(spark.createDataFrame(rows, "id long, annotator int, y int"), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"), [0, 1], 8)
    assert ((np.hstack([x, np.ones((200, 1))]) @ w).argmax(1) == y).mean() > 0.93
    assert alpha[0].diagonal().mean() > alpha[2].diagonal().mean()


def test_label_counts_and_reduction():
    assert list(I.label_counts(2, 2)) == [(2, 0), (1, 1), (0, 2)]
    got = I.reduction(np.array([[0.0, 0.0]]), 1)
    a = [1.0, 1.0]
    e0 = 0.5
    e1 = sum(a[l] * sum(a[t] + (l == t) for t in (0, 1) if t != max((0, 1), key=lambda c: ((l == c), -c))) / 6 for l in (0, 1))  # noqa: E741
    assert got[0] == pytest.approx(e0 - e1)


def test_epistemic_logistic_uses_all_blocks(spark, monkeypatch):
    """Labels that do not fit in one block count as those that do."""
    from lodestar.operators import informative, pairs

    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 2))
    y = (x[:, 0] + 0.7 * rng.standard_normal(300) > 0).astype(int)
    pool = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((6, 2)))], "id long, x array<double>")
    got = []
    for size in (pairs.SHIP_BYTES, 1500):
        monkeypatch.setattr(pairs, "SHIP_BYTES", size)
        got.append([r.utility for r in informative.epistemic_logistic(rows, pool, 20).orderBy("id").collect()])
    assert len(list(pairs.blocks_of(pool.select("id", "x", "y")))) > 3
    assert np.allclose(got[0], got[1], atol=1e-9)


def test_typiclust_query_takes_all_labels(spark, monkeypatch):
    from lodestar.plans import registry

    seen = {}
    monkeypatch.setattr(registry.D, "typi_clust", lambda cand, lab, k, seed: seen.update(lab=lab.count()) or cand)
    registry.queries()["typiclust"](spark, "/root/testdata/sf0.01")
    lab, _ = registry.split(registry.embeddings(spark, "/root/testdata/sf0.01"))
    assert seen["lab"] == lab.count()
