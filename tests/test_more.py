import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import selection as S
from lodestar.functions import validation as V
from lodestar.functions.rng import uniform
from lodestar.operators import api, pairs
from lodestar.operators import classifiers as C
from lodestar.operators import diverse as D
from lodestar.operators import grid as G
from lodestar.operators import informative as I
from lodestar.operators import multiannotator as M
from lodestar.operators import regressors as R
from lodestar.streaming import managers as B
from lodestar.streaming import strategies as T

RNG = np.random.default_rng(1)


def pool(spark, n=40, known=10, dim=2):
    rows = [(i, RNG.standard_normal(dim).tolist(), int(i % 2) if i < known else None, 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, w double").cache()
    return df, df.filter("y is not null"), df.filter("y is null")


def test_repeated_ids_are_rows_of_their_own(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 3, [float(i), 1.0]) for i in range(30)], "id long, x array<double>")
    ref = spark.createDataFrame([(i % 2, [float(2 * i), 0.0]) for i in range(40)], "id long, x array<double>")
    key = lambda df: sorted((r.id, tuple(r.x), round(r.d, 9)) for r in df.collect())
    whole = key(D.nearest_distance(rows, ref))
    assert len(whole) == 30
    monkeypatch.setattr(pairs, "SHIP_BYTES", 300)
    assert len(pairs.blocks_of(ref)) > 2
    assert key(D.nearest_distance(rows, ref)) == whole


def test_smallest_is_exact(spark):
    df = spark.range(5000)
    u = sorted((r.u, r.id) for r in df.select("id", uniform(3, "id").alias("u")).collect())
    for n in (0, 1, 777, 5000, 6000):
        assert sorted(r.id for r in S.smallest(df, uniform(3, "id"), n).collect()) == sorted(i for _, i in u[:n])


def test_rank_methods(spark):
    v = [3.0, 1.0, 3.0, None, 2.0, 3.0, 1.0]
    df = spark.createDataFrame(list(enumerate(v)), "id long, v double")
    want = {"dense": [3, 1, 3, None, 2, 3, 1], "min": [4, 1, 4, None, 3, 4, 1], "max": [6, 2, 6, None, 3, 6, 2], "average": [5, 1.5, 5, None, 3, 5, 1.5]}
    for method, ranks in want.items():
        got = {r._v: r._r for r in S.value_ranks(df, "v", method).collect()}
        assert [got.get(x) for x in v] == ranks
    both = df.withColumn("b", F.lit(0.0)).withColumn("batch", F.col("id") % 2)
    got = {r.id: r.rank for r in S.combine_ranking(both, "v", "b", method="ordinal", id_col="id").collect()}
    assert [got[i] for i in range(7)] == [x if x is None else x + 0.5 for x in (4, 1, 5, None, 3, 6, 2)]
    got = {r.id: r.rank for r in S.combine_ranking(both, "v", "b", per="batch").collect()}
    assert [got[i] for i in range(7)] == [x if x is None else x + 0.5 for x in (3, 1, 3, None, 2, 2, 1)]


def test_long_greedy_batches_refresh_their_state(spark, monkeypatch):
    df, lab, cand = pool(spark)
    whole = D.core_set(cand, lab, 20).collect()
    monkeypatch.setattr(D, "REFRESH", 3)
    assert D.core_set(cand, lab, 20).collect() == whole and len(whole) == 20


def test_typicality_of_all_clusters_at_once(spark):
    rows = [(i, [float(i % 7), float(i * i % 11)], i % 3) for i in range(20)] + [(99, [0.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "id long, x array<double>, cluster int")
    got = {r.id: (r.cluster, r.utility) for r in D.typicality(df, 3).collect()}
    for i, x, c in rows:
        d = sorted(math.dist(x, z) for j, z, k in rows if k == c and j != i)[:3]
        assert got[i][0] == c and got[i][1] == pytest.approx(1 / (sum(d) / len(d) + 1e-7) if d else 1.0)


def by_sign(rows, k, seed, weight):
    """A clustering by the signs of two features, with four centres."""
    out = rows.withColumn("cluster", (F.col("x")[0] > 0).cast("int") + 2 * (F.col("x")[1] > 0).cast("int"))
    return out, np.array([[a, b] for b in (-1.0, 1.0) for a in (-1.0, 1.0)])


def test_other_clusterings(spark):
    from pyspark.ml.clustering import BisectingKMeans

    df, lab, cand = pool(spark, 60, 1)
    got = D.typi_clust(cand, lab, 2, estimator=by_sign).orderBy("step").collect()
    rows = {r.id: (r.x[0] > 0) + 2 * (r.x[1] > 0) for r in df.collect()}
    sizes = sorted(((-sum(c == k for c in rows.values()), k) for k in set(rows.values()) if k != rows[0]))
    assert [rows[r.id] for r in got] == [k for _, k in sizes[:2]]
    clf = C.ParzenWindow([0, 1], gamma=0.5)
    assert D.clue(clf.probas(cand.select("id", "x"), lab), 4, estimator=by_sign).count() == 4
    assert D.drop_query(cand, lambda r: clf.predict(clf.probas(r, lab)), 3, estimator=BisectingKMeans(seed=1)).count() == 3


def test_embedding_hooks(spark):
    df, lab, cand = pool(spark)
    clf = C.ParzenWindow([0, 1], gamma=0.5)
    p, q = clf.probas(cand.select("id", "x"), lab), clf.probas(lab.select("id", "x"), lab)
    double = lambda d: d.withColumn("e", F.transform("x", lambda v: 2 * v))
    plain = {r.id: r.utility for r in D.contrastive(p, q, 2, 3).collect()}
    assert {r.id: r.utility for r in D.contrastive(double(p), double(q), 2, 3, "e").collect()} == pytest.approx(plain)
    a, b = D.badge(p, 2, 1).first(), D.badge(double(p), 2, 1, embedding="e").first()
    assert a.id == b.id and b.utility == pytest.approx(4 * a.utility)


def test_discriminator_fitted_anew(spark):
    df, lab, cand = pool(spark)
    got = D.discriminative_steps(cand, lab, 3, gamma=0.5).collect()
    left, known = cand, lab
    for r in got:
        best = S.top_k(D.discriminative(left, known, gamma=0.5), 1).first()
        assert (best.id, best.utility) == (r.id, pytest.approx(r.utility))
        known = known.unionByName(left.filter(F.col("id") == r.id))
        left = left.filter(F.col("id") != r.id)


def test_committee_in_one_pass(spark):
    df, lab, cand = pool(spark)
    club = [C.ParzenWindow([0, 1], gamma=g, class_prior=c) for g, c in ((0.1, 0.0), (1.0, 0.5), (3.0, 0.0))]
    one, many = I.committee(cand, lab, club), I.members_of(cand, lab, club)
    for f in (lambda m: I.committee_kl(m, 2), lambda m: I.bald(m, 2)):
        assert {r.id: r.utility for r in f(one).collect()} == pytest.approx({r.id: r.utility for r in f(many).collect()})
    near = [C.ParzenWindow([0, 1], gamma=1.0, n_neighbors=3), club[0]]
    assert {r.id: r.ps for r in I.committee(cand, df, near).collect()}.keys() == {r.id for r in cand.collect()}


def test_precomputed_kernel(spark):
    df, lab, cand = pool(spark)
    known = lab.orderBy("id").collect()
    rows = [(r.id, [math.exp(-0.5 * math.dist(r.x, k.x) ** 2) for k in known]) for r in cand.collect()]
    place = {k.id: n for n, k in enumerate(known)}
    ref = spark.createDataFrame([(k.id, k.x, k.y, k.w, place[k.id]) for k in known], "id long, x array<double>, y int, w double, place int")
    got = {r.id: r.freq for r in C.ParzenWindow([0, 1], metric="precomputed").freq(spark.createDataFrame(rows, "id long, x array<double>"), ref).collect()}
    for r in C.ParzenWindow([0, 1], gamma=0.5).freq(cand.select("id", "x"), lab).collect():
        assert got[r.id] == pytest.approx(r.freq)


def test_losses_norms_and_feature_maps(spark):
    rows = [(i, [float(i % 5), float(i % 3)], float(i % 4) if i < 8 else None, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, w double")
    lab, cand = df.filter("y is not null"), df.filter("y is null")
    reg = R.NormalInverseChi(gamma=0.5)
    u = lambda **kw: {r.id: r.utility for r in R.model_change(cand, lab, reg, 2, seed=3, **kw).collect()}
    two, inf, mapped = u(), u(norm=math.inf), u(feature_map=lambda x: F.concat(x, F.array(F.lit(1.0))))
    x = {r[0]: r[1] for r in rows}
    for i in two:
        size = math.hypot(*x[i])
        if size:
            assert inf[i] / two[i] == pytest.approx(max(x[i]) / size) if two[i] else inf[i] == 0
            assert mapped[i] == pytest.approx(two[i] / size * math.hypot(*x[i], 1))
    for method in ("assume_linear", "gauss_hermite", "quantile", "monte_carlo", "dynamic_quad"):
        assert all(r.utility >= 0 for r in R.model_output_change(cand, lab, cand, reg, method, 4, loss=lambda a, b: abs(a - b)).collect())


def test_student_t_by_quadrature():
    nu, loc, scale = np.array([3.0, 8.0, 30.0]), np.array([0.0, 1.0, -2.0]), np.array([1.0, 0.5, 2.0])
    np.testing.assert_allclose(R._log_gamma(np.array([0.5, 1.0, 7.3, 400.0])), [math.lgamma(v) for v in (0.5, 1.0, 7.3, 400.0)], rtol=1e-9, atol=1e-9)
    y = np.linspace(-400, 400, 4_000_001)
    for k in range(3):
        one = tuple(v[k : k + 1] for v in (nu, loc, scale))
        old = (np.array([5.0]), np.array([0.3]), np.array([1.2]))
        p = np.exp(R.t_log_density(y, *one))
        assert np.trapezoid(p, y) == pytest.approx(1, abs=1e-3)
        assert R.cross_entropy(one, old, 60)[0] == pytest.approx(-np.trapezoid(p * R.t_log_density(y, *old), y), rel=0.01)


def test_one_annotator_strategy_for_many(spark):
    df, _, _ = pool(spark, 12, 0)
    ann = spark.createDataFrame([(i, a, (i + a) % 2 if i < 6 or a == 0 else None) for i in range(12) for a in range(3)], "id long, annotator int, y int")
    strategy = M.SingleAnnotatorStrategy(api.Strategy("uncertainty", C.ParzenWindow([0, 1], gamma=0.5)), [0, 1])
    got, scored = strategy.query(df.select("id", "x"), ann, batch_size=4, per_sample=2, return_utilities=True)
    rows = got.orderBy("step").collect()
    assert [r.step for r in rows] == [1, 2, 3, 4] and all(r.id >= 6 and r.annotator in (1, 2) for r in rows)
    assert len({r.id for r in rows}) == 2 and scored.count() == 6
    assert {r.annotator for r in strategy.query(df.select("id", "x"), ann, annotators=[2], batch_size=3).collect()} == {2}
    last = lambda a: a.groupBy("id").agg(F.max_by("y", "annotator").alias("y"))
    other = M.SingleAnnotatorStrategy(strategy.strategy, [0, 1], aggregate=last)
    assert {r.id: r.y for r in other.pool(df.select("id", "x"), ann).collect()} == {i: (i + 2) % 2 if i < 6 else None for i in range(12)}


def test_query_leaves_the_state_and_update_moves_it():
    items = [None if i % 9 == 0 else float(u) for i, u in enumerate(RNG.random(400))]
    for m in (B.FixedUncertaintyManager(), B.VariableUncertaintyManager(), B.RandomVariableUncertaintyManager(seed=2), B.SplitManager(seed=1), B.RandomBudgetManager(), B.DensityBasedSplitManager(), B.BalancedQuantileManager(), B.PeriodicManager(), B.RandomManager(allow_exceeding=False)):
        one, two = m.initial(), m.initial()
        whole = [m.step(one, u) for u in items]
        got = []
        for s in range(0, 400, 50):
            before = repr(two)
            q = m.query(two, items[s : s + 50])
            assert repr(two) == before
            m.update(two, items[s : s + 50], q)
            got += q
        assert got == whole and one == two
    d = B.DensityStrategy()
    state = d.initial()
    assert d.query(state, [0.5, 0.9], [[0.0], [1.0]]) == [False, True] and state == d.initial()


def test_balanced_quantile_by_definition():
    m, history, queried = B.BalancedQuantileManager(), [], 0
    state = m.initial()
    for n, u in enumerate(np.round(RNG.random(600), 2).tolist(), 1):
        history = [*history, u][-100:]
        want = u >= float(np.quantile(history, 0.9)) - (max(history) - min(history)) * (0.1 * n - queried) / 50
        queried += want
        assert m.step(state, u) == want


def test_budget_of_a_given_manager():
    m = B.BalancedQuantileManager(budget=0.2)
    assert B.check_budget_manager(None, m) is m and B.check_budget_manager(0.3).budget == 0.3
    with pytest.warns(UserWarning, match="holds"):
        assert B.check_budget_manager(0.5, m) is m


def test_probabilistic_stream(spark):
    df, lab, cand = pool(spark, 60, 20)
    rows = cand.withColumn("key", F.lit(1)).withColumn("density", 1.0 + F.col("id") % 3)
    clf = C.ParzenWindow([0, 1], gamma=0.5)
    got = {r.id: r for r in T.probabilistic(rows, lab, clf, "key", ["id"], budget=0.25, weight="density").collect()}
    u = {r.id: r.utility for r in I.cost_reduction(clf.freq(cand.select("id", "x"), lab), 2, 1e-3).collect()}
    m = B.BalancedQuantileManager(budget=0.25)
    state = m.initial()
    for i in sorted(u):
        assert got[i].utility == pytest.approx(u[i] * (1 + i % 3), abs=1e-8)
        assert got[i].queried == m.step(state, got[i].utility)
    other = T.probabilistic(rows, lab, clf, "key", ["id"], kernel=C.ParzenWindow([0, 1], gamma=2.0))
    assert other.count() == 40


def test_stream_pictures(spark):
    rows = spark.createDataFrame([(i, [i / 10], i % 2, 1.0, i % 3 == 0, i) for i in range(20)], "id long, x array<double>, y int, w double, queried boolean, t long")
    lines = G.stream_lines(rows.drop("t").withColumn("at", F.col("id")), order=("at",)).orderBy("t").collect()
    assert [r.t for r in lines] == list(range(20)) and all(r.last == 19 for r in lines)
    assert [r.t for r in lines if r.current] == [19] and [r.y for r in lines[:4]] == [0, None, None, 1]
    clf = C.ParzenWindow([0, 1], gamma=50.0)
    got = G.stream_boundary(rows, clf, 5, 7).collect()
    assert {r.t for r in got} == {5, 10, 15, 20} and len(got) == 28
    for r in clf.predict(clf.probas(spark.createDataFrame([(0, [1.9])], "id long, x array<double>"), rows.filter("t < 10"))).collect():
        assert [g.pred for g in got if g.t == 10 and g.id == 6] == [r.pred]


def test_radius_by_purity(spark):
    rows = [(i, [10.0 * (i % 3) + 0.1 * (i // 3), 0.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    classes = lambda rows, k, seed, weight: (rows.withColumn("cluster", F.round(F.col("x")[0] / 10).cast("int")), np.zeros((k, 2)))
    none = df.limit(0)
    got = D.prob_cover(df, none, k=3, n_classes=3, deltas=[0.5, 5.0, 20.0], estimator=classes).collect()
    assert sorted(r.id % 3 for r in got) == [0, 1, 2] and [r.utility for r in got] == [10.0, 10.0, 10.0]
    assert D.prob_cover(df, none, 0.95, 2, metric="manhattan").count() == 2


def test_cost_embedding_with_a_regressor(spark):
    df, lab, cand = pool(spark)
    cost = [[0, 1], [2, 0]]
    kernel = {r.id: r.utility for r in R.cost_embedding(cand, lab, [0, 1], cost, gamma=0.5).collect()}
    same = {r.id: r.utility for r in R.cost_embedding(cand, lab, [0, 1], cost, regressor=R.nadaraya_watson(gamma=0.5)).collect()}
    assert same == pytest.approx(kernel)
    assert {r.utility for r in R.cost_embedding(cand, lab.limit(0), [0, 1], cost, regressor=R.nadaraya_watson(gamma=0.5)).collect()} == {1.0}


def test_pools_and_indices_are_checked(spark):
    df, _, _ = pool(spark, 10, 4)
    assert V.check_pool(df, [0, 1], 2) == 2 and V.check_indices([1, 2], df) == [1, 2]
    bad = [(None, [0.0], 0, 1.0), (1, [float("nan")], 5, -1.0)]
    with pytest.raises(ValueError, match="without an id, features that are no finite numbers, negative weights, labels of no known class"):
        V.check_pool(spark.createDataFrame(bad, "id long, x array<double>, y int, w double"), [0, 1])
    with pytest.raises(ValueError, match="features are needed"):
        V.check_pool(df, None, 3)
    with pytest.raises(ValueError, match="repeat"):
        V.check_indices([1, 1], df)
    with pytest.raises(ValueError, match="of no row"):
        V.check_indices([1, 99], df)
