import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from lodestar.operators import api, pairs
from lodestar.operators import classifiers as C
from lodestar.operators import informative as I
from lodestar.operators import retrain as N

RNG = np.random.default_rng(0)
X = RNG.standard_normal((60, 2))
Y = (X[:, 0] + X[:, 1] > 0).astype(int)


def test_softmax_is_at_the_maximum():
    w = RNG.uniform(0.5, 2, 60)
    model = N.softmax(2, ridge=0.7)(X, Y, w)
    near = [N.softmax(2, ridge=0.7, steps=200)(X, Y, w)(X[:5]), model(X[:5])]
    np.testing.assert_allclose(near[0], near[1], atol=1e-9)
    assert (model(X).argmax(axis=1) == Y).mean() > 0.95
    np.testing.assert_allclose(model(X).sum(axis=1), 1)


def test_gaussian_against_the_formula():
    model = N.gaussian(3, floor=0.0)(X, Y, np.ones(60))
    dens = np.stack([np.prod(np.exp(-((X - X[Y == c].mean(0)) ** 2) / (2 * X[Y == c].var(0))) / np.sqrt(2 * np.pi * X[Y == c].var(0)), axis=1) * (Y == c).mean() for c in (0, 1)], axis=1)
    np.testing.assert_allclose(model(X)[:, :2], dens / dens.sum(axis=1, keepdims=True), rtol=1e-8)
    assert (model(X)[:, 2] == 0).all()


def test_index_classifier():
    clf = N.IndexClassifier(N.softmax(2), X, Y, None, 2)
    with pytest.raises(ValueError, match="not fitted"):
        clf.predict_proba(X)
    assert (clf.fit([]).predict_proba(X[:2]) == 0.5).all()
    assert (clf.fit([int(np.flatnonzero(Y == 1)[0])]).predict_proba(X[:2])[:, 1] == 1).all()
    base = clf.fit(range(20)).predict_proba(X)
    more = clf.partial_fit([30], [1 - Y[30]]).predict_proba(X)
    np.testing.assert_allclose(more, N.softmax(2)(X[[*range(20), 30]], np.append(Y[:20], 1 - Y[30]), np.ones(21))(X))
    again = clf.partial_fit([30], [Y[30]]).predict_proba(X)  # trials start from the base, not from each other
    np.testing.assert_allclose(again, N.softmax(2)(X[[*range(20), 30]], Y[[*range(20), 30]], np.ones(21))(X))
    flipped = clf.partial_fit([3], [1 - Y[3]]).predict_proba(X)  # a place holds one label
    y = Y[:20].copy()
    y[3] = 1 - y[3]
    np.testing.assert_allclose(flipped, N.softmax(2)(X[:20], y, np.ones(20))(X))
    np.testing.assert_allclose(clf.fit(range(10)).partial_fit(range(10, 20), keep=True).predict_proba(X), base)


def frames(spark):
    rows = [(i, x.tolist(), int(c) if i < 12 else None, 1.0 + i % 2) for i, (x, c) in enumerate(zip(X[:30], Y, strict=False))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, w double")
    return df, df.filter("y is not null"), df.filter("y is null")


@pytest.mark.parametrize("method", ["misclassification_loss", "log_loss"])
def test_expected_error_against_refitting(spark, method):
    df, lab, cand = frames(spark)
    got = {r.id: r.utility for r in I.expected_error_refit(cand, lab, cand, N.gaussian(2), [0, 1], method).collect()}
    w, fit = np.array([1.0 + i % 2 for i in range(30)]), N.gaussian(2)

    def risk(p):
        return -(p * np.log(p + I.EPS)).sum() if method == "log_loss" else (w[12:] * p.min(axis=1)).sum()

    start = fit(X[:12], Y[:12], w[:12])
    for i in range(12, 30):
        p = start(X[i : i + 1])[0]
        future = sum(p[c] * risk(fit(X[[*range(12), i]], np.append(Y[:12], c), w[[*range(12), i]])(X[12:30])) for c in (0, 1))
        assert got[i] == pytest.approx(risk(start(X[12:30])) - future)


def test_other_estimators_in_strategies(spark, monkeypatch):
    df, lab, cand = frames(spark)
    for clf in (N.LocalClassifier(N.softmax(2), [0, 1]), C.SparkMLClassifier(LogisticRegression(maxIter=10), [0, 1])):
        assert api.Strategy("uncertainty", clf, params={"method": "entropy"}).query(df, batch_size=3).count() == 3
        assert api.Strategy("contrastive", clf, params={"k": 2}).query(df, batch_size=2).count() == 2
    assert api.Strategy("expected_error", N.LocalClassifier(N.gaussian(2), [0, 1])).query(df, batch_size=2).count() == 2
    club = [N.LocalClassifier(N.softmax(2), [0, 1]), C.ParzenWindow([0, 1], gamma=0.5)]
    assert api.Strategy("bald", club).query(df, batch_size=2).count() == 2
    monkeypatch.setattr(pairs, "SHIP_BYTES", 100)
    with pytest.raises(ValueError, match="each task can hold"):
        I.expected_error_refit(cand, lab, cand, N.gaussian(2), [0, 1])


def test_label_shares_where_nothing_can_be_fitted(spark):
    rows = spark.createDataFrame([(1, [0.0])], "id long, x array<double>")
    pool = spark.createDataFrame([(1, [0.0], "b", 3.0), (2, [1.0], None, 1.0)], "id long, x array<double>, y string, w double")
    clf = C.SparkMLClassifier(LogisticRegression(), ["a", "b"])
    assert clf.probas(rows, pool).first().p == [0.0, 1.0]
    assert clf.probas(rows, pool.filter("y is null")).first().p == [0.5, 0.5]


def test_value_of_information_against_refitting(spark):
    df, lab, cand = frames(spark)
    got = {r.id: r.utility for r in I.value_of_information_refit(cand, lab, N.gaussian(2), [0, 1]).collect()}
    w, fit, cost = np.array([1.0 + i % 2 for i in range(30)]), N.gaussian(2), 1 - np.eye(2)

    def risk(model, known):
        p = model(X[:30])
        return sum(w[i] * (cost[known[i]] @ p[i] if i in known else p[i] @ cost @ p[i]) for i in range(30))

    known = {i: int(Y[i]) for i in range(12)}
    start = fit(X[:12], Y[:12], w[:12])
    for i in range(12, 30):
        p = start(X[i : i + 1])[0]
        future = sum(p[c] * risk(fit(X[[*range(12), i]], np.append(Y[:12], c), w[[*range(12), i]]), known | {i: c}) for c in (0, 1))
        assert got[i] == pytest.approx(risk(start, known) - future)
    assert api.Strategy("value_of_information", N.LocalClassifier(N.gaussian(2), [0, 1]), params={"normalize": True}).query(df, batch_size=2).count() == 2
