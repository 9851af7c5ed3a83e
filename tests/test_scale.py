"""Queries over larger tables: rows that repeat, pools of many rows."""

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.plans import registry


def test_prob_cover_query_ends_when_all_is_covered(spark, tmp_path):
    rows = [(k, "a", f"Brand#{1 + k % 2}", "b", 1 + k // 2 % 3, 900.0) for k in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["prob_cover_k3"]).fetchall()
    got = registry.queries()["prob_cover_k3"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


POSTERIORS = {
    "emoc_absolute": lambda R, c, l, r: R.model_output_change(c, l, c, r, loss=lambda a, b: abs(a - b)),
    "emoc_linear": lambda R, c, l, r: R.model_output_change(c, l, c, r),
    "emvr_linear": lambda R, c, l, r: R.variance_reduction(c, l, c, r),
    "emvr_gauss_hermite": lambda R, c, l, r: R.variance_reduction(c, l, c, r, "gauss_hermite", 3),
    "kl_max": lambda R, c, l, r: R.information_gain(c, l, c, r, n=3),
}


@pytest.mark.parametrize("name", POSTERIORS)
def test_rows_at_one_place_are_asked_about_once(spark, name, monkeypatch):
    """As many pairs as there are pairs of places; utilities as of all rows."""
    from lodestar.operators import regressors as R

    rows = [(k, [float(k % 5), 0.5 * (k % 2)], float(k % 7) if k < 12 else None, 1.0 + k % 2) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, w double")
    lab, cand, reg = df.filter("y is not null"), df.filter("y is null"), R.NormalInverseChi(gamma=0.5, shift=3.0)
    asked = []
    whole = R.against
    monkeypatch.setattr(R, "against", lambda rows, ref, *a, **kw: asked.append((rows.count(), ref.count())) or whole(rows, ref, *a, **kw))
    got = {r.id: r.utility for r in POSTERIORS[name](R, cand, lab, reg).collect()}
    assert len(got) == 188 and asked and all(n <= 10 and m <= 10 for n, m in asked)
    # by hand, for all pairs of rows
    x, t, w = (np.array([r[k] for r in rows[:12]], dtype=float) for k in (1, 2, 3))
    sums = lambda p: [float(v) for v in np.exp(-0.5 * ((x - np.array(p)) ** 2).sum(1)) @ (w[:, None] * np.stack([np.ones(12), t - 3, (t - 3) ** 2], axis=1))]
    post = lambda s: [v.item() for v in reg.posterior(*(np.array([v]) for v in s), lib=np)]
    place = {r[0]: r[1] for r in rows[12:]}
    nodes = R.gauss_hermite(3) if name in ("kl_max", "emvr_gauss_hermite") else [(0.0, 1.0)]
    var = lambda d: d[2] ** 2 * d[0] / (d[0] - 2)
    for i in (12, 13, 21):
        nu, loc, scale = post(sums(place[i]))
        total = 0.0
        for z, v in nodes:
            new = loc + scale * z - 3
            for e in place.values():
                s, k = sums(e), float(np.exp(-0.5 * ((np.array(e) - place[i]) ** 2).sum()))
                o, n = post(s), post([s[0] + k, s[1] + k * new, s[2] + k * new * new])
                total += v * {"emoc_absolute": abs(n[1] - o[1]), "emoc_linear": (n[1] - o[1]) ** 2, "kl_max": 0.5 * np.log(var(o) / var(n)) + (var(n) + (n[1] - o[1]) ** 2) / (2 * var(o)) - 0.5}.get(name, var(o) - var(n))
        assert got[i] == pytest.approx(total / len(place), rel=1e-9)


@pytest.mark.parametrize("name", ["emoc_linear", "emvr_linear", "emvr_gauss_hermite", "kl_max"])
def test_pool_is_read_three_times(spark, name):
    """Once for the labelled places, once for the candidates' places and once for the result."""
    from lodestar.operators import regressors as R

    read = spark.sparkContext.accumulator(0)

    def row(k):
        read.add(1)
        return k, [float(k % 5), 0.5 * (k % 2)], float(k % 7) if k < 12 else None, 1.0

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(100), 2).map(row), "id long, x array<double>, y double, w double")
    lab, cand = df.filter("y is not null"), df.filter("y is null")
    assert len(POSTERIORS[name](R, cand, lab, R.NormalInverseChi(gamma=0.5, shift=3.0)).collect()) == 88
    assert read.value == 300


def whole_quire(x, y, classes, lmbda=1.0):
    """QUIRE by its definition: for each row the worst sign, the others' labels at their best, over the inverse of the whole matrix."""
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    el = np.linalg.inv(np.exp(-d / x.shape[1]) + lmbda * np.eye(len(x)))
    lab, un = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    out = {}
    for s in un:
        rest, worst = un[un != s], -np.inf
        for c in classes:
            own = np.append(np.where(y[lab] == c, 1.0, -1.0), 0.0)
            for own[-1] in (1.0, -1.0):
                at = np.append(lab, s)
                v = el[np.ix_(rest, at)] @ own
                worst = max(worst, own @ el[np.ix_(at, at)] @ own - v @ np.linalg.solve(el[np.ix_(rest, rest)], v))
        out[int(s)] = -worst
    return out


def test_quire_takes_pools_of_any_size(spark, monkeypatch):
    """Blocks smaller than the labelled rows, rows at one place, and a pool larger than one matrix was."""
    from lodestar.operators import diverse as D

    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 3))
    x[5], x[20], x[21] = x[3], x[3], x[30]
    y = np.where(np.arange(40) < 16, np.arange(40) % 3, -1)
    frame = lambda x, y: spark.createDataFrame([(k, v.tolist(), int(c) if c >= 0 else None) for k, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    monkeypatch.setattr(D, "BLOCK_ROWS", 4)
    for lmbda in (1.0, 0.3):
        got = {r.id: r.utility for r in D.quire(frame(x, y), [0, 1, 2], lmbda).collect()}
        assert got == pytest.approx(whole_quire(x, y, [0, 1, 2], lmbda))
    assert {r.utility for r in D.quire(frame(x, np.full(40, -1)), [0, 1]).collect()} == {-0.5}
    assert D.quire(frame(rng.standard_normal((4500, 2)), np.where(np.arange(4500) < 10, 0, -1)), [0, 1]).count() == 4490


def test_expected_precision_of_many_rows(spark):
    """As the recursion for each row, and in time for pools that it could not take."""
    from lodestar.operators import informative as I

    def precision(p):
        chance, worth, t = np.zeros(len(p) + 1), np.zeros(len(p) + 1), np.arange(len(p) + 1)
        chance[0] = worth[0] = 1.0
        for n, q in enumerate(p, 1):
            hit, worth_hit = q * chance[:-1], q * worth[:-1]
            chance, worth = (1 - q) * chance, (1 - q) * worth
            chance[1:] += hit
            worth[1:] += worth_hit + hit * t[1:] / n
            chance[0] = worth[0] = 0.0
        return float((worth[1:] / t[1:]).sum())

    frame = lambda p: spark.createDataFrame([(k, [float(v), float(1 - v)]) for k, v in enumerate(p)], "id long, p array<double>")
    rng = np.random.default_rng(0)
    for p in (rng.random(60), np.round(rng.random(60), 1), 1e-6 * rng.random(9), np.array([0.3, 0.6]), np.array([0.3]), np.ones(5)):
        got = {r.id: r.utility for r in I.expected_average_precision(frame(p), 2).collect()}
        want = {k: sum(precision(np.sort(np.delete(q, k))[::-1]) for q in (p, 1 - p)) for k in range(len(p))}
        assert got == pytest.approx(want, rel=1e-11)
    start = time.perf_counter()
    assert I.expected_average_precision(frame(rng.random(8000)), 2).agg({"utility": "count"}).first()[0] == 8000
    assert time.perf_counter() - start < 60


def test_epistemic_logistic_finds_its_levels(spark):
    """As the maximum over all levels, each with Newton steps of its own; and the query on sf0.1 in time."""
    from lodestar.operators import informative as I

    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 2))
    y = (x[:, 0] + 0.5 * rng.standard_normal(40) > 0.3).astype(int)
    ask = np.concatenate([2 * rng.standard_normal((6, 2)), x[:2], np.zeros((1, 2))])
    pool = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    got = [r.utility for r in I.epistemic_logistic(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(ask)], "id long, x array<double>"), pool, 50).orderBy("id").collect()]
    one = np.hstack([x, np.ones((40, 1))])
    like = lambda w: float((y * (one @ w) - np.logaddexp(0, one @ w)).sum() - 0.5e-3 * w @ w)

    def newton(w0, z):
        t = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-one @ (w0 + z @ t)))
            t = t + np.linalg.solve((one @ z * (p * (1 - p))[:, None]).T @ (one @ z) + 1e-3 * np.eye(len(t)), z.T @ (one.T @ (y - p) - 1e-3 * (w0 + z @ t)))
        return w0 + z @ t

    best, want = like(newton(np.zeros(3), np.eye(3))), []
    for v in ask:
        a = np.array([*v, 1.0])
        z = np.linalg.svd(a[None])[2][1:].T
        levels = [(m, np.exp(min(0.0, like(newton(a * (np.log(m / (1 - m)) / (a @ a)), z)) - best))) for m in (np.arange(50) + 0.5) / 50]
        want.append(min(max(0.0, *(min(r, 2 * m - 1) for m, r in levels)), max(0.0, *(min(r, 1 - 2 * m) for m, r in levels))))
    assert got == pytest.approx(want, abs=1e-8) and max(want) > 0.1
    start = time.perf_counter()
    assert registry.queries()["epistemic_logistic"](spark, "/root/testdata/sf0.1").agg({"utility": "sum"}).first()[0] > 0
    assert time.perf_counter() - start < 60


def test_epistemic_logistic_of_labels_that_a_plane_parts(spark):
    """Fits far from all levels, where whole Newton steps overshoot: as damped Newton steps at every level."""
    from lodestar.operators import informative as I

    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 6))
    y = (x[:, 0] > 0.2).astype(int)
    ask = np.concatenate([rng.standard_normal((5, 6)), 0.1 * rng.standard_normal((3, 6)), x[:2]])
    pool = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(ask)] + [(99, [math.nan] * 6)], "id long, x array<double>")
    got = [r.utility for r in I.epistemic_logistic(frame, pool, 50).orderBy("id").collect()]
    one = np.hstack([x, np.ones((30, 1))])
    like = lambda w: float((y * (one @ w) - np.logaddexp(0, one @ w)).sum() - 0.5e-3 * w @ w)

    def newton(w0, z):
        t = np.zeros(z.shape[1])
        for _ in range(100):
            w = w0 + z @ t
            p = 1 / (1 + np.exp(np.clip(-one @ w, -700, 700)))
            g = z.T @ (one.T @ (y - p) - 1e-3 * w)
            move = np.linalg.solve((one @ z * (p * (1 - p))[:, None]).T @ (one @ z) + 1e-3 * np.eye(len(t)), g)
            if g @ move < 1e-13:
                break
            while like(w0 + z @ (t + move)) < like(w) - 1e-12:
                move = move / 2
            t = t + move
        return w0 + z @ t

    best, want = like(newton(np.zeros(7), np.eye(7))), []
    for v in ask:
        a = np.array([*v, 1.0])
        z = np.linalg.svd(a[None])[2][1:].T
        levels = [(m, np.exp(min(0.0, like(newton(a * (np.log(m / (1 - m)) / (a @ a)), z)) - best))) for m in (np.arange(50) + 0.5) / 50]
        want.append(min(max(0.0, *(min(r, 2 * m - 1) for m, r in levels)), max(0.0, *(min(r, 1 - 2 * m) for m, r in levels))))
    assert got[:-1] == pytest.approx(want, abs=1e-8) and max(want) > 0.9 and min(want) < 0.3
    assert got[-1] is None


def test_epistemic_logistic_of_many_rows(spark):
    """24 000 candidates by 6000 labelled rows, with every row given an answer, in time."""
    from lodestar.operators import informative as I

    rows = spark.range(30000, numPartitions=8).select("id", F.array(*(F.randn(k) for k in range(32))).alias("x"), F.randn(99).alias("noise"))
    pool = rows.withColumn("y", F.when(F.col("id") % 5 == 0, (F.col("x")[0] + F.col("noise") > 0).cast("int")))
    start = time.perf_counter()
    n, low, high = I.epistemic_logistic(pool.filter("y is null"), pool).agg(F.count("utility"), F.min("utility"), F.max("utility")).first()
    assert (n, low >= 0, 0 < high < 1) == (24000, True, True) and time.perf_counter() - start < 60


def test_epistemic_logistic_keeps_equal_places_once(spark):
    """Rows at equal places count by their number, as rows by themselves do."""
    from lodestar.operators import informative as I

    class Rows:
        def __init__(self, x, y):
            self.side = {"x": x, "y": y, "n": np.ones(len(y), dtype=int)}

        def load(self):
            return self.side

    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((70, 3)), rng.integers(1, 4, 70), axis=0)
    y = (x[:, 0] + rng.standard_normal(len(x)) > 0).astype(float)
    ask = rng.standard_normal((20, 3))
    pool = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    got = [r.utility for r in I.epistemic_logistic(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(ask)], "id long, x array<double>"), pool, 50).orderBy("id").collect()]
    fit = I.LogisticPeaks([Rows(x[:50], y[:50]), Rows(x[50:], y[50:])], 1e-3)
    assert got == pytest.approx(fit.supports(np.hstack([ask, np.ones((20, 1))]), (np.arange(50) + 0.5) / 50).tolist(), abs=1e-9) and max(got) > 0.1


def test_many_clusters_are_made_in_time(spark):
    """A cluster for each of many labelled rows; each row in that of its nearest centre, each centre the mean of its rows."""
    from lodestar.operators import diverse as D

    rng = np.random.default_rng(0)
    spots = 100 * rng.standard_normal((300, 2))
    x = np.concatenate([spots + 0.01 * rng.standard_normal((300, 2)) for _ in range(10)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").repartition(4)
    rows, centres = D.clustered(df, 290, 1)
    own = dict((r.id, r.cluster) for r in rows.collect())
    near = ((x[:, None] - centres[None]) ** 2).sum(-1)
    own = np.array([own[k] for k in range(3000)])
    assert centres.shape == (290, 2) and np.allclose(near[np.arange(3000), own], near.min(axis=1), atol=1e-6)
    lab, cand = df.filter("id % 3 = 0"), df.filter("id % 3 <> 0")
    start = time.perf_counter()
    got = D.typi_clust(cand, lab, 2, 1).collect()
    assert len({r.id for r in got}) == 2 and all(r.id % 3 for r in got) and time.perf_counter() - start < 60
