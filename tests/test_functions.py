import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import exprs as E
from lodestar.functions import labels as L
from lodestar.functions import selection as S
from lodestar.functions import validation as V
from lodestar.functions.rng import normal, uniform

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "want"), [(lambda p: E.least_confident(p), [0.5, 0.3]), (lambda p: E.entropy(p), [1.029653014, 0.8018185525]), (lambda p: E.margin(p), [0.8, 0.5])], ids=["lc", "entropy", "margin"]
)
def test_uncertainty_scores(spark, f, want):
    df = spark.createDataFrame([(1, [0.2, 0.5, 0.3]), (2, [0.1, 0.7, 0.2])], "id long, p array<double>")
    assert [r.v for r in df.orderBy("id").select(f(F.col("p")).alias("v")).collect()] == pytest.approx(want)


def test_normalised_and_empty_mass(spark):
    assert one(spark, E.normalised(F.col("f")), f=[0.0, 1.0, 2.0]) == pytest.approx([0, 1 / 3, 2 / 3])
    assert one(spark, E.normalised(F.col("f")), f=[0.0, 0.0]) == [0.5, 0.5]
    assert one(spark, E.normalised(F.col("f"), [0.0, 0.0, 1.0]), f=[0.0, 0.0, 2.0]) == [0.0, 0.0, 1.0]


def test_vote_vectors_and_majority(spark):
    rows = [(0, "tokyo", 0.5), (0, "paris", 1.0), (0, "tokyo", 2.0), (1, "paris", 0.0), (1, "paris", 1.0), (1, None, 0.0), (2, None, None)]
    df = spark.createDataFrame(rows, "id long, label string, w double")
    got = {r.id: r.votes for r in L.vote_vectors(df, ["tokyo", "paris", "new york"], weight="w").collect()}
    assert got == {0: [0.0, 1.0, 2.5], 1: [0.0, 1.0, 0.0], 2: [0.0, 0.0, 0.0]}
    assert {r.id: r.label for r in L.majority_vote(df, ["tokyo", "paris"], weight="w").collect()} == {0: "tokyo", 1: "paris", 2: None}


def test_confusion(spark):
    df = spark.createDataFrame([(t, t, 0) for t in (4, 7, 8)] + [(t, None, 1) for t in (4, 7, 8)], "truth int, label int, annotator int")
    for how in ("true", "pred"):
        got = {(r.annotator, r.truth, r.pred): r.value for r in L.confusion(df, [4, 7, 8], normalize=how).collect()}
        assert all(got[0, a, b] == float(a == b) and got[1, a, b] == pytest.approx(1 / 3) for a in (4, 7, 8) for b in (4, 7, 8))


def test_labels(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "id long, y double")
    assert [r.id for r in L.labeled_indices(df, "y", "id").collect()] == [1]
    assert sorted(r.id for r in L.unlabeled_indices(df, "y", "id").collect()) == [2, 3]
    enc = L.LabelEncoder(["b", "a"])
    s = spark.createDataFrame([("a",), ("b",), (None,)], "y string")
    assert [r.c for r in s.select(enc.transform("y").alias("c")).collect()] == [0, 1, None]
    with pytest.raises(Exception, match="unknown class"):
        spark.createDataFrame([("z",)], "y string").select(enc.transform("y").alias("c")).collect()


def utilities(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id long, utility double")


def test_batches(spark):
    df = utilities(spark, [4.0, 2.0, 5.0, 3.0, 1.0, 0.0])
    steps = S.simple_batch(df, 7).collect()
    assert [r.id for r in sorted((r for r in steps if r.picked), key=lambda r: r.step)] == [2, 0, 3, 1, 4, 5]
    assert sum(r.utility is None for r in steps) == 0 + 1 + 2 + 3 + 4 + 5
    assert S.top_k(utilities(spark, [None, None]), 2).collect() == []
    assert S.rand_argmax(utilities(spark, [2.0, 5.0, 6.0, -1.0])).first().id == 2
    assert S.rand_argmax(utilities(spark, [2.0, 5.0, 6.0, -1.0]), least=True).first().id == 3
    assert S.rand_argmax(utilities(spark, [None, 1.0])).first().id == 1


@SLOW
@given(values=st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float)), min_size=1, max_size=12), k=st.integers(1, 15))
def test_top_k_is_sorted_and_clamped(spark, values, k):
    got = S.top_k(utilities(spark, values), k).orderBy("step").collect()
    known = sorted((-v, i) for i, v in enumerate(values) if v is not None)
    assert [(r.step, r.id) for r in got] == [(n, i) for n, (_, i) in enumerate(known[:k], 1)]


def test_combine_ranking(spark):
    df = spark.createDataFrame([(0, 0.0, 0.1), (1, 1.0, 0.2), (2, 1.0, 0.4), (3, None, 1.0)], "id long, r1 double, r2 double")
    for method in ("dense", "ordinal"):
        c = {r.id: r["rank"] for r in S.combine_ranking(df, "r1", "r2", method=method).collect()}
        assert c[1] > c[0] and c[2] > c[1] and c[3] is None
    df = spark.createDataFrame([(0, 0.1, 14.0), (1, 0.1, 13.0), (2, 0.2, 12.0)], "id long, r1 double, r2 double")
    c = {r.id: r["rank"] for r in S.combine_ranking(df, "r1", "r2").collect()}
    assert c[2] > c[0] > c[1]


def test_proportional_draws(spark):
    df = spark.range(4).select("id", F.col("id").cast("double").alias("utility"))
    first = [S.proportional(df, 1, seed=s).first().id for s in range(60)]
    assert first.count(0) == 0 and first.count(3) > first.count(1)
    assert sorted(r.id for r in S.proportional(df, 9, seed=1).collect()) == [0, 1, 2, 3]


def test_random_numbers(spark):
    df = spark.range(20000).select(uniform(1, "id").alias("u"), normal(1, "id").alias("n"))
    r = df.agg(F.avg("u"), F.stddev("u"), F.avg("n"), F.stddev("n")).first()
    assert list(r) == pytest.approx([0.5, math.sqrt(1 / 12), 0, 1], abs=0.03)
    assert df.repartition(7).agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])


def test_validation():
    with pytest.raises(TypeError):
        V.check_scalar("a", "a", int)
    with pytest.raises(ValueError, match="small"):
        V.check_scalar(0, "a", int, 1)
    with pytest.raises(ValueError, match="repeat"):
        V.check_classes([1, 1])
    with pytest.raises(ValueError, match="prior"):
        V.check_class_prior([-1.0, 1.0], 2)
    assert V.check_cost_matrix(None, 2) == [[0.0, 1.0], [1.0, 0.0]]
    with pytest.warns(UserWarning):
        V.check_cost_matrix([[1, 0], [0, 1]], 2)
    with pytest.warns(UserWarning):
        assert V.check_batch_size(9, 3) == 3
    with pytest.raises(ValueError, match="corners"):
        V.check_bound([[1, 1], [0, 0]])
    assert V.call_with(lambda a: a, a=1, b=2) == 1
    assert V.derived_seed(3, 4) == 15


def test_kernels_and_distances(spark):
    a, b = np.array([1.0, 2.0]), np.array([3.0, -1.0])
    for name, want in {"rbf": math.exp(-0.5 * 13), "laplacian": math.exp(-0.5 * 5), "linear": 1.0, "poly": 1.5**3, "sigmoid": math.tanh(1.5), "cosine": 1 / math.sqrt(5 * 10)}.items():
        assert one(spark, E.kernel(name, 0.5)(F.col("a"), F.col("b")), a=a.tolist(), b=b.tolist()) == pytest.approx(want)
    assert one(spark, E.kl(F.col("a"), F.col("b")), a=[0.5, 0.5], b=[0.25, 0.75]) == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(2 / 3))
    assert one(spark, E.softmax(F.col("a")), a=[0.0, math.log(3)]) == pytest.approx([0.25, 0.75])
    assert one(spark, E.outer(F.col("a"), F.col("b")), a=[1.0, 2.0], b=[3.0, 4.0]) == [3.0, 4.0, 6.0, 8.0]
