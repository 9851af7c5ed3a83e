import math

import pytest
from pyspark.sql import functions as F

from lodestar.functions import labels as L
from lodestar.functions.validation import MappingError
from lodestar.operators import api
from lodestar.operators import classifiers as C
from lodestar.operators import diverse as D
from lodestar.operators import informative as I
from lodestar.operators import regressors as R
from lodestar.sources import tables


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(i, [float(i % 6), float(i // 6)], int(i % 2) if i < 6 else None, 1.0) for i in range(24)]
    return spark.createDataFrame(rows, "id long, x array<double>, y int, w double").cache()


PARAMS = {
    "prob_cover": {"delta": 1.1}, "four_ds": {"components": 2}, "uncertainty": {"method": "entropy"}, "sub_sampled": {"max_candidates": 10}, "cost_embedding": {"cost": [[0, 1], [1, 0]]},
    "dual": {"delta": 0.1, "gain": 0.05}, "epistemic_logistic": {"levels": 10}, "variance_reduction": {"method": "quantile", "n": 3}, "output_change": {"loss": lambda a, b: abs(a - b)}, "information_gain": {"normal": False, "n": 2, "nodes": 8},
}
CLUB = [C.ParzenWindow([0, 1], gamma=g) for g in (0.2, 0.5, 2.0)]
ASKED = dict.fromkeys(("committee_kl", "committee_votes", "committee_variation", "bald", "batch_bald"), CLUB)
ASKED |= dict.fromkeys(("model_change", "output_change", "variance_reduction", "information_gain", "greedy_y", "greedy_xy"), R.NormalInverseChi(gamma=0.5))
ASKED["committee_std"] = [R.NormalInverseChi(gamma=g) for g in (0.2, 1.0)]


@pytest.mark.parametrize("name", [*api.SCORED, *api.STEPPED])
def test_every_strategy_gives_a_batch(pool, name):
    s = api.Strategy(name, ASKED.get(name, C.ParzenWindow([0, 1], gamma=0.5)), seed=1, params=PARAMS.get(name, {}))
    got = s.query(pool, batch_size=2).orderBy("step").collect()
    assert [r.step for r in got] == [1, 2] and len({r.id for r in got}) == 2 and all(r.id >= 6 for r in got)
    assert got == s.query(pool, batch_size=2).orderBy("step").collect()


def test_candidates_by_null_ids_or_rows_agree(spark, pool):
    s = api.Strategy("uncertainty", C.ParzenWindow([0, 1], gamma=0.5), params={"method": "entropy"})
    key = lambda df: {r.id: round(r.utility, 9) for r in df.collect()}
    a = key(s.utilities(pool))
    assert a == key(s.utilities(pool, list(range(6, 24)))) == key(s.utilities(pool, pool.filter("y is null").select("id", "x")))
    assert s.query(pool, [7, 9], batch_size=5).count() == 2
    with pytest.raises(MappingError):
        api.Strategy("quire", s.classifier).query(pool, pool.select("id", "x"))


def test_cycles_from_no_label(spark, pool):
    clf, now = C.ParzenWindow([0, 1], gamma=0.5), pool.withColumn("y", F.lit(None).cast("int"))
    for n in range(3):
        got = api.Strategy("uncertainty", clf, params={"method": "entropy"}).query(now).collect()
        answers = spark.createDataFrame([(r.id, int(r.id % 2)) for r in got], "id long, y int")
        now = tables.update_labels(now, answers).select("id", "x", "y", "w")
        assert now.filter("y is not null").count() == n + 1


def test_small_helpers(spark, pool):
    with pytest.raises(TypeError):
        L.check_missing_label("x", "int")
    with pytest.raises(ValueError, match="differ"):
        L.check_equal_missing_label(None, "nan")
    L.check_equal_missing_label(float("nan"), float("nan"))
    f = spark.createDataFrame([(1, [3.0, 2.0]), (2, [0.0, 0.0]), (3, [2.5, 1.0])], "id long, freq array<double>")
    exact, table = ({r.id: r.utility for r in I.epistemic_pwc(f, table=t).collect()} for t in (None, 10))
    assert exact[2] == 1.0 and table[1] == pytest.approx(exact[1]) and table[3] == pytest.approx(exact[3], abs=0.05)
    rows = spark.createDataFrame([(1, 1e7, 0.0, 2.0)], "id long, nu double, loc double, scale double")
    assert R.t_entropy(rows).first().entropy == pytest.approx(0.5 * math.log(2 * math.pi * math.e * 4), abs=1e-4)
    assert R.sampled_targets(rows, 4, 1).count() == 4
    rows = rows.withColumn("nu", F.lit(9.0))
    for m in ("trapezoid", "simpson"):
        assert R.expectation(rows, lambda y: y + 1, m, n=21).first().e == pytest.approx(1.0, abs=1e-6)
    lab = pool.filter("y is not null").withColumn("y", F.col("y").cast("double"))
    cand = pool.filter("y is null").withColumn("pred", F.col("id") / 10)
    assert D.greedy_target(cand, lab.filter("false"), k=3, n_gsx=2).count() == 3
    p = C.annotator_performance(spark.createDataFrame([(1, [0.25, 0.75])], "id long, p array<double>"), __import__("numpy").array([[[1, 0], [0.5, 0.5]]]))
    assert p.first().perf == pytest.approx(0.25 + 0.375)
    assert tables.blobs(spark, 30).select(F.count(F.lit(1)), F.countDistinct("y")).first()[:] == (30, 3)
    both = C.mixture_probas(pool.filter("y is null").select("id", "x"), pool, [0, 1], 2, 1, weight_mode="similarities").collect()
    assert all(sum(r.p) == pytest.approx(1) for r in both)
