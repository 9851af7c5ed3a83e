import numpy as np
import pytest

from lodestar.streaming import managers as B
from lodestar.streaming import strategies as T

U = [*np.random.RandomState(0).rand(50).tolist(), *[None] * 50]


def picks(strategy, items=U):
    state = strategy.initial()
    return [i for i, u in enumerate(items) if strategy.step(state, u)]


def test_managers_by_hand():
    assert picks(B.FixedUncertaintyManager()) == [0, 1, 2, 3, 5, 7, 8, 10, 11, 12, 13, 18, 27, 37]
    assert picks(B.VariableUncertaintyManager()) == [*range(11), 17, 26, 35, 45]
    assert picks(B.BalancedQuantileManager()) == [0, 1, 7, 8, 20]
    assert picks(B.PeriodicManager(), [0.5] * 40) == [9, 19, 29, 39]


@pytest.mark.parametrize("m", [B.RandomVariableUncertaintyManager(), B.SplitManager(), B.RandomBudgetManager(), B.DensityBasedSplitManager(), B.BalancedQuantileManager()])
def test_budget_is_kept_and_nulls_are_never_queried(m):
    items = [None if i % 7 == 0 else float(u) for i, u in enumerate(np.random.RandomState(1).rand(3000))]
    got = picks(m, items)
    assert all(items[i] is not None for i in got)
    assert 0 < len(got) / len(items) <= 0.1 * 1.5
    assert got == picks(m, items)


def test_split_without_chance_is_variable():
    assert picks(B.SplitManager(v=0.0)) == picks(B.VariableUncertaintyManager())


def test_budget_is_checked():
    with pytest.raises(ValueError, match="budget"):
        B.FixedUncertaintyManager(budget=0)


def test_density_strategies():
    rng = np.random.RandomState(2)
    xs, us = rng.randn(200, 2).tolist(), rng.rand(200).tolist()
    for s in (B.DensityStrategy(), B.cognitive("Ran"), B.cognitive("FixUn"), B.cognitive("VarUn"), B.cognitive("RanVarUn")):
        state = s.initial()
        got = [s.step(state, u, x) for u, x in zip(us, xs, strict=True)]
        assert not got[0] and 0 <= sum(got) <= 60
        assert len(state["x"]) <= s.window + 1


def events(spark):
    rng = np.random.RandomState(3)
    rows = [(k % 3, k, float(u)) for k, u in enumerate(rng.rand(120))]
    return rows, spark.createDataFrame(rows, "key long, t long, utility double")


@pytest.mark.parametrize("m", [B.VariableUncertaintyManager(), B.BalancedQuantileManager(), B.SplitManager()])
def test_fold_equals_the_loop(spark, m):
    rows, df = events(spark)
    got = {r.t for r in T.fold(df.repartition(5), m, "key", ["t"]).collect() if r.queried}
    want = {own[i][1] for k in range(3) for own in [[r for r in rows if r[0] == k]] for i in picks(m, [r[2] for r in own])}
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    _, df = events(spark)
    m = B.VariableUncertaintyManager()
    df.repartitionByRange(3, "t").write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = T.streamed(rows, m, "key", ["t"]).writeStream.format("memory").queryName("queried").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.t, r.queried) for r in spark.sql("select * from queried").collect()}
    assert got == {(r.t, r.queried) for r in T.fold(df, m, "key", ["t"]).collect()}
