"""Stream strategies over rows in order, key by key: as a batch fold and as Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.functions.selection import DIGITS
from lodestar.operators.classifiers import ParzenWindow
from lodestar.operators.informative import cost_reduction
from lodestar.streaming.managers import BalancedQuantileManager, BudgetManager, CognitiveStrategy, DensityStrategy, check_budget_manager

Strategy = BudgetManager | DensityStrategy | CognitiveStrategy


def _step(strategy: Strategy, state: dict, utility: float | None, x: list[float] | None) -> bool:
    return strategy.step(state, utility) if isinstance(strategy, BudgetManager) else strategy.step(state, utility, x)


def fold(rows: DataFrame, strategy: Strategy, key: str, order: list[str], utility: str = "utility", x: str | None = None) -> DataFrame:
    """``rows`` with ``queried``, decided one by one in order within each key.

    One shuffle by key and a sort; then every partition is streamed through with
    one key's state at a time, so a long stream is never held. Rows of one key
    depend on each other and so go through one task.
    """
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)
    names = rows.columns
    k, u, f = names.index(key), names.index(utility), names.index(x) if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), {}
        for b in batches:
            out = []
            features = b.column(f).to_pylist() if f is not None else [None] * b.num_rows
            for i, v, z in zip(b.column(k).to_pylist(), b.column(u).to_pylist(), features, strict=True):
                if i != now:
                    now, state = i, strategy.initial()
                out.append(_step(strategy, state, v, z))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*names, "queried"])

    return dealt.mapInArrow(run, rows.withColumn("queried", F.lit(None).cast("boolean")).schema)


class Processor(StatefulProcessor):
    """The same steps with the state kept by the stream's state store; rows of a micro-batch are put in order first."""

    def __init__(self, strategy: Strategy, key: str, order: list[str], utility: str, x: str | None):
        self.strategy, self.key, self.order, self.utility, self.x = strategy, key, order, utility, x

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.strategy.initial()
        got = pd.concat(list(rows)).sort_values(self.order)
        features = got[self.x] if self.x else [None] * len(got)
        got["queried"] = [_step(self.strategy, state, None if pd.isna(u) else float(u), None if z is None else list(z)) for u, z in zip(got[self.utility], features, strict=True)]
        self.state.update((json.dumps(state),))
        yield got

    def close(self) -> None:
        pass


def streamed(rows: DataFrame, strategy: Strategy, key: str, order: list[str], utility: str = "utility", x: str | None = None) -> DataFrame:
    """The streaming ``rows`` with ``queried``; needs the RocksDB state store."""
    schema = rows.withColumn("queried", F.lit(None).cast("boolean")).schema
    return rows.groupBy(key).transformWithStateInPandas(Processor(strategy, key, order, utility, x), schema, "append", "none")


def probabilistic(rows: DataFrame, lab: DataFrame, clf: ParzenWindow, key: str, order: list[str], manager: BudgetManager | None = None, budget: float | None = None, m_max: int = 2, prior: float = 1e-3, weight: str | None = None, kernel: ParzenWindow | None = None, id_col: str = "id") -> DataFrame:
    """``rows`` (id, x, ...) with ``utility`` and ``queried``: the expected gain of a label, filtered by a balanced quantile.

    The gain is that of probabilistic active learning, from the classifier's
    frequencies; with ``kernel`` from its probabilities times the summed
    frequencies of another kernel classifier. ``weight`` is a column of densities.
    """
    use = check_budget_manager(budget, manager, BalancedQuantileManager)
    plain = rows.select(F.col(id_col).alias("id"), "x", *([weight] if weight else []))
    if kernel is None:
        freq = clf.freq(plain, lab)
    else:
        both = kernel.freq(clf.probas(plain, lab), lab, "_n")
        total = F.aggregate("_n", F.lit(0.0), lambda s, v: s + v)
        freq = both.withColumn("freq", F.transform("p", lambda p: p * total))
    gain = cost_reduction(freq, m_max, prior, weight=weight).select(F.col("id").alias(id_col), F.round("utility", DIGITS).alias("utility"))
    return fold(rows.drop("utility").join(gain, id_col), use, key, order)


def random_filter(rows: DataFrame, budget: float, seed: int, *keys: str) -> DataFrame:
    """Random sampling that may exceed its budget needs no state: a filter on a hash."""
    from lodestar.functions.rng import uniform

    return rows.withColumn("queried", uniform(seed, *keys) >= 1 - budget)


def pool_on_batches(rows: DataFrame, batch_size: int, order: list[str], per_batch: int = 1, key: str = "key", utility: str = "utility") -> DataFrame:
    """``rows`` with ``queried``: the best ``per_batch`` of each batch of consecutive rows of a key."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    dealt = rows.withColumn("_b", F.floor(place / batch_size))
    best = F.row_number().over(Window.partitionBy(key, "_b").orderBy(F.desc_nulls_last(utility), *order))
    return dealt.withColumn("queried", (best <= per_batch) & F.col(utility).isNotNull()).drop("_b")
