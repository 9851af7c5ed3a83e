"""Classifiers that are fitted again and again on subsets of the same rows, inside a task.

A ``fit`` function takes features, class codes (0, 1, ...) and weights and returns
a function from features to class probabilities; ``softmax`` and ``gaussian`` are
two, and any library's classifier can be wrapped as one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import pairs
from lodestar.operators.pairs import Side, fetched

Model = Callable[[np.ndarray], np.ndarray]
Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], Model]


def softmax(n_classes: int, ridge: float = 1.0, steps: int = 25) -> Fit:
    """Multinomial logistic regression with an intercept, by Newton steps on the penalised likelihood."""

    def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Model:
        a = np.hstack([x, np.ones((len(x), 1))])
        beta = np.zeros((a.shape[1], n_classes))
        hot = np.eye(n_classes)[y]

        def probas(z: np.ndarray) -> np.ndarray:
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        for _ in range(steps):
            p = probas(a @ beta)
            grad = a.T @ (w[:, None] * (hot - p)) - ridge * beta
            blocks = [[(a * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a for j in range(n_classes)] for i in range(n_classes)]
            hess = np.block(blocks) + ridge * np.eye(beta.size)
            move = np.linalg.solve(hess, grad.T.ravel()).reshape(n_classes, -1).T
            beta = beta + move
            if np.abs(move).max() < 1e-10:
                break
        return lambda v: probas(np.hstack([v, np.ones((len(v), 1))]) @ beta)

    return fit


def gaussian(n_classes: int, floor: float = 1e-9) -> Fit:
    """Naive Bayes with a normal distribution for each feature and class."""

    def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Model:
        hot = np.eye(n_classes)[y] * w[:, None]
        mass = hot.sum(axis=0)
        safe = np.where(mass > 0, mass, 1.0)[:, None]
        mean = hot.T @ x / safe
        var = hot.T @ (x * x) / safe - mean**2
        var = np.maximum(var, 0) + floor * max(1.0, float(x.var(axis=0).max())) if len(x) else var + floor
        var = np.where(mass[:, None] > 0, var, 1.0)  # a class without rows is left out below
        prior = np.log(np.maximum(mass, 1e-300) / mass.sum())

        def probas(v: np.ndarray) -> np.ndarray:
            z = prior - 0.5 * (((v[:, None, :] - mean) ** 2 / var) + np.log(2 * np.pi * var)).sum(axis=2)
            z = np.where(mass > 0, z, -np.inf)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return probas

    return fit


class IndexClassifier:
    """A classifier over rows known by their places: fitted on some, then on some more or with other labels.

    ``partial_fit`` always starts from what ``fit`` was given, so that trials do
    not build on each other; ``keep=True`` makes the new rows the base. With
    ``unique`` a place holds one label, the latest. Without any label the classes
    are equally likely; with labels of one class only that class is certain.
    """

    def __init__(self, fit: Fit, x: np.ndarray, y: np.ndarray, w: np.ndarray | None, n_classes: int, unique: bool = True):
        self.make, self.x, self.y, self.n, self.unique = fit, x, np.asarray(y, dtype=np.int64), n_classes, unique
        self.w = np.ones(len(x)) if w is None else np.asarray(w, dtype=float)
        self.base: list[tuple[int, int, float]] = []
        self.model: Model | None = None

    def rows(self, at: Sequence[int], y: Sequence[int] | None, w: Sequence[float] | None) -> list[tuple[int, int, float]]:
        labels = self.y[list(at)] if y is None else np.asarray(y, dtype=np.int64)
        weights = self.w[list(at)] if w is None else np.asarray(w, dtype=float)
        return [(int(i), int(c), float(v)) for i, c, v in zip(at, labels, weights, strict=True) if c >= 0]

    def fitted(self, rows: list[tuple[int, int, float]]) -> None:
        if self.unique:
            rows = list({i: (i, c, v) for i, c, v in rows}.values())
        held = {c for _, c, _ in rows}
        if len(held) < 2:
            share = np.eye(self.n)[held.pop()] if held else np.full(self.n, 1 / self.n)
            self.model = lambda v: np.tile(share, (len(v), 1))
        else:
            i, c, v = zip(*rows, strict=True)
            self.model = self.make(self.x[list(i)], np.array(c), np.array(v))

    def fit(self, at: Sequence[int], y: Sequence[int] | None = None, w: Sequence[float] | None = None) -> IndexClassifier:
        self.base = self.rows(at, y, w)
        self.fitted(self.base)
        return self

    def partial_fit(self, at: Sequence[int], y: Sequence[int] | None = None, w: Sequence[float] | None = None, keep: bool = False) -> IndexClassifier:
        rows = self.base + self.rows(at, y, w)
        if keep:
            self.base = rows
        self.fitted(rows)
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        if self.model is None:
            raise ValueError("not fitted yet")
        return self.model(x)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.predict_proba(x), 12).argmax(axis=1)


def sides(lab: DataFrame, evaluation: DataFrame, classes: list) -> tuple[Side, Side]:
    """The labelled rows (x, c, w) and the evaluation rows (id, x, w and what else they have), each within SHIP_BYTES."""
    code = F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1
    out = []
    for df in (lab.filter("y is not null").select("id", "x", code.cast("int").alias("c"), F.coalesce("w", F.lit(1.0)).alias("w")), evaluation.withColumn("w", F.coalesce("w", F.lit(1.0))).select("id", *(c for c in evaluation.columns if c in ("x", "w", "t")))):
        n, width = df.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
        if n * ((width or 0) + 2) * 8 > pairs.SHIP_BYTES:
            raise ValueError("refitting takes sides that each task can hold")
        side = fetched(df)
        out.append(side if n else {"id": np.zeros(0, dtype=np.int64), "x": np.zeros((0, width or 1)), "c": np.zeros(0, dtype=np.int64), "w": np.zeros(0), "t": np.zeros(0)})
    return out[0], out[1]


class LocalClassifier:
    """A ``fit`` function as a classifier of rows, fitted on the labelled rows once and shipped."""

    def __init__(self, fit: Fit, classes: Sequence):
        self.fit, self.classes = fit, sorted(classes)

    def probas(self, rows: DataFrame, pool: DataFrame, out: str = "p") -> DataFrame:
        import pyarrow as pa

        train = sides(pool, pool.limit(0), self.classes)[0]
        model = IndexClassifier(self.fit, train["x"], train["c"], train["w"], len(self.classes)).fit(range(len(train["x"])))

        def run(batches):
            for b in batches:
                x = pairs.as_arrays(b.select(["x"]))["x"]
                p = model.predict_proba(x) if b.num_rows else np.zeros((0, len(self.classes)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p.tolist(), pa.list_(pa.float64()))], names=[*b.schema.names, out])

        return rows.mapInArrow(run, rows.withColumn(out, F.lit(None).cast("array<double>")).schema)

    def predict(self, probas: DataFrame, p: str = "p", out: str = "pred") -> DataFrame:
        from lodestar.operators.classifiers import decision

        return probas.withColumn(out, decision(F.col(p), self.classes))
