"""Classifiers over pools: rows (id, x, y, w) with a null y where a label is missing."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import exprs as E
from lodestar.operators.pairs import Side, against, as_arrays, kernels


def mean_gamma(pool: DataFrame, compat: bool = False) -> float:
    """The mean bandwidth: from the features' variances and the number of labelled rows (with ``compat``: of rows whose code is not 1)."""
    dim = pool.select(F.max(F.size("x"))).first()[0] or 1
    used = F.sum((F.coalesce(F.col("y"), F.lit(-1)) != 1).cast("int")) if compat else F.count("y")
    row = pool.agg(used.alias("n"), *(F.var_pop(F.col("x")[k]).alias(f"v{k}") for k in range(dim))).first()
    n, var = max(2, row.n), sum(row[f"v{k}"] or 0 for k in range(dim))
    return gamma_of(n, var, dim)


def gamma_of(n: int, variance: float, dim: int) -> float:
    delta = math.sqrt(2) * 1e-6
    return 0.5 * (n - 1) * math.log((n - 1) / delta**2) / (2 * n * variance) if variance > 0 else 1.0 / dim


class ParzenWindow:
    """Class frequencies as kernel sums over labelled rows.

    With ``n_neighbors`` only the largest kernels of a row count, and unlabelled
    rows take up neighbours' places. ``metric`` is a kernel's name, a function of
    two matrices, or ``precomputed``: then a row's x holds its kernel with every
    pool row, in the order of the ids of the pool, whose rows have a ``place`` in it.
    """

    def __init__(self, classes: Sequence, metric: str | Callable[[np.ndarray, np.ndarray], np.ndarray] = "rbf", gamma: float | None = None, n_neighbors: int | None = None, class_prior: float | list[float] = 0.0, cost: list[list[float]] | None = None):
        self.classes, self.metric, self.gamma, self.n_neighbors = sorted(classes), metric, gamma, n_neighbors
        self.class_prior, self.cost = class_prior, cost

    def votes(self, pool: DataFrame) -> DataFrame:
        """Rows (id, x, v): each row's weight by class; several rows of an id add up."""
        v = F.array(*(F.when(F.col("y") == F.lit(c), F.coalesce(F.col("w"), F.lit(0.0))).otherwise(0.0) for c in self.classes))
        rows = pool if self.n_neighbors else pool.filter(F.col("y").isNotNull())
        return rows.select("id", F.array(F.col("place").cast("double")).alias("x") if self.metric == "precomputed" else "x", v.alias("v"))

    def pair_kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.metric == "precomputed":
            return a[:, b[:, 0].astype(np.int64)]
        return kernels(a, b, self.metric, self.gamma) if isinstance(self.metric, str) else self.metric(a, b)

    def freq(self, rows: DataFrame, pool: DataFrame, out: str = "freq") -> DataFrame:
        """``rows`` (id, x, ...) with their class frequencies."""
        k = self.n_neighbors

        def f(a: Side, b: Side) -> np.ndarray:
            return self.pair_kernel(a["x"], b["x"]) @ b["v"]

        votes = self.votes(pool)
        if k is not None:
            return nearest_sums(rows, votes, self.pair_kernel, k, len(self.classes), out)
        return against(rows, votes, f, "sum", out, [0.0] * len(self.classes))

    def probas(self, rows: DataFrame, pool: DataFrame, out: str = "p") -> DataFrame:
        return self.freq(rows, pool, "_f").withColumn(out, E.normalised(F.col("_f"), self.class_prior)).drop("_f")

    def predict(self, probas: DataFrame, p: str = "p", out: str = "pred") -> DataFrame:
        return probas.withColumn(out, decision(F.col(p), self.classes, self.cost))


def nearest_sums(rows: DataFrame, votes: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], k: int, n_classes: int, out: str) -> DataFrame:
    """Sums over the k largest kernels of each row: lines of k times (kernel, votes), merged over blocks."""

    def f(a: Side, b: Side) -> np.ndarray:
        m = kernel(a["x"], b["x"])
        n = min(k, m.shape[1])
        at = np.argsort(-m, axis=1, kind="stable")[:, :n]
        lines = np.full((len(m), k, 1 + n_classes), 0.0)
        lines[:, :, 0] = -np.inf
        lines[:, :n, 0] = np.take_along_axis(m, at, axis=1)
        lines[:, :n, 1:] = b["v"][at]
        return lines.reshape(len(m), -1)

    got = against(rows, votes, f, "concat", "_l")
    width = 1 + n_classes
    cells = F.transform(F.sequence(F.lit(0), F.floor(F.size("_l") / width).cast("int") - 1), lambda j: F.slice("_l", j * width + 1, width))
    best = F.slice(F.sort_array(F.filter(cells, lambda c: c[0] > float("-inf")), False), 1, k)
    sums = F.aggregate(best, F.array(*[F.lit(0.0)] * n_classes), lambda s, c: F.zip_with(s, F.slice(c, 2, n_classes), lambda x, y: x + c[0] * y))
    return got.withColumn(out, F.coalesce(sums, F.array(*[F.lit(0.0)] * n_classes))).drop("_l")


def decision(p: Column, classes: Sequence, cost: list[list[float]] | None = None) -> Column:
    """The class of least expected cost; the first of equals."""
    place = E.argmax(F.transform(p, lambda v: F.round(v, 12))) if cost is None else E.argmin(F.transform(E.expected_costs(p, cost), lambda v: F.round(v, 12)))
    return F.element_at(F.array(*map(F.lit, classes)), place + 1)


def score(df: DataFrame, truth: str = "y", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """One row (accuracy), weighted if there is a weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    hit = F.when(F.col(truth) == F.col(pred), w).otherwise(0.0)
    return df.filter(F.col(truth).isNotNull()).agg((F.sum(hit) / F.sum(w)).alias("accuracy"))


def sampled_probas(df: DataFrame, freq: str, n_samples: int, seed: int = 0, prior: float = 1.0, id_col: str = "id") -> DataFrame:
    """Rows (id, sample, p): class probabilities drawn from the Dirichlet distribution of frequencies plus prior."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ids, f = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = [(i, s, np.random.default_rng([seed, i & (1 << 63) - 1, s]).dirichlet(np.array(v) + prior).tolist()) for i, v in zip(ids, f, strict=True) for s in range(n_samples)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["id", "sample", "p"])

    return df.select(F.col(id_col).cast("long"), freq).mapInArrow(run, "id long, sample int, p array<double>")


def sliding_window(rows: DataFrame, order: list[str], window: int, only_labeled: bool = False) -> DataFrame:
    """The last ``window`` rows in order, of those with a label if asked: what a sliding-window classifier is fitted on."""
    if only_labeled:
        rows = rows.filter(F.col("y").isNotNull())
    return rows.orderBy(*(F.desc(c) for c in order)).limit(window)


class SparkMLClassifier:
    """Any ``pyspark.ml`` classifier, fitted on the labelled rows by their weights.

    Where it cannot be fitted, as with labels of one class only, every row gets
    the classes' shares of the labels' weight, equal shares without any label;
    an error of the estimator itself is passed on.
    """

    def __init__(self, estimator, classes: Sequence):
        self.estimator, self.classes = estimator, sorted(classes)

    def probas(self, rows: DataFrame, pool: DataFrame, out: str = "p") -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        lab = pool.filter(F.col("y").isNotNull())
        weight = F.coalesce(F.col("w"), F.lit(1.0)) if "w" in lab.columns else F.lit(1.0)
        mass = {r[0]: float(r[1]) for r in lab.groupBy("y").agg(F.sum(weight)).collect()}  # one row a class
        known, n = sorted(mass), len(self.classes)
        if len(known) > 1:
            code = (F.array_position(F.array(*map(F.lit, known)), F.col("y")) - 1).cast("double")
            train = lab.select(array_to_vector("x").alias("features"), code.alias("label"), weight.alias("weight"))
            est = self.estimator.copy()
            if est.hasParam("weightCol"):
                est.setParams(weightCol="weight")
            fitted = est.fit(train)
            p = vector_to_array("probability")
            cols = [p[known.index(c)] if c in known else F.lit(0.0) for c in self.classes]
            scored = fitted.transform(rows.withColumn("features", array_to_vector("x")))
            return scored.withColumn(out, F.array(*cols)).drop("features", "rawPrediction", "probability", "prediction")
        total = sum(mass.values())
        share = [mass.get(c, 0.0) / total for c in self.classes] if total > 0 else [1.0 / n] * n
        return rows.withColumn(out, F.array(*map(F.lit, share)))

    def predict(self, probas: DataFrame, p: str = "p", out: str = "pred") -> DataFrame:
        return probas.withColumn(out, decision(F.col(p), self.classes))


def mixture_responsibilities(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``rows`` with responsibilities ``r`` of k Gaussian components fitted on all of them, and their log density."""
    import pyarrow as pa
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    model = GaussianMixture(k=k, seed=seed, maxIter=30).fit(rows.select(array_to_vector("x").alias("features")))
    comps = []  # as many numbers as there are features squared
    for w, g in zip(model.weights, model.gaussians, strict=True):
        mean = np.array(g.mean)
        cov = np.array(g.cov.toArray()).reshape(len(mean), -1)
        comps.append((math.log(max(w, 1e-300)) - 0.5 * (np.linalg.slogdet(cov + 1e-12 * np.eye(len(mean)))[1] + len(mean) * math.log(2 * math.pi)), mean, np.linalg.pinv(cov)))
    at = rows.columns.index("x")

    def run(batches):
        for b in batches:
            x = as_arrays(b.select([at]))["x"]
            logs = np.stack([c - 0.5 * np.einsum("ni,ij,nj->n", x - m, inv, x - m, optimize=True) for c, m, inv in comps], axis=1) if b.num_rows else np.zeros((0, k))
            top = logs.max(axis=1, initial=-np.inf)
            density = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
            r = np.exp(logs - density[:, None])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r.tolist(), pa.list_(pa.float64())), pa.array(density)], names=[*b.schema.names, "r", "density"])

    return rows.mapInArrow(run, rows.withColumn("r", F.lit(None).cast("array<double>")).withColumn("density", F.lit(None).cast("double")).schema)


def mixture_probas(rows: DataFrame, pool: DataFrame, classes: Sequence, k: int, seed: int = 0, out: str = "p", weight_mode: str = "responsibilities") -> DataFrame:
    """Class probabilities through mixture components: each gives the classes the weight of its labelled rows.

    weight_mode ``similarities`` weighs a row's components by the closeness to
    their means instead of their responsibilities.
    """
    known = sorted(classes)
    every = mixture_responsibilities(pool, k, seed)
    lab = every.filter(F.col("y").isNotNull())
    sums = lab.agg(*(F.coalesce(F.sum(F.when(F.col("y") == c, F.col("r")[j] * F.col("w"))), F.lit(0.0)).alias(f"s{j}_{i}") for j in range(k) for i, c in enumerate(known))).first()
    r = every.select("id", "r")
    if weight_mode == "similarities":
        dim = pool.select(F.max(F.size("x"))).first()[0]
        means = every.agg(*((F.sum(F.col("r")[j] * F.col("x")[d]) / F.sum(F.col("r")[j])).alias(f"m{j}_{d}") for j in range(k) for d in range(dim))).first()
        near = [F.exp(-0.5 * sum(((F.col("x")[d] - float(means[f"m{j}_{d}"])) ** 2 for d in range(1, dim)), (F.col("x")[0] - float(means[f"m{j}_0"])) ** 2)) for j in range(k)]
        r = every.select("id", F.array(*near).alias("r"))
    f = F.array(*(sum((F.col("r")[j] * float(sums[f"s{j}_{i}"]) for j in range(1, k)), F.col("r")[0] * float(sums[f"s0_{i}"])) for i in range(len(known))))
    return rows.join(r, "id").withColumn(out, E.normalised(f)).drop("r")


def annotator_ensemble(probas: DataFrame, n_classes: int, voting: str = "hard") -> DataFrame:
    """Rows (id, p) from rows (id, annotator, p) of one classifier for each annotator: shares of votes, or normalised sums."""
    if voting == "hard":
        place = E.argmax(F.transform(F.col("p"), lambda v: F.round(v, 12)))
        sums = [F.sum((place == k).cast("double")) for k in range(n_classes)]
    else:
        sums = [F.sum(F.col("p")[k]) for k in range(n_classes)]
    return probas.groupBy("id").agg(F.array(*sums).alias("s")).select("id", E.normalised(F.col("s")).alias("p"))


def annotator_logistic(labels: DataFrame, features: DataFrame, classes: Sequence, n_iter: int = 20, prior_full: float = 1.0, prior_diag: float = 0.0, weights_prior: float = 1.0, tol: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a softmax regression and the annotators' confusion matrices by expectation maximisation.

    labels: (id, annotator, y); features: (id, x). The rows with a label are
    sums over tasks: in each round every task gives gradients and counts of its
    part only; the driver holds the weights and the confusion matrices.
    """
    known = sorted(classes)
    n_c = len(known)
    names = [r[0] for r in labels.select("annotator").distinct().orderBy("annotator").collect()]
    code = F.array_position(F.array(*map(F.lit, known)), F.col("y")) - 1
    who = F.array_position(F.array(*map(F.lit, names)), F.col("annotator")) - 1
    given = labels.filter(F.col("y").isNotNull()).groupBy("id").agg(F.collect_list(F.struct(who.cast("int").alias("a"), code.cast("int").alias("c"))).alias("l"))
    rows = features.join(given, "id").select("x", "l").persist()
    dim = (rows.select(F.max(F.size("x"))).first()[0] or 0) + 1
    w, alpha = np.zeros((dim, n_c)), None
    last = None
    try:
        for _ in range(n_iter):
            g, h, counts, loss = _em_round(rows, w, alpha, len(names), n_c)
            alpha = counts + prior_full - 1 + 1e-9 + (prior_diag * np.eye(n_c))[None] + (prior_full == 1) * 1e-6
            alpha = alpha / alpha.sum(axis=2, keepdims=True)
            h = h + weights_prior * np.eye(dim * n_c)
            w = w + np.linalg.solve(h, (g - weights_prior * w).T.ravel()).reshape(n_c, dim).T
            if last is not None and abs(last - loss) < tol:
                break
            last = loss
    finally:
        rows.unpersist()
    return w, alpha


def _em_round(rows: DataFrame, w: np.ndarray, alpha: np.ndarray | None, n_a: int, n_c: int):
    import pyarrow as pa

    dim = len(w)

    def run(batches):
        g, h, counts, loss = np.zeros((dim, n_c)), np.zeros((n_c, dim, n_c, dim)), np.zeros((n_a, n_c, n_c)), 0.0
        for b in batches:
            for x, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array([*x, 1.0])
                z = x @ w
                p = np.exp(z - z.max())
                p /= p.sum()
                mu = np.zeros(n_c)
                if alpha is None:
                    for v in l:
                        mu[v["c"]] += 1
                else:
                    mu = p.copy()
                    for v in l:
                        mu = mu * alpha[v["a"], :, v["c"]]
                loss -= np.log(max(mu.sum(), 1e-300))
                mu = mu / max(mu.sum(), 1e-300)
                for v in l:
                    counts[v["a"], :, v["c"]] += mu
                g += np.outer(x, mu - p)
                h += np.einsum("cd,i,j->cidj", np.diag(p) - np.outer(p, p), x, x)
        flat = np.concatenate([g.ravel(), h.ravel(), counts.ravel(), [loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    got = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").toPandas()["v"].to_numpy()  # as many as there are weights squared
    a, b, c = dim * n_c, dim * n_c + (dim * n_c) ** 2, dim * n_c + (dim * n_c) ** 2 + n_a * n_c * n_c
    return got[:a].reshape(dim, n_c), got[a:b].reshape(n_c * dim, n_c * dim), got[b:c].reshape(n_a, n_c, n_c), float(got[c])


def annotator_performance(probas: DataFrame, alpha: np.ndarray) -> DataFrame:
    """Rows (id, annotator, perf): the chance that an annotator's answer is right, from rows (id, p) and the confusion matrices."""
    each = [sum((F.col("p")[c] * float(a[c, c]) for c in range(1, len(a))), F.col("p")[0] * float(a[0, 0])) for a in alpha]
    return probas.select("id", F.posexplode(F.array(*each)).alias("annotator", "perf"))


def linear_probas(rows: DataFrame, w: np.ndarray, out: str = "p") -> DataFrame:
    """Softmax of features times weights (the last row is the intercept)."""
    z = F.array(*(sum((F.col("x")[i] * float(w[i, c]) for i in range(len(w) - 1)), F.lit(float(w[-1, c]))) for c in range(w.shape[1])))
    return rows.withColumn(out, E.softmax(z))


