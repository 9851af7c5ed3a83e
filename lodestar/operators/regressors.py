"""Regressors over pools, expectations over their predictions, and strategies that use them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.rng import uniform
from lodestar.functions.selection import top_k
from lodestar.operators.diverse import clustered, nearest_distance, nearest_to_centres
from lodestar.operators.pairs import Side, against, kernels
from lodestar.sources.tables import kept


class NormalInverseChi:
    """Kernel-weighted normal-inverse-chi-squared regression: a Student t distribution for each row.

    The targets are centred at ``shift`` before the sums of squares, so that large means don't cancel.
    """

    def __init__(self, gamma: float | None = None, metric: str = "rbf", mu_0: float = 0.0, kappa_0: float = 0.1, sigma_sq_0: float = 1.0, nu_0: float = 2.0, shift: float = 0.0):
        self.gamma, self.metric, self.shift = gamma, metric, shift
        self.mu_0, self.kappa_0, self.sigma_sq_0, self.nu_0 = mu_0, kappa_0, sigma_sq_0, nu_0

    def gathered(self, lab: DataFrame) -> DataFrame:
        """Rows (id, x, s): the places of the labelled rows, with sums of weights, targets and squared targets (centred)."""
        t, w = F.col("y").cast("double") - self.shift, F.coalesce("w", F.lit(1.0))
        return lab.filter(F.col("y").isNotNull()).groupBy("x").agg(F.min("id").alias("id"), F.array(F.sum(w), F.sum(w * t), F.sum(w * t * t)).alias("s")).select("id", "x", "s")

    def sums(self, rows: DataFrame, lab: DataFrame, out: str = "s") -> DataFrame:
        """``rows`` with kernel sums of one, target and squared target (centred). Labelled rows at one place are added up first."""
        return self.sums_over(rows, self.gathered(lab), out)

    def sums_over(self, rows: DataFrame, ref: DataFrame, out: str = "s") -> DataFrame:
        """The same from :meth:`gathered` rows."""

        def f(a: Side, b: Side) -> np.ndarray:
            return kernels(a["x"], b["x"], self.metric, self.gamma) @ b["s"]

        return against(rows, ref, f, "sum", out, [0.0, 0.0, 0.0])

    def posterior(self, n, ky, kyy, lib=F):
        """(nu, loc, scale) of the Student t distribution from kernel sums; for columns or arrays."""
        has = lib.where(n > 0, n, 1.0) if lib is np else F.when(n > 0, n).otherwise(1.0)
        mean = ky / has
        var = kyy / has - mean * mean
        var = np.maximum(var, 0.0) if lib is np else F.greatest(var, F.lit(0.0))
        kappa, nu, mu_0 = self.kappa_0 + n, self.nu_0 + n, self.mu_0 - self.shift
        safe = (lib.where(kappa > 0, kappa, 1.0) if lib is np else F.when(kappa > 0, kappa).otherwise(1.0))
        loc = (self.kappa_0 * mu_0 + n * mean) / safe
        sigma_sq = (self.nu_0 * self.sigma_sq_0 + n * var + self.kappa_0 * n * (mu_0 - mean) * (mu_0 - mean) / safe) / nu
        scale = lib.sqrt((1 + kappa) / safe * sigma_sq)
        return nu, loc + self.shift, scale

    def predict(self, rows: DataFrame, lab: DataFrame) -> DataFrame:
        """``rows`` with pred, std, and nu, loc, scale of the distribution; null where no prior and no label give a mean."""
        return self.predicted(self.sums(rows, lab, "_s"))

    def predicted(self, got: DataFrame) -> DataFrame:
        """The same from rows with their kernel sums, ``_s``."""
        nu, loc, scale = self.posterior(*(F.col("_s")[k] for k in range(3)))
        known = F.col("_s")[0] + self.kappa_0 > 0
        got = got.withColumn("nu", nu).withColumn("loc", F.when(known, loc)).withColumn("scale", F.when(known, scale))
        return got.withColumn("pred", F.col("loc")).withColumn("std", F.when(F.col("nu") > 2, F.col("scale") * F.sqrt(F.col("nu") / (F.col("nu") - 2)))).drop("_s")


def nadaraya_watson(gamma: float | None = None, metric: str = "rbf", shift: float = 0.0) -> NormalInverseChi:
    return NormalInverseChi(gamma, metric, kappa_0=0.0, nu_0=3.0, sigma_sq_0=1.0, shift=shift)


class SparkMLRegressor:
    """Any ``pyspark.ml`` regressor fitted on labelled rows; their mean (0 without any) if there is nothing to fit."""

    def __init__(self, estimator):
        self.estimator = estimator

    def predict(self, rows: DataFrame, lab: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        known = lab.filter(F.col("y").isNotNull())
        mean, std, n = known.agg(F.avg("y"), F.stddev_pop("y"), F.count(F.lit(1))).first()
        if n < 2:
            return rows.withColumn("pred", F.lit(float(mean or 0.0))).withColumn("std", F.lit(float(std or 1.0)))
        model = self.estimator.fit(known.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")))
        return model.transform(rows.withColumn("features", array_to_vector("x"))).withColumnRenamed("prediction", "pred").drop("features")


def bayesian_linear(rows: DataFrame, lab: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """``rows`` with pred and std of a linear model with Gaussian weights: sums of products over the labelled rows only."""
    dim = (lab.select(F.max(F.size("x"))).first()[0] or 0) + 1
    x = [F.col("x")[i] for i in range(dim - 1)] + [F.lit(1.0)]
    aggs = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(dim) for j in range(i, dim)] + [F.sum(x[i] * F.col("y")).alias(f"b{i}") for i in range(dim)]
    r = lab.filter(F.col("y").isNotNull()).agg(*aggs).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(dim)] for i in range(dim)])
    s = np.linalg.inv(alpha * np.eye(dim) + beta * a)
    m = beta * s @ np.array([r[f"b{i}"] or 0.0 for i in range(dim)])
    pred = sum((x[i] * float(m[i]) for i in range(1, dim)), x[0] * float(m[0]))
    var = sum((x[i] * x[j] * float(s[i, j]) for i in range(dim) for j in range(dim)), F.lit(1 / beta))
    return rows.withColumn("pred", pred).withColumn("std", F.sqrt(var))


def t_entropy(rows: DataFrame, out: str = "entropy") -> DataFrame:
    """``rows`` (nu, scale, ...) with the differential entropy of the Student t prediction."""
    import pyarrow as pa

    def digamma(x: float) -> float:
        s = 0.0
        while x < 8:
            s, x = s - 1 / x, x + 1
        return s + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)

    def run(batches):
        for b in batches:
            h = []
            for nu, scale in zip(b.column(b.schema.get_field_index("nu")).to_pylist(), b.column(b.schema.get_field_index("scale")).to_pylist(), strict=True):
                beta = math.lgamma(nu / 2) + math.lgamma(0.5) - math.lgamma((nu + 1) / 2)
                h.append(None if scale is None else (nu + 1) / 2 * (digamma((nu + 1) / 2) - digamma(nu / 2)) + 0.5 * math.log(nu) + beta + math.log(scale))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h, pa.float64())], names=[*b.schema.names, out])

    return rows.mapInArrow(run, rows.withColumn(out, F.lit(None).cast("double")).schema)


def sampled_targets(rows: DataFrame, n_samples: int, seed: int = 0) -> DataFrame:
    """Rows (id, sample, y): targets drawn from the Student t predictions (id, nu, loc, scale)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            out = [(i, s, loc + scale * float(np.random.default_rng([seed, i & (1 << 63) - 1, s]).standard_t(nu))) for i, nu, loc, scale in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True) if loc is not None for s in range(n_samples)]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["id", "sample", "y"])

    return rows.select(F.col("id").cast("long"), "nu", "loc", "scale").mapInArrow(run, "id long, sample int, y double")


def gauss_hermite(n: int = 10) -> list[tuple[float, float]]:
    """(node, weight) for expectations under the standard normal distribution."""
    x, w = np.polynomial.hermite_e.hermegauss(n)
    return [(float(a), float(b) / math.sqrt(2 * math.pi)) for a, b in zip(x, w, strict=True)]


def _t_quantile(nu: np.ndarray, q: float) -> np.ndarray:
    """Student t quantiles by bisection of the integrated density."""
    if abs(q - 0.5) < 1e-12:
        return np.zeros_like(nu)
    nodes, weights = np.polynomial.legendre.leggauss(60)

    def cdf(t: np.ndarray) -> np.ndarray:
        th = np.arctan2(t, np.sqrt(nu))  # the integral of cos^(nu - 1)
        s = 0.5 * th[:, None] * (nodes + 1)
        part = (np.cos(s) ** (nu[:, None] - 1) * weights).sum(1) * 0.5 * th
        g = np.array([math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) for v in nu])
        return 0.5 + g * part

    lo, hi = np.full_like(nu, -1e6), np.full_like(nu, 1e6)
    for _ in range(90):
        mid = (lo + hi) / 2
        up = cdf(mid) < q
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def expectation(rows: DataFrame, target: Callable[[Column], Column], method: str = "gauss_hermite", n: int = 10, seed: int = 0, out: str = "e") -> DataFrame:
    """``rows`` (loc, scale, nu, id) with the expected value of ``target`` under the prediction.

    assume_linear: at the mean; gauss_hermite: as if normal; monte_carlo: over n
    hashed draws of normals; quantile: over n midpoint quantiles of the Student t
    distribution; dynamic_quad, trapezoid and simpson: over levels of its quantiles,
    by Gauss-Legendre nodes, or evenly spaced ones of the inner 0.998.
    """
    loc, scale = F.col("loc"), F.col("scale")
    if method == "assume_linear":
        return rows.withColumn(out, target(loc))
    if method == "gauss_hermite":
        nodes = gauss_hermite(n)
        return rows.withColumn(out, sum((w * target(loc + scale * x) for x, w in nodes[1:]), nodes[0][1] * target(loc + scale * nodes[0][0])))
    if method == "monte_carlo":
        from lodestar.functions.rng import normal

        draws = [target(loc + scale * normal(seed + k, "id")) for k in range(n)]
        return rows.withColumn(out, sum(draws[1:], draws[0]) / n)
    if method in ("quantile", "dynamic_quad", "trapezoid", "simpson"):
        import pyarrow as pa

        if method == "simpson" and n % 2 == 0:
            n += 1  # it takes an odd number of points
        legendre = np.polynomial.legendre.leggauss(n)
        level = {"quantile": [(k + 0.5) / n for k in range(n)], "dynamic_quad": ((legendre[0] + 1) / 2).tolist()}.get(method) or [0.001 + 0.998 * k / max(1, n - 1) for k in range(n)]
        weight = {"dynamic_quad": legendre[1].tolist(), "trapezoid": [0.5 if k in (0, n - 1) else 1.0 for k in range(n)], "simpson": [1.0 if k in (0, n - 1) else 4.0 if k % 2 else 2.0 for k in range(n)]}.get(method, [1.0] * n)

        def run(batches):
            for b in batches:
                nu = b.column(b.schema.get_field_index("nu")).to_numpy(zero_copy_only=False)
                q = np.stack([_t_quantile(nu, level[k]) for k in range(n)], axis=1)
                col = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, n, dtype=np.int32)), pa.array(q.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, "_q"])

        got = rows.mapInArrow(run, rows.withColumn("_q", F.lit(None).cast("array<double>")).schema)
        vals = F.zip_with("_q", F.array(*map(F.lit, weight)), lambda q, w: w * target(loc + scale * q))
        return got.withColumn(out, F.aggregate(vals, F.lit(0.0), lambda s, v: s + v) / sum(weight)).drop("_q")
    raise ValueError(f"no method {method}")


def places(rows: DataFrame) -> DataFrame:
    """Rows (id, x, n): the distinct features, the least id there and how many rows, dealt to all cores as pairs of them are dear."""
    return dealt(rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n")).select("id", "x", "n"))


def dealt(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _grown(reg: NormalInverseChi, a: Side, b: Side, y: np.ndarray):
    """Posterior of each evaluation row after one more label y (for each candidate) at a candidate."""
    k = kernels(a["x"], b["x"], reg.metric, reg.gamma)
    t = (y - reg.shift)[:, None]
    return reg.posterior(b["s"][:, 0] + k, b["s"][:, 1] + k * t, b["s"][:, 2] + k * t * t, np)


def _nodes(method: str, n: int, nu: np.ndarray, seed: int = 0) -> list[tuple[np.ndarray, float]]:
    """(place, weight) under standardised predictions of nu degrees of freedom; a place for each prediction.

    assume_linear: the mean; gauss_hermite: as if normal; quantile: midpoint
    quantiles of the Student t distribution; monte_carlo: as many drawn ones;
    dynamic_quad: Gauss-Legendre nodes over the levels of all quantiles.
    """
    one = np.ones_like(nu)
    if method == "assume_linear":
        return [(0.0 * one, 1.0)]
    if method == "gauss_hermite":
        return [(x * one, w) for x, w in gauss_hermite(n)]
    if method == "quantile":
        return [(_t_quantile(nu, (k + 0.5) / n), 1 / n) for k in range(n)]
    if method == "monte_carlo":
        return [(_t_quantile(nu, u), 1 / n) for u in np.random.default_rng(seed).uniform(0.0005, 0.9995, n)]
    if method == "dynamic_quad":
        x, w = np.polynomial.legendre.leggauss(n)
        return [(_t_quantile(nu, (a + 1) / 2), b / 2) for a, b in zip(x, w, strict=True)]
    raise ValueError(f"no method {method}")


def _retrained(cand: DataFrame, lab: DataFrame, evaluation: DataFrame, reg: NormalInverseChi, effect: Callable, method: str, n: int, seed: int = 0) -> DataFrame:
    """Mean over evaluation rows of ``effect`` of adding a candidate with its predicted label, over the nodes of the prediction.

    Rows at one place have one prediction and one effect: each place is asked
    about once, and counts as often as evaluation rows stand there. Places and
    their sums are kept, so that each side is read once for them, and the
    candidates once more for the result.
    """
    known = kept(reg.gathered(lab), "places")
    ready = kept(reg.sums_over(places(evaluation), known), "places")
    own = ready if cand is evaluation else kept(reg.sums_over(places(cand), known), "places")
    rows = reg.predicted(dealt(own.select("id", "x", F.col("s").alias("_s")))).select("id", "x", "nu", "loc", "scale")

    def f(a: Side, b: Side) -> np.ndarray:
        out = np.zeros((len(a["id"]), 2))
        out[:, 1] = b["n"].sum()
        old = reg.posterior(b["s"][:, 0], b["s"][:, 1], b["s"][:, 2], np)
        for x, w in _nodes(method, n, a["nu"].astype(float), seed):
            out[:, 0] += w * effect(old, _grown(reg, a, b, a["loc"] + a["scale"] * x)) @ b["n"]
        return out

    got = kept(against(rows, ready, f, "sum", "_r", [0.0, 1.0]).select(F.col("x").alias("_x"), (F.col("_r")[0] / F.col("_r")[1]).alias("utility")), "places")
    return cand.select("id", "x").join(got, F.col("x").eqNullSafe(F.col("_x"))).select("id", "utility")


def squared(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    return (new - old) ** 2


def model_output_change(cand: DataFrame, lab: DataFrame, evaluation: DataFrame, reg: NormalInverseChi, method: str = "assume_linear", n: int = 10, loss: Callable[[np.ndarray, np.ndarray], np.ndarray] = squared, seed: int = 0) -> DataFrame:
    """Rows (id, utility): mean ``loss``, the squared difference by default, of new and old predictions on the evaluation rows."""
    return _retrained(cand, lab, evaluation, reg, lambda old, new: loss(new[1], np.broadcast_to(old[1], new[1].shape)), method, n, seed)


def variance_reduction(cand: DataFrame, lab: DataFrame, evaluation: DataFrame, reg: NormalInverseChi, method: str = "assume_linear", n: int = 10, seed: int = 0) -> DataFrame:
    """Rows (id, utility): mean fall of the predictive variance on the evaluation rows."""
    var = lambda d: d[2] ** 2 * d[0] / np.maximum(d[0] - 2, 1e-12)
    return _retrained(cand, lab, evaluation, reg, lambda old, new: var(old)[None, :] - var(new), method, n, seed)


def t_log_density(y: np.ndarray, nu: np.ndarray, loc: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Log density of Student t distributions."""
    gap = _log_gamma((nu + 1) / 2) - _log_gamma(nu / 2)
    return gap - 0.5 * np.log(nu * np.pi) - np.log(scale) - (nu + 1) / 2 * np.log1p(((y - loc) / scale) ** 2 / nu)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for k in range(8):
        shift = shift + np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def cross_entropy(new: tuple, old: tuple, n: int = 20) -> np.ndarray:
    """Expected negative log density of the old Student t distributions under the new ones.

    By Gauss-Legendre nodes over t = tan, along which heavy tails are finite too.
    """
    x, w = np.polynomial.legendre.leggauss(2 * n)
    total, mass = 0.0, 0.0
    for a, b in zip(np.tan(x * np.pi / 2 * 0.999), w * np.pi / 2 * 0.999, strict=True):
        y = new[1] + new[2] * a
        p = np.exp(t_log_density(y, *new)) * new[2] * (1 + a * a) * b
        total, mass = total - p * t_log_density(y, *old), mass + p
    return total / mass


def information_gain(cand: DataFrame, lab: DataFrame, evaluation: DataFrame, reg: NormalInverseChi, method: str = "gauss_hermite", n: int = 10, normal: bool = True, seed: int = 0, nodes: int = 20) -> DataFrame:
    """Rows (id, utility): mean Kullback-Leibler divergence of the predictions from those before.

    ``normal``: as normals of equal mean and variance; else that of the Student t
    distributions, as cross-entropy less entropy by quadrature.
    """
    std = lambda d: d[2] * np.sqrt(d[0] / np.maximum(d[0] - 2, 1e-12))

    def kl(old, new):
        if not normal:
            before = tuple(np.broadcast_to(v, new[1].shape) for v in old)
            return cross_entropy(new, before, nodes) - cross_entropy(new, new, nodes)
        s0, s1 = std(old)[None, :], std(new)
        return np.log(s0 / s1) + (s1**2 + (new[1] - old[1][None, :]) ** 2) / (2 * s0**2) - 0.5

    return _retrained(cand, lab, evaluation, reg, kl, method, n, seed)


def model_change(cand: DataFrame, lab: DataFrame, reg: NormalInverseChi, n_bootstrap: int = 5, n_train: float = 0.5, seed: int = 0, norm: float = 2, feature_map: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows (id, utility): mean distance of bootstrapped predictions from the model's, times the norm of the features.

    norm: the order, 1, 2, ... or infinity; feature_map: an array of numbers of the features, themselves by default.
    """
    known = lab.filter(F.col("y").isNotNull())
    out = reg.predict(cand.select("id", "x"), known).select("id", "x", F.col("pred").alias("plain"))
    for b in range(n_bootstrap):
        # a row's multiplicity in a bootstrap sample of that share is a Poisson count, from a hash
        u, p = uniform(seed + b, "id"), math.exp(-n_train)
        count, below, term, k = F.lit(0.0), p, p, 0
        while below < 1 - 1e-15 and term > 1e-18:
            k += 1
            count = count + F.when(u > below, 1.0).otherwise(0.0)
            term *= n_train / k
            below += term
        sample = known.withColumn("w", F.coalesce("w", F.lit(1.0)) * count).filter("w > 0")
        out = reg.predict(out, sample).withColumn(f"b{b}", F.coalesce("pred", F.lit(0.0))).drop("pred", "std", "nu", "loc", "scale")
    phi = feature_map(F.col("x")) if feature_map else F.col("x")
    size = F.array_max(F.transform(phi, F.abs)) if norm == math.inf else F.pow(F.aggregate(phi, F.lit(0.0), lambda s, v: s + F.pow(F.abs(v), F.lit(float(norm)))), F.lit(1.0 / norm))
    diff = sum((F.abs(F.col(f"b{b}") - F.col("plain")) for b in range(1, n_bootstrap)), F.abs(F.col("b0") - F.col("plain"))) / n_bootstrap
    return out.select("id", (diff * size).alias("utility"))


def leaf_acquisitions(leaves: DataFrame, batch_size: int) -> DataFrame:
    """Rows (leaf, n): how many of the batch each leaf gets, as real numbers, from rows (leaf, y)."""
    per = leaves.groupBy("leaf").agg(F.sum(F.col("y").isNull().cast("int")).alias("u"), F.coalesce(F.var_samp("y"), F.lit(0.0)).alias("v"))
    all_ = per.agg(F.sum("u").alias("u_all"), F.count(F.lit(1)).alias("k"))
    share = F.sqrt(F.col("u") / F.col("u_all") * F.col("v"))
    rows = per.join(F.broadcast(all_)).withColumn("s", share)  # one row
    total = rows.agg(F.sum("s").alias("t"))
    n = F.when(F.col("t") > 0, batch_size * F.col("s") / F.col("t")).otherwise(batch_size / F.col("k"))
    return rows.join(F.broadcast(total)).select("leaf", n.alias("n"))


def tree_based(cand: DataFrame, lab: DataFrame, k: int = 1, method: str = "random", max_depth: int = 3, seed: int = 0) -> DataFrame:
    """A regression tree's leaves share the batch by size and variance; within them random, farthest or representative rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    spark = cand.sparkSession
    known = lab.filter(F.col("y").isNotNull())
    if known.limit(2).count() < 2:
        return top_k(cand.select("id", uniform(seed, "id").alias("utility")), k).select("step", "id", "utility")
    tree = DecisionTreeRegressor(maxDepth=max_depth, seed=seed, leafCol="leaf", minInstancesPerNode=2)
    model = tree.fit(known.select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label")))
    every = cand.select("id", "x", F.lit(None).cast("double").alias("y")).unionByName(known.select("id", "x", F.col("y").cast("double")))
    leaves = model.transform(every.withColumn("features", array_to_vector("x"))).select("id", "x", "y", F.col("leaf").cast("int").alias("leaf")).persist()
    shares = sorted((r.leaf, r.n) for r in leaf_acquisitions(leaves.select("leaf", "y"), k).collect())  # one row a leaf
    rng = np.random.default_rng(seed)
    counts = {leaf: int(n) for leaf, n in shares}
    rest, left = np.array([n - int(n) for _, n in shares]), k - sum(counts.values())
    if left > 0 and rest.sum() > 0:
        for i in rng.choice(len(shares), min(left, int((rest > 0).sum())), replace=False, p=rest / rest.sum()):
            counts[shares[i][0]] += 1
    out = []
    for leaf, n in counts.items():
        if n == 0:
            continue
        own = leaves.filter((F.col("leaf") == leaf) & F.col("y").isNull()).select("id", "x")
        if method == "diversity":
            got = top_k(nearest_distance(own, known, out="utility"), n).collect()
        elif method == "representativity" and n > 1:
            rows, centres = clustered(own, n, seed)
            got = nearest_to_centres(rows.select("id", "x"), centres).collect()
        else:
            got = top_k(own.select("id", uniform(seed, "id").alias("utility")), n).collect()
        out += [(r.id, float(r.utility)) for r in got]
    leaves.unpersist()
    return spark.createDataFrame([(s, i, u) for s, (i, u) in enumerate(out, 1)], "step int, id long, utility double")


def cost_embedding(cand: DataFrame, lab: DataFrame, classes: list, cost: list[list[float]], embed_dim: int = 2, gamma: float | None = None, seed: int = 0, regressor=None, rounds: int = 300) -> DataFrame:
    """Rows (id, utility): distance of a candidate's predicted place in a cost embedding of the classes to the nearest class.

    The classes, once as truth and once as prediction, are placed so that
    distances follow costs (SMACOF on the costs between the two kinds);
    coordinates are predicted by kernel regression, or by a ``regressor``, one
    after the other. Without any label all utilities are one.
    """
    known = sorted(classes)
    c = np.array(cost, dtype=float)
    n = len(known)
    want = np.zeros((2 * n, 2 * n))
    want[:n, n:] = want[n:, :n] = (c / max(c.max(), 1e-12)).reshape(n, n)
    want[n:, :n] = want[:n, n:].T
    weight = np.zeros_like(want)
    weight[:n, n:] = weight[n:, :n] = 1.0
    z = np.random.default_rng(seed).standard_normal((2 * n, embed_dim))
    v = np.diag(weight.sum(1)) - weight
    v_inv = np.linalg.pinv(v)
    for _ in range(rounds):
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
        b = -weight * want / np.where(d > 1e-12, d, 1.0)
        b -= np.diag(b.sum(1))
        z = v_inv @ b @ z
    truth, hidden = z[:n], z[n:]
    rows = lab.filter(F.col("y").isNotNull())
    place = F.array_position(F.array(*map(F.lit, known)), F.col("y")) - 1
    coords = F.array(*(F.element_at(F.array(*map(F.lit, map(float, truth[:, d]))), (place + 1).cast("int")) for d in range(embed_dim)))
    ref = rows.select("id", "x", coords.alias("z"))
    if regressor is not None:
        got = cand.select("id", "x")
        for d in range(embed_dim):
            got = regressor.predict(got, ref.select("id", "x", F.col("z")[d].alias("y"), F.lit(1.0).alias("w"))).withColumn(f"_z{d}", F.col("pred")).drop("pred", "std", "nu", "loc", "scale")
        near = [F.sqrt(sum(((F.col(f"_z{d}") - float(h[d])) ** 2 for d in range(1, embed_dim)), (F.col("_z0") - float(h[0])) ** 2)) for h in hidden]
        some = ref.head(1) != []
        return got.select("id", (F.least(*near) if len(near) > 1 else near[0]).alias("utility") if some else F.lit(1.0).alias("utility"))

    def f(a: Side, b: Side) -> np.ndarray:
        k = kernels(a["x"], b["x"], "rbf", gamma)
        return np.hstack([k.sum(axis=1, keepdims=True), k @ b["z"]])

    got = against(cand.select("id", "x"), ref, f, "sum", "_z", [0.0] * (1 + embed_dim))
    at = [F.col("_z")[1 + d] / F.col("_z")[0] for d in range(embed_dim)]
    dist = [F.sqrt(sum(((at[d] - float(h[d])) ** 2 for d in range(1, embed_dim)), (at[0] - float(h[0])) ** 2)) for h in hidden]
    return got.select("id", F.when(F.col("_z")[0] > 0, F.least(*dist) if len(dist) > 1 else dist[0]).otherwise(1.0).alias("utility"))
