"""Utilities of coverage, distance, density and diversity, and greedy batches of them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import exprs as E
from lodestar.functions.rng import uniform
from lodestar.functions.selection import DIGITS, proportional, rand_argmax, smallest, top_k
from lodestar.operators.classifiers import ParzenWindow, mixture_responsibilities
from lodestar.operators.pairs import PAIRS_AT_ONCE, Side, against, as_arrays, distances, fetched
from lodestar.sources.tables import new_folder

#: Rows of a block of a factored matrix, and bytes of right sides that a task solves at once.
BLOCK_ROWS, SOLVE_BYTES = 1024, 64 << 20
#: Clusters beyond which a round of ``pyspark.ml``'s k-means, and its choice of the first centres, take too long.
MANY_CLUSTERS = 256
#: Picks after which the state of a greedy batch is kept anew.
REFRESH = 8


def to_column(x: list[float]) -> Column:
    return F.array(*map(F.lit, map(float, x)))


def without(rows: DataFrame, ids: list[int]) -> DataFrame:
    """The rows that are not among some picked ids."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(i,) for i in ids], "id long")), "id", "left_anti") if ids else rows  # as many as picks


def greedy_steps(scored: DataFrame, k: int, step_of: Callable[[DataFrame, object], DataFrame], pick: Callable[[DataFrame, int], object] | None = None) -> DataFrame:
    """Rows (step, id, utility): k picks, each from the state that the pick before left.

    scored: rows (id, utility, ...); ``step_of(state, row)`` gives the state after a
    pick. The state is a plan over kept rows that grows by one expression a step;
    every REFRESH picks its rows are kept anew and the plan starts from them. Only
    the picked row comes to the driver.
    """
    spark = scored.sparkSession
    state, out = scored.persist(), []
    try:
        now = state
        for step in range(1, k + 1):
            row = pick(now, step) if pick else now.filter(F.col("utility").isNotNull()).orderBy(F.round("utility", DIGITS).desc(), "id").first()
            if row is None:
                break
            out.append((step, row.id, float(row.utility)))
            now = step_of(now.filter(F.col("id") != row.id), row)
            if step % REFRESH == 0 and step < k:
                now = now.persist()
                now.count()
                state.unpersist()
                state = now
        return spark.createDataFrame(out, "step int, id long, utility double")
    finally:
        state.unpersist()


def nearest_distance(rows: DataFrame, ref: DataFrame, metric: str = "euclidean", out: str = "d") -> DataFrame:
    """``rows`` with the least distance to a reference row; null without any."""
    places = ref.groupBy("x").agg(F.min("id").alias("id")).select("id", "x")
    got = against(rows, places, lambda a, b: distances(a["x"], b["x"], metric).min(axis=1), "min", "_d")
    return got.withColumn(out, F.col("_d")[0]).drop("_d")


def core_set(cand: DataFrame, lab: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    """Farthest-first batch: rows (step, id, utility); without labelled rows the first utilities are zero."""
    dist = {"euclidean": E.euclidean, "manhattan": E.manhattan}[metric]
    scored = nearest_distance(cand.select("id", "x"), lab, metric, "utility").withColumn("utility", F.coalesce("utility", F.lit(0.0)))
    first = lab.head(1) == []

    def after(state: DataFrame, row) -> DataFrame:
        d = dist(F.col("x"), to_column(row.x))
        return state.withColumn("utility", d if first and row.utility == 0 else F.least("utility", d))

    return greedy_steps(scored, k, after)


def greedy_x(cand: DataFrame, lab: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    """Farthest-first in the features; without labelled rows the first pick is the row nearest to all others."""
    dist = {"euclidean": E.euclidean, "manhattan": E.manhattan}[metric]
    rows = cand.select("id", "x")
    none = lab.head(1) == []
    if none:
        got = against(rows, rows, lambda a, b: distances(a["x"], b["x"], metric).sum(axis=1), "sum", "_d")
        scored = got.select("id", "x", (-F.col("_d")[0]).alias("utility"), F.lit(None).cast("double").alias("d"))
    else:
        scored = nearest_distance(rows, lab, metric, "d").withColumn("utility", F.col("d"))

    def after(state: DataFrame, row) -> DataFrame:
        d = F.least("d", dist(F.col("x"), to_column(row.x)))
        return state.withColumn("d", d).withColumn("utility", F.col("d"))

    return greedy_steps(scored, k, after)


def greedy_target(cand: DataFrame, lab: DataFrame, prediction: str = "pred", method: str = "GSi", k: int = 1, metric: str = "euclidean", n_gsx: int = 1) -> DataFrame:
    """Least over chosen rows of the distance in targets (GSy), times that in features (GSi); candidates' targets are predictions.

    While fewer than ``n_gsx`` rows are labelled the picks go by the features alone.
    """
    few = max(0, n_gsx - lab.limit(n_gsx).count())
    if few:
        start = greedy_x(cand, lab, min(few, k), metric)
        if k <= few:
            return start
        picked = cand.join(start.select("id"), "id", "left_semi").select("id", "x", F.col(prediction).cast("double").alias("y"))
        known = lab.select("id", "x", F.col("y").cast("double").alias("y")).unionByName(picked)
        rest = greedy_target(cand.join(start.select("id"), "id", "left_anti"), known, prediction, method, k - few, metric, 0)
        return start.unionAll(rest.withColumn("step", F.col("step") + few))
    mix = (lambda dx, dy: dy) if method == "GSy" else (lambda dx, dy: dx * dy)
    rows = cand.select("id", "x", F.col(prediction).cast("double").alias("t"))
    ref = lab.select("id", "x", F.col("y").cast("double").alias("t"))
    got = against(rows, ref, lambda a, b: mix(distances(a["x"], b["x"], metric), np.abs(a["t"][:, None] - b["t"][None, :])).min(axis=1), "min", "_d")
    scored = got.withColumn("utility", F.coalesce(F.col("_d")[0], F.lit(0.0))).drop("_d")

    def after(state: DataFrame, row) -> DataFrame:
        dx, dy = {"euclidean": E.euclidean, "manhattan": E.manhattan}[metric](F.col("x"), to_column(row.x)), F.abs(F.col("t") - row.t)
        return state.withColumn("utility", F.least("utility", mix(dx, dy)))

    return greedy_steps(scored, k, after)


def prob_cover(cand: DataFrame, other: DataFrame, delta: float | None = None, k: int = 1, metric: str = "euclidean", n_classes: int | None = None, deltas: list[float] | None = None, alpha: float = 0.95, seed: int = 0, estimator=None) -> DataFrame:
    """Greedy coverage: the row whose ball of radius delta holds most candidates that no other row's ball holds yet.

    Without ``delta`` it is the largest of ``deltas`` (0.2, 0.4 ... 2 by default) that is pure enough for the
    pseudo-classes of a clustering into ``n_classes``.
    """
    dist = {"euclidean": E.euclidean, "manhattan": E.manhattan}[metric]
    if delta is None:
        rows, _ = clustered(cand.select("id", "x").unionByName(other.select("id", "x")), n_classes or 2, seed, estimator=estimator)
        delta = purity_delta(rows.select("id", "x", F.col("cluster").alias("c")), deltas or [0.2 * i for i in range(1, 11)], alpha, metric)
    near = nearest_distance(cand.select("id", "x"), other, metric, "d")
    state = near.select("id", "x", F.coalesce(F.col("d") > delta, F.lit(True)).alias("free")).persist()
    spark, out = cand.sparkSession, []
    try:
        for step in range(1, k + 1):
            open_rows = state.filter("free").select("id", "x")
            left = without(state, [o[1] for o in out])
            got = against(left.select("id", "x"), open_rows, lambda a, b: (distances(a["x"], b["x"], metric) <= delta).sum(axis=1), "sum", "_n", [0.0])
            row = got.select("id", "x", F.col("_n")[0].alias("utility")).orderBy(F.desc("utility"), "id").first()
            if row is None:
                break
            out.append((step, row.id, row.utility))
            new = state.withColumn("free", F.col("free") & (dist(F.col("x"), to_column(row.x)) > delta)).persist()
            new.count()
            state.unpersist()
            state = new
        return spark.createDataFrame(out, "step int, id long, utility double")
    finally:
        state.unpersist()


def purity_delta(pool: DataFrame, deltas: list[float], alpha: float = 0.95, metric: str = "euclidean") -> float:
    """The largest radius up to which the balls of enough rows (id, x, c) hold one pseudo-class only."""
    rows, best = pool.select("id", "x", F.col("c").cast("double").alias("c")), deltas[0]
    for d in sorted(deltas):
        got = against(rows, rows, lambda a, b, d=d: ((distances(a["x"], b["x"], metric) <= d) & (a["c"][:, None] != b["c"][None, :])).sum(axis=1), "sum", "_n", [0.0])
        if got.agg(F.avg((F.col("_n")[0] == 0).cast("double"))).first()[0] < alpha:
            break
        best = d
    return best


def neighbours(rows: DataFrame, ref: DataFrame, k: int, columns: list[str], metric: str = "euclidean", same: bool = True, within: str | None = None) -> DataFrame:
    """``rows`` with ``nn``: the k nearest reference rows as arrays (distance, id, columns ...), nearest first.

    Without ``same`` rows of the own id are infinitely far, and with ``within``
    rows with another number in that column.
    """
    width = 2 + len(columns)

    def f(a: Side, b: Side) -> np.ndarray:
        d = distances(a["x"], b["x"], metric)
        if not same:
            d = np.where(a["id"][:, None] == b["id"][None, :], np.inf, d)
        if within:
            d = np.where(a[within][:, None] == b[within][None, :], d, np.inf)
        n = min(k, d.shape[1])
        at = np.lexsort((np.broadcast_to(b["id"], d.shape), np.round(d, DIGITS)), axis=1)[:, :n]
        lines = np.full((len(d), k, width), np.nan)
        lines[:, :n, 0] = np.take_along_axis(d, at, axis=1)
        lines[:, :n, 1] = b["id"][at]
        for c, name in enumerate(columns):
            lines[:, :n, 2 + c] = b[name][at]
        return lines.reshape(len(d), -1)

    got = against(rows, ref, f, "concat", "_l", [])
    cells = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size("_l") / width).cast("int"))), lambda j: F.slice("_l", (j - 1) * width + 1, width)), lambda c: F.get(c, F.lit(0)).isNotNull())
    ordered = F.array_sort(cells, lambda p, q: F.when(F.round(p[0], DIGITS) < F.round(q[0], DIGITS), -1).when(F.round(p[0], DIGITS) > F.round(q[0], DIGITS), 1).when(p[1] < q[1], -1).when(p[1] > q[1], 1).otherwise(0))
    return got.withColumn("nn", F.slice(ordered, 1, k)).drop("_l")


def contrastive(cand: DataFrame, lab: DataFrame, n_classes: int, k: int = 5, embedding: str = "x") -> DataFrame:
    """Mean divergence of the k nearest labelled rows' probabilities from the candidate's; zero without labelled rows.

    Both sides are rows (id, p and an ``embedding``, in which is measured what is near).
    """
    flat = lab.select("id", F.col(embedding).alias("x"), *(F.col("p")[c].alias(f"p{c}") for c in range(n_classes)))
    got = neighbours(cand.select("id", F.col(embedding).alias("x"), "p"), flat, k, [f"p{c}" for c in range(n_classes)])
    each = F.transform("nn", lambda v: E.kl(F.slice(v, 3, n_classes), F.col("p")))
    return got.select("id", F.coalesce(E.total(each) / F.nullif(F.size("nn"), F.lit(0)), F.lit(0.0)).alias("utility"))


def typicality(rows: DataFrame, k: int = 5, eps: float = 1e-7) -> DataFrame:
    """Rows (id, cluster, utility): the inverse mean distance to the k nearest rows of the own cluster; one for a cluster's only row.

    All clusters in one pass: rows of other clusters are infinitely far.
    """
    own = rows.select("id", "x", F.col("cluster").cast("double").alias("c"))
    n = neighbours(own, own, k, [], same=False, within="c")
    near = F.filter("nn", lambda v: v[0] < float("inf"))
    u = F.when(F.size(near) == 0, 1.0).otherwise(1 / (E.total(F.transform(near, lambda v: v[0])) / F.size(near) + eps))
    return n.select("id", F.col("c").cast(dict(rows.dtypes)["cluster"]).alias("cluster"), u.alias("utility"))


def many_means(rows: DataFrame, k: int, seed: int = 0, rounds: int = 20, tol: float = 1e-4) -> tuple[DataFrame, np.ndarray]:
    """k-means for a number of clusters that grows with the rows: each round is products of matrices over all rows and centres.

    The first centres are k distinct places of smallest hash (fewer places:
    fewer clusters). The centres come to the driver, as those of ``pyspark.ml`` do; no row does.
    """
    spark, places = rows.sparkSession, rows.groupBy("x").agg(F.min("id").alias("id"))
    centres = np.array([r.x for r in places.orderBy(F.xxhash64(F.lit(seed), "id"), "id").select("x").limit(k).collect()], dtype=float)  # k centres
    data = rows.persist()

    def assigned(centres: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = sent.value
            half, step = (c * c).sum(axis=1) / 2, max(1, PAIRS_AT_ONCE // len(c))
            for b in batches:
                x = as_arrays(b.select(["x"]))["x"]
                own = [(half - x[s : s + step] @ c.T).argmin(axis=1) for s in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(own) if own else [], pa.int32())], names=[*b.schema.names, "cluster"])

        return data.mapInArrow(run, data.withColumn("cluster", F.lit(0)).schema)

    for _ in range(rounds):
        means = assigned(centres).groupBy("cluster").agg(F.array(*(F.avg(F.col("x")[d]) for d in range(centres.shape[1]))).alias("m"))
        new = centres.copy()
        got = means.toArrow()  # k centres
        new[got.column("cluster").to_numpy()] = got.column("m").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, centres.shape[1])
        moved, centres = np.abs(new - centres).max(initial=0.0), new
        if moved < tol:
            break
    data.unpersist()
    return assigned(centres), centres


def clustered(rows: DataFrame, k: int, seed: int = 0, weight: str | None = None, estimator=None) -> tuple[DataFrame, np.ndarray]:
    """``rows`` with a ``cluster``, and the centres.

    estimator: a ``pyspark.ml`` clusterer with ``k`` and centres instead of
    k-means, or a function (rows, k, seed, weight) that gives both.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if estimator is not None and not hasattr(estimator, "fit"):
        return estimator(rows, k, seed, weight)
    if estimator is None and weight is None and k > MANY_CLUSTERS:
        return many_means(rows, k, seed)
    km = estimator.copy().setK(k) if estimator is not None else KMeans(k=k, seed=seed, maxIter=20)
    km.setParams(featuresCol="_f", predictionCol="cluster")
    if weight:
        km.setParams(weightCol=weight)
    data = rows.withColumn("_f", array_to_vector("x"))
    model = km.fit(data)
    return model.transform(data).drop("_f"), np.array([list(c) for c in model.clusterCenters()])


def typi_clust(cand: DataFrame, lab: DataFrame, k: int = 1, seed: int = 0, neighbours_k: int = 5, estimator=None) -> DataFrame:
    """Cluster all rows; again and again the most typical candidate of the largest cluster without a labelled or picked row."""
    every = cand.select("id", "x", F.lit(True).alias("free")).unionByName(lab.select("id", "x", F.lit(False).alias("free")))
    rows, _ = clustered(every, max(2, lab.count() + k), seed, estimator=estimator)
    rows = rows.select("id", "x", "free", "cluster").persist()
    try:
        sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max((~F.col("free")).cast("int")).alias("covered"))
        chosen = sizes.filter("covered = 0").orderBy(F.desc("n"), "cluster").limit(k).withColumn("step", F.row_number().over(Window.orderBy(F.desc("n"), "cluster"))).select("cluster", "step")  # k rows
        asked = rows.join(F.broadcast(chosen), "cluster").select("id", "x", "cluster", "step")
        best = rand_argmax(typicality(asked, neighbours_k).join(F.broadcast(chosen), "cluster"), group="step")
        return best.select(F.col("step").cast("int").alias("step"), "id", "utility").persist()
    finally:
        rows.unpersist()


def nearest_to_centres(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows (step, id, utility): for each centre in turn the nearest row not taken yet; utility is the negative distance."""
    table = F.array(*(to_column(c) for c in centres))
    spread = rows.select("id", F.posexplode(F.transform(table, lambda c: E.euclidean(F.col("x"), c))).alias("centre", "d"))
    best = spread.withColumn("r", F.row_number().over(Window.partitionBy("centre").orderBy("d", "id"))).filter(F.col("r") <= len(centres)).orderBy("centre", "r").collect()  # centres squared
    out, taken, done = [], set(), set()
    for r in best:
        if r.centre not in done and r.id not in taken:
            taken.add(r.id)
            done.add(r.centre)
            out.append((len(out) + 1, r.id, -r.d))
    return rows.sparkSession.createDataFrame(out, "step int, id long, utility double")


def clue(cand: DataFrame, k: int = 1, method: str = "entropy", seed: int = 0, estimator=None) -> DataFrame:
    """Uncertainty-weighted k-means over candidates (id, x, p); the nearest row to each centre."""
    from lodestar.operators.informative import uncertainty

    u = uncertainty(cand.select("id", "p"), method).select("id", F.greatest("utility", F.lit(1e-12)).alias("u"))
    rows, centres = clustered(cand.select("id", "x").join(u, "id"), k, seed, "u", estimator) if k > 1 else (cand.select("id", "x"), weighted_mean(cand.select("id", "x").join(u, "id")))
    return nearest_to_centres(rows.select("id", "x"), centres)


def weighted_mean(rows: DataFrame) -> np.ndarray:
    dim = rows.select(F.max(F.size("x"))).first()[0]
    r = rows.agg(*((F.sum(F.col("x")[i] * F.col("u")) / F.sum("u")).alias(f"m{i}") for i in range(dim))).first()
    return np.array([list(r)])


def dropout_disagreement(cand: DataFrame, predict: Callable[[DataFrame], DataFrame], n_samples: int = 5, rate: float = 0.3, seed: int = 0) -> DataFrame:
    """Rows (id, utility): share of predictions from features zeroed at random that differ from the plain one.

    ``predict`` adds ``pred`` to rows (id, x, ...).
    """
    plain = predict(cand.select("id", "x")).select("id", F.col("pred").alias("plain"))
    many = cand.select("id", "x", F.explode(F.sequence(F.lit(1), F.lit(n_samples))).alias("s"))
    dropped = many.select("id", "s", F.transform("x", lambda v, i: F.when(uniform(seed, "id", "s", i) < rate, 0.0).otherwise(v)).alias("x"))
    got = predict(dropped).join(plain, "id")
    return got.groupBy("id").agg(F.avg((F.col("pred") != F.col("plain")).cast("double")).alias("utility"))


def drop_query(cand: DataFrame, predict: Callable[[DataFrame], DataFrame], k: int = 1, n_samples: int = 5, rate: float = 0.3, seed: int = 0, estimator=None) -> DataFrame:
    """Candidates that dropout makes waver (at least k), clustered, and the nearest to each centre."""
    u = dropout_disagreement(cand, predict, n_samples, rate, seed).persist()
    wavering = u.filter("utility > 0.5")
    some = wavering if wavering.count() >= k else top_k(u, k)
    kept = cand.select("id", "x").join(some.select("id"), "id").persist()
    if k == 1:
        return nearest_to_centres(kept, weighted_mean(kept.withColumn("u", F.lit(1.0))))
    rows, centres = clustered(kept, k, seed, estimator=estimator)
    return nearest_to_centres(rows.select("id", "x"), centres)


def badge(cand: DataFrame, n_classes: int, k: int = 1, seed: int = 0, embedding: str = "x") -> DataFrame:
    """Gradient embeddings of candidates (id, p and an ``embedding`` of theirs): the largest first, then drawn by squared distance to the picks."""
    place = E.argmax(F.transform(F.col("p"), lambda v: F.round(v, 12)))
    g = E.outer(F.zip_with("p", E.one_hot(place, n_classes), lambda a, b: a - b), F.col(embedding))
    rows = cand.select("id", g.alias("x")).withColumn("utility", E.dot(F.col("x"), F.col("x")))

    def pick(state: DataFrame, step: int):
        if step == 1:
            return state.orderBy(F.round("utility", DIGITS).desc(), "id").first()
        return proportional(state, 1, seed=seed + step).first()

    return greedy_steps(rows, k, lambda state, row: state.withColumn("utility", F.least("utility", E.sqdist(F.col("x"), to_column(row.x)))), pick)


def falcun(cand: DataFrame, k: int = 1, gamma: float = 10.0, seed: int = 0) -> DataFrame:
    """Margin plus distance in probability space to the power gamma; picks are drawn in proportion. cand: (id, p)."""
    spark = cand.sparkSession
    rows = cand.select("id", "p", E.margin(F.col("p")).alias("m")).withColumn("d", F.col("m")).persist()
    out, now = [], rows
    for step in range(1, k + 1):
        weight = F.pow(F.col("m") + F.col("d"), F.lit(gamma))
        total = now.agg(F.sum(weight)).first()[0]
        if total is None:
            break
        scored = now.withColumn("utility", weight / total if total > 0 else F.lit(1.0))
        row = proportional(scored, 1, seed=seed + step).first()
        out.append((step, row.id, row.utility))
        now = now.filter(F.col("id") != row.id).withColumn("d", F.least("d", E.manhattan(F.col("p"), to_column(row.p))))
        low, high = now.agg(F.min("d"), F.max("d")).first()
        if low is not None and high > low:
            now = now.withColumn("d", (F.col("d") - low) / (high - low))
    rows.unpersist()
    return spark.createDataFrame(out, "step int, id long, utility double")


def falcun_first(cand: DataFrame, gamma: float = 10.0) -> DataFrame:
    """Rows (id, utility): the chances of the first draw."""
    w = F.pow(2 * E.margin(F.col("p")), F.lit(gamma))
    rows = cand.select("id", w.alias("w"))
    s = rows.agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(s)).select("id", F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(1.0 / F.col("n")).alias("utility"))  # one row


def four_ds(pool: DataFrame, probas: DataFrame, k: int = 1, components: int = 3, lmbda: float | None = None, seed: int = 0) -> DataFrame:
    """Distance to the decision boundary, density, diversity and distribution, each scaled to 0..1 and weighed. pool: (id, x, y)."""
    mix = mixture_responsibilities(pool.select("id", "x", "y"), components, seed).persist()
    n = components
    share = mix.agg(*(F.avg(F.col("r")[j]).alias(f"w{j}") for j in range(n)), *(F.coalesce(F.avg(F.when(F.col("y").isNotNull(), F.col("r")[j])), F.lit(0.0)).alias(f"l{j}") for j in range(n)), F.count("y").alias("n_lab")).first()
    w, lab_r, n_lab = [share[f"w{j}"] for j in range(n)], [share[f"l{j}"] for j in range(n)], share.n_lab
    top = F.sort_array("p", False)
    rows = mix.filter(F.col("y").isNull()).select("id", "r", "density").join(probas.select("id", "p"), "id")
    rows = rows.withColumn("dist", F.log((top[0] + 1e-5) / (top[1] + 1e-5))).withColumn("doubt", 1 - top[0])
    b = rows.agg(F.min("dist").alias("a"), F.max("dist").alias("b"), F.min("density").alias("c"), F.max("density").alias("d"), F.avg("doubt").alias("u")).first()
    if b.a is None:
        return pool.sparkSession.createDataFrame([], "step int, id long, utility double")
    scaled = lambda c, lo, hi: (F.col(c) - lo) / (hi - lo) if hi > lo else F.lit(0.0)
    rows = rows.withColumn("distance", scaled("dist", b.a, b.b)).withColumn("dense", scaled("density", b.c, b.d))
    rows = rows.select("id", "r", "distance", "dense", "doubt").persist()
    lam = lmbda if lmbda is not None else min(0.05 * (k - 1), 0.5)
    rho = min(1.0, sum(abs(x - y) for x, y in zip(w, lab_r, strict=True)))
    if k > 1:
        rho = min(rho, 1 - lam)
        alpha = (1 - rho - lam) * (1 - b.u)
        beta = 1 - rho - alpha - lam
    else:
        lam = 0.0
        alpha = (1 - rho) * rows.agg(F.avg(F.col("doubt") * F.col("dense"))).first()[0]
        beta = 1 - rho - alpha
    out, chosen_r, chosen_d, gone = [], [0.0] * n, 0.0, []
    for step in range(1, k + 1):
        mean = lambda j: (F.lit(lab_r[j] * n_lab + chosen_r[j]) + F.col("r")[j]) / (n_lab + k)  # noqa: B023, E731
        spread = 1 - sum((F.greatest(F.lit(0.0), F.lit(w[j]) - mean(j)) for j in range(1, n)), F.greatest(F.lit(0.0), F.lit(w[0]) - mean(0)))
        u = alpha * (1 - F.col("distance")) + beta * F.col("dense") + rho * spread
        if lam:
            u = u + lam * (-F.log((F.col("dense") + chosen_d) / (k + 1) + 1e-12))
        left = without(rows, gone)
        row = top_k(left.withColumn("utility", u), 1).first()
        if row is None:
            break
        out.append((step, row.id, row.utility))
        gone.append(row.id)
        chosen_r, chosen_d = [c + r for c, r in zip(chosen_r, row.r, strict=True)], chosen_d + row.dense
    rows.unpersist()
    mix.unpersist()
    return pool.sparkSession.createDataFrame(out, "step int, id long, utility double")


def discriminative(cand: DataFrame, lab: DataFrame, clf: ParzenWindow | None = None, gamma: float | None = None) -> DataFrame:
    """Rows (id, utility): probability of being unlabelled, by a classifier of labelled against unlabelled rows."""
    disc = clf or ParzenWindow([0, 1], gamma=gamma)
    both = cand.select("id", "x", F.lit(1).alias("y"), F.lit(1.0).alias("w")).unionByName(lab.select("id", "x", F.lit(0).alias("y"), F.lit(1.0).alias("w")))
    return disc.probas(cand.select("id", "x"), both).select("id", F.col("p")[1].alias("utility"))


def discriminative_steps(cand: DataFrame, lab: DataFrame, k: int = 1, clf: ParzenWindow | None = None, gamma: float | None = None) -> DataFrame:
    """Rows (step, id, utility): the discriminator is fitted anew after each pick, which then counts as labelled."""
    out, left, known = [], cand.select("id", "x"), lab.select("id", "x")
    for step in range(1, k + 1):
        row = top_k(discriminative(left, known, clf, gamma), 1).first()
        if row is None:
            break
        out.append((step, row.id, row.utility))
        picks = without(cand.select("id", "x"), [o[1] for o in out])
        known = lab.select("id", "x").unionByName(cand.select("id", "x").join(picks.select("id"), "id", "left_anti"))
        left = picks
    return cand.sparkSession.createDataFrame(out, "step int, id long, utility double")


class Factor:
    """The Cholesky factor L of kernel + diagonal over rows ``x``, in blocks of files in the shared folder.

    Tasks make a column of blocks at a time, each its own block; of a block on the
    diagonal the inverse is kept. No process holds more than a few blocks.
    """

    def __init__(self, spark: SparkSession, x: np.ndarray, ridge: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        self.folder, self.kernel, self.size = new_folder(spark, "factor"), kernel, BLOCK_ROWS
        self.n = -(-len(x) // self.size)
        self.sent = spark.sparkContext.broadcast((x, ridge))
        for k in range(self.n):
            spark.sparkContext.parallelize(range(k, self.n), self.n - k).foreach(lambda i, k=k: self._make(i, k))

    def part(self, i: int) -> slice:
        return slice(i * self.size, (i + 1) * self.size)

    def load(self, i: int, k: int) -> np.ndarray:
        fs, root = pfs.FileSystem.from_uri(self.folder)
        rows = len(self.sent.value[1][self.part(i)])
        with fs.open_input_file(f"{root}/{i}-{k}") as f:
            return np.frombuffer(f.read()).reshape(rows, -1)

    def _make(self, i: int, k: int) -> None:
        x, ridge = self.sent.value
        top = self.kernel(x[self.part(k)], x[self.part(k)]) + np.diag(ridge[self.part(k)])
        own = self.kernel(x[self.part(i)], x[self.part(k)])
        for j in range(k):
            above = self.load(k, j)
            top = top - above @ above.T
            own = own - self.load(i, j) @ above.T if i > k else own
        inverse = np.linalg.inv(np.linalg.cholesky(top))
        fs, root = pfs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        part = f"{root}/{i}-{k}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(np.ascontiguousarray(own @ inverse.T if i > k else inverse).tobytes())
        fs.move(part, f"{root}/{i}-{k}")

    def solve(self, right: Callable[[int], np.ndarray]) -> list[np.ndarray]:
        """L^-1 of a matrix, which ``right`` gives by blocks of rows."""
        out: list[np.ndarray] = []
        for i in range(self.n):
            v = right(i)
            for j in range(i):
                v = v - self.load(i, j) @ out[j]
            out.append(self.load(i, i) @ v)
        return out


def quire(pool: DataFrame, classes: list, lmbda: float = 1.0, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (id, utility): the min-max view of informativeness and representativeness, one class against the rest.

    With L the inverse of the kernel matrix K plus lambda, the least over the
    other rows' labels is in closed form: for a row s and class signs y it is
    y' A^-1 y + (|k' A^-1 y| + 1)^2 / (K_ss + lambda - k' A^-1 k), where A is K plus
    lambda over the labelled rows alone and k their kernels with s. So only A is
    factored, by blocks (:class:`Factor`), and each candidate stands for itself:
    pools of any size. Labelled rows at one place count as one of their mean label.
    """
    from lodestar.operators.pairs import kernels

    spark, k_of = pool.sparkSession, kernel or (lambda a, b: kernels(a, b, "rbf"))
    code = F.array_position(F.array(*map(F.lit, sorted(classes))), F.col("y")) - 1
    rows = pool.select("id", "x", code.alias("c"))
    n = F.count(F.lit(1)).cast("double")
    signs = F.array(*((2 * F.sum((F.col("c") == c).cast("double")) - n) / n for c in range(len(classes))))
    lab = fetched(rows.filter("c is not null").groupBy("x", *([] if lmbda > 0 else ["id"])).agg(F.min("id").alias("i"), n.alias("n"), signs.alias("y")).select("i", "x", "n", "y"))
    m = len(lab["i"])
    y, count = lab["y"].reshape(m, len(classes)), lab["n"]
    factor = Factor(spark, lab["x"], lmbda / count, k_of) if m else None
    vy = factor.solve(lambda i: y[factor.part(i)]) if m else []
    fixed = sum(((v * v).sum(axis=0) for v in vy), ((1 - y * y) * count[:, None] / lmbda).sum(axis=0) if lmbda > 0 else np.zeros(len(classes)))
    sent = spark.sparkContext.broadcast(vy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SOLVE_BYTES // (8 * max(1, m)))
        for b in batches:
            for s in range(0, b.num_rows, step):
                part = b.slice(s, step)
                x = as_arrays(part)["x"]
                left = np.array([k_of(r[None], r[None])[0, 0] for r in x]) + lmbda
                mean = np.zeros((len(classes), len(x)))
                if factor:
                    v = factor.solve(lambda i, x=x: k_of(factor.sent.value[0][factor.part(i)], x))
                    left = left - sum((t * t).sum(axis=0) for t in v)
                    mean = sum(a.T @ t for a, t in zip(sent.value, v, strict=True))
                u = -(fixed[:, None] + (np.abs(mean) + 1) ** 2 / left).max(axis=0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(u)], names=["id", "utility"])

    return rows.filter("c is null").select(F.col("id").cast("long"), "x").mapInArrow(run, "id long, utility double")


def sub_sampled(cand: DataFrame, max_candidates: int | float, strategy: Callable[[DataFrame], DataFrame], seed: int = 0, exclude: bool = False) -> DataFrame:
    """The strategy's utilities of a random subset of the candidates; minus infinity for the others, or no row with ``exclude``."""
    m = max_candidates if isinstance(max_candidates, int) else math.ceil(max_candidates * cand.count())
    drawn = smallest(cand.select("id"), uniform(seed, "id"), m)
    u = strategy(cand.join(drawn, "id", "left_semi")).select("id", F.col("utility").alias("_u"))
    if exclude:
        return u.select("id", F.col("_u").alias("utility"))
    return cand.select("id").join(u, "id", "left").select("id", F.coalesce("_u", F.lit(float("-inf"))).alias("utility"))


def parallel(cand: DataFrame, strategy: Callable[[DataFrame], DataFrame], n_jobs: int) -> DataFrame:
    """The strategy over candidates dealt to n_jobs partitions."""
    return strategy(cand.repartition(n_jobs))
