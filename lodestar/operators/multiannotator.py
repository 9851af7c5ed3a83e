"""Annotators: how well they do, and which of them to ask about which row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.labels import majority_vote
from lodestar.functions.rng import uniform
from lodestar.functions.selection import DIGITS


def t_quantile(q: float, df: int) -> float:
    """Student t quantile."""
    import numpy as np

    from lodestar.operators.regressors import _t_quantile

    return float(_t_quantile(np.array([float(df)]), q)[0])


def interval_estimation(annotations: DataFrame, classes: list, alpha: float = 0.05, mode: str = "upper") -> DataFrame:
    """Rows (annotator, n, mean, perf): share of agreement with the majority, with one right and one wrong answer added, and a bound of its confidence interval.

    annotations: rows (id, annotator, y), missing answers null. mode: lower, mean or upper.
    """
    truth = majority_vote(annotations.select("id", F.col("y").alias("label")), classes).withColumnRenamed("label", "truth")
    joined = annotations.select("id", "annotator", "y").join(truth, "id")
    right = F.when(F.col("y").isNotNull() & F.col("truth").isNotNull(), (F.col("y") == F.col("truth")).cast("double"))
    per = joined.groupBy("annotator").agg((F.count(right) + 2).alias("n"), ((F.coalesce(F.sum(right), F.lit(0.0)) + 1) / (F.count(right) + 2)).alias("mean"))
    # correctness is 0 or 1: its variance is mean * (1 - mean)
    half = F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("n"))
    if mode == "mean":
        return per.withColumn("perf", F.col("mean"))
    sizes = [r[0] for r in per.select("n").distinct().collect()]  # one row an annotator at most
    t = F.lit(0.0)
    for n in sizes:
        t = F.when(F.col("n") == n, abs(t_quantile(alpha / 2, int(n) - 1))).otherwise(t)
    return per.withColumn("perf", F.col("mean") + (1 if mode == "upper" else -1) * t * half)


def interval_threshold(utilities: DataFrame, perf: DataFrame, available: DataFrame | None = None, epsilon: float = 0.9, batch_size: int | None = None) -> DataFrame:
    """Rows (step, id, annotator, utility): pairs by the rank of the row's uncertainty, then by the annotator's performance.

    Rows for which not all annotators are available are left out. Without
    ``batch_size`` as many pairs as there are annotators near the best.
    """
    ranked = ranks(utilities)
    if available is not None:
        n = perf.count()
        full = available.filter("available").groupBy("id").agg(F.countDistinct("annotator").alias("n")).filter(F.col("n") == n).select("id")
        ranked = ranked.join(full, "id", "left_semi")
    top = perf.agg(F.max("perf").alias("m")).first().m or 0.0
    if batch_size is None:
        batch_size = max(1, perf.filter(F.col("perf") >= epsilon * top).count())
    u = F.col("rank") * (top + 2) + F.col("perf") + 1
    pairs = ranked.join(F.broadcast(perf.select("annotator", "perf")), F.lit(True)).select("id", "annotator", u.alias("utility"))  # one row an annotator
    order = [F.round("utility", DIGITS).desc(), F.col("id"), F.col("annotator")]
    return pairs.orderBy(*order).limit(batch_size).withColumn("step", F.row_number().over(Window.orderBy(*order)))


def ranks(utilities: DataFrame) -> DataFrame:
    """Rows (id, rank): ordinal ranks of utilities, the least first, over all rows.

    The rank of a row is that within its range partition plus the rows of the
    partitions below, so no task sees all rows.
    """
    rows = utilities.select("id", F.round("utility", DIGITS).alias("u")).filter("u is not null")
    dealt = rows.repartitionByRange(F.col("u"), F.col("id").desc()).sortWithinPartitions("u", F.desc("id")).withColumn("_p", F.spark_partition_id()).persist()
    sizes = {r[0]: r[1] for r in dealt.groupBy("_p").count().collect()}  # one row a partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    base = F.lit(0)
    for p, n in before.items():
        base = F.when(F.col("_p") == p, n).otherwise(base)
    within = F.row_number().over(Window.partitionBy("_p").orderBy("u", F.desc("id")))
    return dealt.withColumn("rank", within + base).select("id", "rank")


def single_annotator(utilities: DataFrame, annotators: DataFrame, available: DataFrame | None = None, batch_size: int = 1, per_sample: int = 1, perf: str | None = None, seed: int = 0) -> DataFrame:
    """Rows (step, id, annotator): the best rows in order, each with its best available annotators, until the batch is full.

    annotators: rows (annotator[, perf]); without a performance annotators are drawn.
    """
    grade = F.col(perf) if perf else uniform(seed, "id", "annotator")
    best = utilities.filter("utility is not null").orderBy(F.round("utility", DIGITS).desc(), "id").limit(batch_size)
    order = Window.orderBy(F.round("utility", DIGITS).desc(), "id")
    picked = best.withColumn("place", F.row_number().over(order))  # batch_size rows
    pairs = picked.join(F.broadcast(annotators), F.lit(True))  # one row an annotator
    if available is not None:
        pairs = pairs.join(available.filter("available").select("id", "annotator"), ["id", "annotator"], "left_semi")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.round(grade, DIGITS).desc(), "annotator")))
    full = Window.orderBy(F.when(F.col("r") <= per_sample, 0).otherwise(F.col("r")), "place", "r")
    return pairs.withColumn("step", F.row_number().over(full)).filter(F.col("step") <= batch_size).select("step", "id", "annotator")


class SingleAnnotatorStrategy:
    """A strategy for one annotator, asked for pairs of a row and an annotator.

    The annotations become one label a row by ``aggregate``, a function from rows
    (id, annotator, y) to rows (id, y); by default the majority of the classes,
    null where nobody answered.
    """

    def __init__(self, strategy, classes: list, aggregate: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0):
        self.strategy, self.seed = strategy, seed
        self.aggregate = aggregate or (lambda a: majority_vote(a.select("id", F.col("y").alias("label")), classes).withColumnRenamed("label", "y"))

    def pool(self, rows: DataFrame, annotations: DataFrame) -> DataFrame:
        """Rows (id, x, y, w): the rows (id, x[, w]) with their aggregated labels."""
        w = F.coalesce("w", F.lit(1.0)) if "w" in rows.columns else F.lit(1.0)
        return rows.select("id", "x", w.alias("w")).join(self.aggregate(annotations).select("id", "y"), "id", "left").select("id", "x", "y", "w")

    def query(self, rows: DataFrame, annotations: DataFrame, candidates=None, annotators: DataFrame | Sequence | None = None, available: DataFrame | None = None, batch_size: int = 1, per_sample: int = 1, perf: str | None = None, return_utilities: bool = False):
        """Rows (step, id, annotator); with ``return_utilities`` also rows (id, utility) of all candidates.

        annotators: those who may be asked, by default all in the annotations, as a
        list or as rows (annotator[, perf]). Pairs that hold an answer already are
        not asked again, nor those that ``available`` (id, annotator, available) says no to.
        """
        spark = rows.sparkSession
        pool = self.pool(rows, annotations)
        if candidates is None:
            full = annotations.filter("y is null").select("id").distinct()
            candidates = pool.join(full, "id", "left_semi").select("id", "x", "w")
        who = annotations.select("annotator").distinct() if annotators is None else annotators if isinstance(annotators, DataFrame) else spark.createDataFrame([(a,) for a in annotators], annotations.select("annotator").schema)
        open_pairs = annotations.withColumn("available", F.col("y").isNull()).select("id", "annotator", "available")
        if available is not None:
            open_pairs = open_pairs.join(available.filter("available").select("id", "annotator"), ["id", "annotator"], "left_semi")
        scored = self.strategy.utilities(pool, candidates).persist()
        asked = scored.join(open_pairs.filter("available").select("id").distinct(), "id", "left_semi")
        got = single_annotator(asked, who, open_pairs, batch_size, per_sample, perf, self.seed)
        return (got, scored) if return_utilities else got
