"""Data behind the usual pictures: grids, values carried to a grid, and decision boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.diverse import neighbours


def mesh(spark: SparkSession, bound: list[list[float]], res: int) -> DataFrame:
    """Rows (id, x) of a res x res grid over the bound ((low, low), (high, high))."""
    (x0, y0), (x1, y1) = bound
    at = lambda lo, hi, k: F.lit(float(lo)) + k * ((hi - lo) / max(1, res - 1))
    return spark.range(res * res).select("id", F.array(at(x0, x1, F.col("id") % res), at(y0, y1, F.floor(F.col("id") / res))).alias("x"))


def bounding_box(rows: DataFrame) -> list[list[float]]:
    r = rows.agg(*(f(F.col("x")[k]) for f in (F.min, F.max) for k in (0, 1))).first()
    return [[r[0], r[1]], [r[2], r[3]]]


def nearest_value(grid: DataFrame, samples: DataFrame, value: str = "value") -> DataFrame:
    """Grid rows with the value of the nearest sample (id, x, value)."""
    got = neighbours(grid.select("id", "x"), samples.select("id", "x", F.col(value).cast("double").alias("v")), 1, ["v"])
    return got.select("id", "x", F.get(F.get("nn", F.lit(0)), F.lit(2)).alias(value))


def decision_boundary(probas: DataFrame, n_classes: int) -> DataFrame:
    """Rows (id, class, value): a class's probability against the best other; one half on the boundary."""
    rows = probas.select("id", "p", F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("class"))
    own = F.col("p")[F.col("class")]
    best = F.array_max(F.transform("p", lambda v, k: F.when(k == F.col("class"), float("-inf")).otherwise(v)))
    return rows.select("id", "class", F.when(own + best > 0, own / (own + best)).otherwise(0.5).alias("value"))


def stream_lines(rows: DataFrame, key: str | None = None, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Rows ([key,] t, x, y, queried, last, current): for each item of a stream of one feature the line from its time to the end.

    rows: (x, y, queried, the order's columns). ``t`` counts items from 0, ``last`` is the
    place of the newest one, and ``current`` marks it; ``y`` is null where nothing was queried.
    """
    keys = [key] if key else []
    w = Window.partitionBy(*keys)
    place = (F.row_number().over(w.orderBy(*order)) - 1).alias("t")
    numbered = rows.select(*keys, place, "x", F.when(F.col("queried"), F.col("y")).alias("y"), "queried")
    return numbered.withColumn("last", F.max("t").over(w)).withColumn("current", F.col("t") == F.col("last"))


def stream_boundary(rows: DataFrame, clf, plot_step: int, res: int = 25, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """Rows (t, id, x, pred): what the classifier predicts on a line of features after every ``plot_step`` items of the stream.

    rows: (id, x array of one feature, y, w, the order's columns); the classifier
    learns from the items up to that time that have a label.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("_t", F.row_number().over(Window.orderBy(*order)))  # a picture's stream
    low, high, n = numbered.agg(F.min(F.col("x")[0]), F.max(F.col("x")[0]), F.max("_t")).first()
    line = spark.range(res).select("id", F.array(F.lit(low) + F.col("id") * ((high - low) / max(1, res - 1))).alias("x"))
    out = None
    for t in range(plot_step, (n or 0) + 1, plot_step):
        part = clf.predict(clf.probas(line, numbered.filter((F.col("_t") <= t) & F.col("y").isNotNull()))).select(F.lit(t).alias("t"), "id", F.col("x")[0].alias("x"), "pred")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else line.select(F.lit(0).alias("t"), "id", F.col("x")[0].alias("x"), F.lit(None).alias("pred")).limit(0)
