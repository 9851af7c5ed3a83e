"""Labels: missing or not, encoded, voted on and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING_LABEL = None


def is_unlabeled(col: str, missing: object = MISSING_LABEL, kind: str = "") -> Column:
    """True where a label is null, NaN (floating columns) or the sentinel."""
    out = F.col(col).isNull()
    if kind in ("double", "float"):
        out = out | F.isnan(col)
    return out if missing is None else out | F.coalesce(F.col(col) == F.lit(missing), F.lit(False))


def is_labeled(col: str, missing: object = MISSING_LABEL, kind: str = "") -> Column:
    return ~is_unlabeled(col, missing, kind)


def labeled_indices(df: DataFrame, label: str, *ids: str) -> DataFrame:
    """The ids (or id pairs) of rows with a label."""
    return df.filter(is_labeled(label, kind=dict(df.dtypes)[label])).select(*ids)


def unlabeled_indices(df: DataFrame, label: str, *ids: str) -> DataFrame:
    return df.filter(is_unlabeled(label, kind=dict(df.dtypes)[label])).select(*ids)


def check_missing_label(missing: object, kind: str) -> None:
    """A sentinel must fit the labels' column type; null fits all."""
    fits = {"string": str, "double": int | float, "float": int | float, "int": int | float, "bigint": int | float, "boolean": bool}
    if missing is not None and not isinstance(missing, fits.get(kind, object)):
        raise TypeError(f"{missing!r} can't stand for a missing label of type {kind}")


def check_equal_missing_label(a: object, b: object) -> None:
    both_nan = isinstance(a, float) and isinstance(b, float) and a != a and b != b
    if not (both_nan or type(a) is type(b) and a == b):
        raise ValueError(f"missing labels differ: {a!r} and {b!r}")


class LabelEncoder:
    """Sorted classes to codes 0, 1, ... and back; missing labels stay null."""

    def __init__(self, classes: list):
        self.classes = sorted(classes)

    @classmethod
    def fit(cls, df: DataFrame, label: str) -> LabelEncoder:
        return cls([r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().collect()])  # one row a class

    def transform(self, label: str) -> Column:
        """The code; a label that is no class is an error when the row is computed."""
        at = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label))
        return F.when(F.col(label).isNull(), None).when(at == 0, F.raise_error(F.lit("unknown class"))).otherwise((at - 1).cast("int"))

    def inverse(self, code: str) -> Column:
        return F.element_at(F.array(*map(F.lit, self.classes)), F.col(code) + 1)


def vote_vectors(df: DataFrame, classes: list, id_col: str = "id", label: str = "label", weight: str | None = None) -> DataFrame:
    """Rows (id, votes array<double>): for each row the weight of its labels of each class; missing labels and weights count nothing."""
    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    votes = [F.sum(F.when(F.col(label) == F.lit(c), w).otherwise(0.0)) for c in sorted(classes)]
    return df.groupBy(id_col).agg(F.array(*votes).alias("votes"))


def majority_vote(df: DataFrame, classes: list, id_col: str = "id", label: str = "label", weight: str | None = None, seed: int | None = None) -> DataFrame:
    """Rows (id, label): the class with most weight; ties by the first class, or by hash with a seed; null without any vote."""
    known = sorted(classes)
    v = vote_vectors(df, known, id_col, label, weight)
    pairs = F.array(*(F.struct(F.col("votes")[k].alias("n"), (F.lit(-k) if seed is None else F.xxhash64(F.lit(seed), id_col, F.lit(k))).alias("t"), F.lit(c).alias("c")) for k, c in enumerate(known)))
    best = F.array_max(pairs)
    return v.select(id_col, F.when(best["n"] > 0, best["c"]).alias(label))


def confusion(df: DataFrame, classes: list, truth: str = "truth", pred: str = "label", annotator: str = "annotator", normalize: str | None = None) -> DataFrame:
    """Rows (annotator, truth, pred, value): a confusion matrix for each annotator, as counts or shares of true rows, predicted columns or all.

    Missing predictions are skipped; where nothing was counted the shares are equal.
    """
    spark = df.sparkSession
    known = spark.createDataFrame([(c,) for c in sorted(classes)], "c " + dict(df.dtypes)[truth])
    grid = df.select(annotator).distinct().join(F.broadcast(known.select(F.col("c").alias("truth")))).join(F.broadcast(known.select(F.col("c").alias("pred"))))  # classes squared
    n = df.filter(F.col(pred).isNotNull() & F.col(truth).isNotNull()).groupBy(annotator, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    full = grid.join(n, [annotator, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    if normalize is None:
        return full.select(annotator, "truth", "pred", F.col("n").alias("value"))
    by = {"true": [annotator, "truth"], "pred": [annotator, "pred"], "all": [annotator]}[normalize]
    s = F.sum("n").over(Window.partitionBy(*by))
    none = 1.0 / len(classes) ** (2 if normalize == "all" else 1)
    return full.select(annotator, "truth", "pred", F.when(s > 0, F.col("n") / s).otherwise(none).alias("value"))
