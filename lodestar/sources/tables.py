"""Readers and sinks of pools, annotations and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one is set only where the session has none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(base)
    base = base if "://" in base else "file://" + base.removeprefix("file:")
    return f"{base.rstrip('/')}/lodestar-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that what reads it more than once does not work it out again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doubles(col: str) -> Column:
    """An array column as doubles, before any arithmetic."""
    return F.col(col).cast("array<double>")


def nan_to_null(col: str) -> Column:
    """NaN labels and utilities are nulls here."""
    return F.when(~F.isnan(col), F.col(col))


def pool(df: DataFrame, id_col: str, x: Column, y: Column, weight: Column | None = None) -> DataFrame:
    """Rows (id, x array<double>, y, w): the pool's schema; y is null where a label is missing."""
    w = F.lit(1.0) if weight is None else F.coalesce(weight, F.lit(1.0))
    return df.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x"), y.alias("y"), w.cast("double").alias("w"))


def blobs(spark: SparkSession, n: int, centres: int = 3, dim: int = 2, seed: int = 0, spread: float = 1.0) -> DataFrame:
    """Rows (id, x, y): points around random centres, from hashes of the row's number."""
    from lodestar.functions.rng import normal, uniform

    x = [20 * uniform(seed, F.lit(d), F.col("y")) - 10 + spread * normal(seed + 1, F.lit(d), F.col("id")) for d in range(dim)]
    return spark.range(n).withColumn("y", (F.col("id") % centres).cast("int")).select("id", F.array(*x).alias("x"), "y")


def save(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.format(fmt).mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(path)


def update_labels(df: DataFrame, answers: DataFrame) -> DataFrame:
    """The pool with new labels (id, y) of an oracle filled in where labels are missing."""
    new = answers.select("id", F.col("y").alias("_new"))
    return df.join(new, "id", "left").withColumn("y", F.coalesce("y", "_new")).drop("_new")
