"""Shared folders, written tables and Arrow helpers of the text operators."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of column data that one Arrow batch may hold on its way to Python.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder is set only where the session has none, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"


_open_scratches: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, tables made by :func:`written` are for the time being: they are deleted at its end, but for those given to what it yields.

    A result that leaves must read nothing else of them.
    """
    own: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not df]
        if len(_open_scratches) > 1:
            _open_scratches[-2].append(df)
        return df

    _open_scratches.append(own)
    try:
        yield keep
    finally:
        _open_scratches.remove(own)
        for df in own:
            dropped(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if _open_scratches:
        _open_scratches[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that is no longer read."""
    spark, path = df.sparkSession, df._written_path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pfs.FileSystem, str]:
    return pfs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def put(uri: str, data: bytes) -> None:
    """Write a file whole or not at all: tasks that run twice leave one file."""
    fs, path = open_fs(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def id_bucket(col: str, n: int):
    """crc32 of the id as text, mod n; a null id counts as no text, which gives 0."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null gives empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()
    return [x or b"" for x in column.cast(binary).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], target: int = 50_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by ``keys``, with the starts of the groups in each.

    At least ``target`` rows a table where there are as many, to work on many small groups at once.
    """

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).combine_chunks()
            v = v.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= target:
            t = pa.Table.from_batches(held)
            s = starts(t)
            if len(s) > 1:
                yield t.slice(0, s[-1]), s[:-1]
                held, rows = t.slice(s[-1]).to_batches(), t.num_rows - int(s[-1])
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts(t)


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes with links i-j: the smallest node reachable from each."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def salted_join(many: DataFrame, one: DataFrame, key: str, n: str, member, size: int = 100_000) -> DataFrame:
    """``many.join(one, key)`` where ``one`` has each key once, with the number ``n`` of rows that it meets; ``n`` is dropped.

    Keys of more than ``size`` rows are split among as many tasks as that takes:
    by the hash of ``member`` in ``many``, and repeated in ``one``. Their list is
    written first, so that Spark knows its size when it chooses how to join it.
    """
    parts = F.ceil(F.col(n) / F.lit(size)).cast("int")
    hot = written(one.filter(F.col(n) > size).select(key, parts.alias("_c")), "hot")
    salt = F.when(F.col("_c").isNull(), 0).otherwise(F.pmod(F.xxhash64(member, F.lit(5)), F.col("_c"))).cast("int")
    left = many.join(hot, key, "left").withColumn("_salt", salt).drop("_c")
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))))).drop(n)
    return left.join(right, [key, "_salt"]).drop("_salt")


def chunk_count(n, size: int = 1024):
    """Column: into how many chunks a group of n rows is dealt.

    Groups are compared chunk by chunk, each pair of chunks in a task's turn of
    its own. Chunks hold up to ``size`` rows; from 16 chunks on their number grows
    with the square root of the group, so that the copies sent stay few.
    """
    few = F.ceil(n / F.lit(size))
    return F.when(few <= 16, few).otherwise(F.greatest(F.lit(16), F.ceil(F.sqrt(n * F.lit(16.0 / size))))).cast("int")


def dealt_groups(df: DataFrame, key: str, member, size: int = 1024, weight=None) -> DataFrame:
    """Rows with the turn (``lo``, ``hi``) in which the rows of their key are compared; rows that are alone in a key may stay.

    ``member``: column whose hash chooses a row's chunk. Only keys of more than
    ``size`` rows (or a sum of ``weight`` beyond it) are dealt in chunks: a row of
    chunk a gets one row for each chunk b; ``side`` is 0 for rows of chunk ``lo``,
    1 for ``hi``. All others have one turn and are moved once. The hot keys are
    written, so that Spark knows their size when it chooses how to join them.
    Sorted by (key, lo, hi) within partitions.
    """
    hot = written(df.groupBy(key).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n")).filter(F.col("_n") > size), "hot")
    x = df.join(hot, key, "left").withColumn("_c", F.when(F.col("_n").isNull(), 1).otherwise(chunk_count(F.col("_n"), size)))
    x = x.withColumn("_a", F.when(F.col("_c") > 1, F.pmod(F.xxhash64(member, F.lit(7)), F.col("_c"))).otherwise(0).cast("int"))
    x = x.withColumn("_b", F.explode(F.expr("sequence(0, _c - 1)")))
    x = x.withColumn("lo", F.least("_a", "_b")).withColumn("hi", F.greatest("_a", "_b")).withColumn("side", (F.col("_a") != F.col("lo")).cast("int"))
    x = x.drop("_n", "_c", "_a", "_b")
    return x.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")
