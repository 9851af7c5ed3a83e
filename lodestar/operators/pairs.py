"""Every row of one side against all rows of a reference side, reduced on the spot.

No pair is ever a row: batches of the large side are multiplied with blocks of
the reference side in Python, and only the sums, minima or nearest neighbours of
each row come out. A reference side within ``SHIP_BYTES`` is shipped whole. A
larger one is written by the executors as files of that size to the shared
folder; a task reads them one after the other for many of its rows at a time and
merges a row's partial results on the spot. So the large side is read once, its
rows need no key, and nothing of a large reference side goes through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.tables import new_folder

#: Bytes of the reference side that are sent to the executors at once.
SHIP_BYTES = 32 << 20
#: Pairs that are worked on at once.
PAIRS_AT_ONCE = 2_000_000

Side = dict[str, np.ndarray]


def as_arrays(batch: pa.RecordBatch | pa.Table) -> Side:
    """Columns as arrays: lists of numbers as matrices, nulls in numbers as NaN."""
    out: Side = {}
    for name in batch.schema.names:
        c = batch.column(name)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if pa.types.is_list(c.type):
            flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out[name] = flat.reshape(len(c), -1) if len(c) else np.zeros((0, 0))
        else:
            out[name] = c.to_numpy(zero_copy_only=False)
    return out


def fetched(df: DataFrame) -> Side:
    """A side of checked size on the driver, in order of its first column."""
    t = df.toArrow()
    return as_arrays(t.sort_by(t.schema.names[0]) if t.num_rows else t)


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """All distances between the rows of two matrices."""
    if metric in ("euclidean", "sqeuclidean"):
        if a.shape[1] <= 8:
            d = sum((a[:, None, k] - b[None, :, k]) ** 2 for k in range(a.shape[1]))
        else:
            d = np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)
            near = np.argwhere(d < 1e-9 * (1 + (a * a).sum(1)[:, None]))  # cancelled: once more, exactly
            d[near[:, 0], near[:, 1]] = ((a[near[:, 0]] - b[near[:, 1]]) ** 2).sum(1)
        return d if metric == "sqeuclidean" else np.sqrt(d)
    if metric == "manhattan":
        return np.stack([np.abs(x - b).sum(1) for x in a]) if len(a) else np.zeros((0, len(b)))
    if metric == "cosine":
        return 1 - (a @ b.T) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None, :])
    raise ValueError(f"no metric {metric}")


def kernels(a: np.ndarray, b: np.ndarray, name: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 1.0) -> np.ndarray:
    """A named kernel of all pairs; gamma is one over the number of features by default."""
    g = 1.0 / max(1, a.shape[1]) if gamma is None else gamma
    if name == "rbf":
        return np.exp(-g * distances(a, b, "sqeuclidean"))
    if name == "laplacian":
        return np.exp(-g * distances(a, b, "manhattan"))
    if name == "cosine":
        return 1 - distances(a, b, "cosine")
    dot = a @ b.T
    return {"linear": lambda: dot, "poly": lambda: (g * dot + coef0) ** degree, "sigmoid": lambda: np.tanh(g * dot + coef0)}[name]()


class Block:
    """A block of a reference side as the workers get it: broadcast, or a file in the shared folder."""

    def __init__(self, sent=None, path: str | None = None):
        self.sent, self.path = sent, path

    def load(self) -> Side:
        if self.path is None:
            return self.sent.value
        fs, name = pfs.FileSystem.from_uri(self.path)
        with fs.open_input_file(name) as f:
            t = pa.ipc.open_file(f).read_all()
        return as_arrays(t.sort_by(t.schema.names[0]))


def blocks_of(ref: DataFrame) -> list[Block]:
    """The reference side in blocks of at most about ``SHIP_BYTES``; none if it is empty."""
    arrays = [c for c, t in ref.dtypes if t.startswith("array")]
    n, width = ref.agg(F.count(F.lit(1)), F.max(sum((F.size(c) for c in arrays), F.lit(len(ref.columns))))).first()
    if not n:
        return []
    parts = -(-n * width * 8 // SHIP_BYTES)
    spark = ref.sparkSession
    if parts == 1:
        return [Block(spark.sparkContext.broadcast(fetched(ref)))]  # at most SHIP_BYTES
    folder = new_folder(spark, "side")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            fs, root = pfs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            name = f"block-{TaskContext.get().partitionId():06d}"
            part = f"{root}/{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as f, pa.ipc.new_file(f, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            fs.move(part, f"{root}/{name}")  # whole or not at all: tasks that run twice leave one file
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    # Dealt by the hash of all columns, so that a repeated id does not fill a block.
    dealt = ref.repartition(parts, *(F.col(c) for c, t in ref.dtypes if "map" not in t))
    names = sorted(r.name for r in dealt.mapInArrow(write, "name string").collect())  # one row for each file
    return [Block(path=f"{folder}/{name}") for name in names]


def merged(how: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lines of two blocks as one."""
    if how == "concat":
        return np.hstack([a, b])
    if how == "first":
        return np.where((b[:, :1] < a[:, :1]), b, a)
    return {"sum": np.add, "min": np.fmin, "max": np.fmax}[how](a, b)


def against(rows: DataFrame, ref: DataFrame, f: Callable[[Side, Side], np.ndarray], how: str, out: str = "v", empty: list[float] | None = None) -> DataFrame:
    """``rows`` with a column ``out`` of f's numbers for each row, over all of ``ref``.

    f gets a batch of rows and a block of the reference side and returns one
    line of numbers for each row. how: ``sum``, ``min`` or ``max`` (element by
    element), ``first`` (lines of (key, values ...): the line with the least key),
    or ``concat`` (the lines of all blocks one after the other). Without reference rows ``out`` is ``empty``, or null.
    """
    blocks = blocks_of(ref)
    if not blocks:
        line = F.lit(None) if empty is None else F.array(*map(F.lit, map(float, empty)))
        return rows.withColumn(out, line.cast("array<double>"))

    def lines(b: pa.RecordBatch, side: Side) -> np.ndarray:
        n = len(next(iter(side.values())))
        step = max(1, PAIRS_AT_ONCE // max(1, n))
        got = [np.asarray(f(as_arrays(b.slice(s, step)), side), dtype=np.float64) for s in range(0, b.num_rows, step)]
        return np.concatenate(got).reshape(b.num_rows, -1)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray | None] = [None] * len(held)
        for block in blocks:
            side = block.load()
            for k, b in enumerate(held):
                v = lines(b, side)
                found[k] = v if found[k] is None else merged(how, found[k], v)
        for b, v in zip(held, found, strict=True):
            flat = pa.array(v.ravel(), mask=np.isnan(v.ravel()))
            col = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            size += b.nbytes
            if len(blocks) == 1 or size >= SHIP_BYTES:  # the files are read once for so many bytes of rows
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    return rows.mapInArrow(run, rows.withColumn(out, F.lit(None).cast("array<double>")).schema)
