"""Embedding near-duplicates by randomised-rotation binary codes.

Every distinct vector is turned by one random rotation and kept as the signs of
its coordinates with a correction factor, the inner product of the unit vector
with its code. With the factor, a code gives an unbiased estimate of the inner
product with any other unit vector, and a confidence bound on its error; only
pairs whose upper bound reaches the threshold are recomputed in double precision.

Which pairs are estimated is decided by the codes too. Signs of the coordinates
under one rotation or more are cut into blocks; vectors meet where a block is
equal, as it is or after turning over its bits nearest to zero, and are
candidates if their codes differ in few enough bits. Nothing is fitted and
nothing broadcast: the blocks follow from the number of vectors and the threshold
(see :class:`~lodestar.llm.blocks.Blocks`), and 997 of 1000 pairs at the
threshold meet whatever that number is. The vectors of each component of
candidates then come together, and every pair of them is estimated once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.blocks import Blocks
from lodestar.llm.common import arrow_map, dealt_groups, local_labels, salted_join, scratch, whole_groups, written
from lodestar.llm.components import components
from lodestar.llm.simhash import group_links

#: Half width of the confidence interval, in standard errors of the estimate.
SURE = 3.0
#: Codes of a key, and vectors of a component, that are compared in one turn.
KEY_CHUNK, CHUNK = 1024, 512
ROWS_AT_ONCE = 256


@lru_cache(maxsize=64)
def rotation(dim: int, number: int = 0) -> np.ndarray:
    """A random rotation of all vectors of a dimension."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def codes_of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (True for positive) of the rotated unit vectors, and their correction factors."""
    turned = unit @ rotation(unit.shape[1]).T
    return turned > 0, np.abs(turned).sum(axis=1) / np.sqrt(unit.shape[1])


def estimates(queries: np.ndarray, signs: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of unit query vectors (rows) with coded vectors (columns), and the error bound of each column."""
    dim = queries.shape[1]
    turned = (queries @ rotation(dim).T).astype(np.float32)
    est = turned @ ((2.0 * signs - 1) / (np.sqrt(dim) * factors[:, None])).astype(np.float32).T
    return est, SURE * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / np.sqrt(max(1, dim - 1))


def units(raw: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def votes_of(unit: np.ndarray, bits: int) -> np.ndarray:
    """The first so many coordinates of unit vectors under as many rotations as give them."""
    dim = unit.shape[1]
    return np.concatenate([unit @ rotation(dim, k)[: bits - k * dim].T for k in range(-(-bits // dim))], axis=1)


def coded(reps: DataFrame, blocks: Blocks, kind: str) -> DataFrame:
    """Rows (rep, fp, keys): the code of each vector and the keys under which it meets others of its dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(first, ROWS_AT_ONCE)
                raw, dims = b.column(1).to_pylist(), b.column(2).to_numpy()
                codes: list = [None] * b.num_rows
                keys: list = [None] * b.num_rows
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    votes = votes_of(units([raw[k] for k in at], kind), 64 * blocks.words)
                    own = blocks.keys(votes) ^ (np.uint64(dim) * np.uint64(0x9E3779B97F4A7C15))
                    for k, c, x in zip(at.tolist(), blocks.codes(votes), own.view(np.int64), strict=True):
                        codes[k], keys[k] = c, x
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *keys])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), lists], names=["rep", "fp", "keys"])

    return arrow_map(reps.select("rep", "vec", "dim"), run, "rep long, fp binary, keys array<long>")


def turn_links(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each turn of a component: rows (id, n, root) of vectors with links, n their number, root the smallest id reached."""
    for t, starts in whole_groups(batches, ["key", "lo", "hi"], target=4096):
        get = lambda c: t.column(c).combine_chunks().to_numpy()  # noqa: E731, B023
        ids, mult, side, one, raw = get("id"), get("mult"), get("side"), get("lo") == get("hi"), t.column("vec").to_pylist()
        rows = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            if b - a < 2:
                continue
            v = units(raw[a:b], kind)
            signs, factors = codes_of(v)
            m, s = mult[a:b], side[a:b]
            left = np.arange(b - a) if one[a] else np.flatnonzero(s == 0)
            right = np.arange(b - a) if one[a] else np.flatnonzero(s == 1)
            n, label = np.zeros(b - a, dtype=np.int64), np.arange(b - a)
            for q in range(0, len(left) if len(right) else 0, ROWS_AT_ONCE):
                ask = left[q : q + ROWS_AT_ONCE]
                est, bound = estimates(v[ask], signs[right], factors[right])
                x, y = np.nonzero(est + bound >= threshold)
                if one[a]:
                    x, y = x[ask[x] < right[y]], y[ask[x] < right[y]]
                i, j = ask[x], right[y]
                if len(i) > len(ask) * len(right) // 4:
                    exact = (v[ask] @ v[right].T)[x, y]
                else:
                    exact = np.einsum("ij,ij->i", v[i], v[j])
                i, j = i[exact >= threshold], j[exact >= threshold]
                np.add.at(n, i, m[j])
                np.add.at(n, j, m[i])
                if len(i):
                    label = local_labels(b - a, np.concatenate([np.arange(b - a), i]), np.concatenate([label, j]))
            linked = np.flatnonzero(n)
            if len(linked):
                least = np.full(b - a, np.iinfo(np.int64).max)
                np.minimum.at(least, label, ids[a:b])
                rows.append((ids[a:b][linked], n[linked], least[label[linked]]))
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, dtype=np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["id", "n", "root"])


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """Rows (id, vec, dim): the vector's bytes; null where it is null, zero or holds null or non-finite components."""
    wide = "double" in dict(df.dtypes)[vec_col]
    kind, width = ("<f8", pa.float64()) if wide else ("<f4", pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, dims = [], []
            for x in b.column(1).cast(pa.list_(width)):
                a = x.values
                v = a.to_numpy(zero_copy_only=False) if a is not None and len(a) and a.null_count == 0 else None
                good = v is not None and bool(np.isfinite(v).all()) and bool(v.any())
                out.append((v + 0).astype(kind).tobytes() if good else None)
                dims.append(len(v) if good else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], names=["id", "vec", "dim"])

    return arrow_map(df.select(F.col(id_col).cast("long").alias("id"), vec_col), run, "id long, vec binary, dim int"), kind


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Rows (id_col, n_links, component_id, kept), one for each vector.

    Vectors link if their cosine in double precision is at least ``threshold``
    (0.5 to 1) and they have the same dimension. Links found are exact; a link is
    missed only where its ends meet in no block, or where the estimate errs by
    over ``SURE`` standard errors. Vectors that are null, zero or hold null or
    non-finite components link with nothing and are kept. Repeated rows link with
    each other, with the same id too; an empty table gives no rows; rows without
    an id are an error; other columns are not read.
    """
    with scratch() as keep:
        vectors, kind = valid_vectors(df, id_col, vec_col)
        vectors = keep(written(vectors, "vectors"))
        if vectors.filter("id is null").head(1):
            raise ValueError("a vector has no id")
        reps = written(vectors.filter("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"), F.first("dim").alias("dim")).select("*", F.monotonically_increasing_id().alias("rep")), "distinct")
        blocks = Blocks(reps.count(), threshold)
        codes = written(coded(reps, blocks, kind), "codes")
        met = codes.select(F.explode("keys").alias("key"), "rep", "fp")
        near = components(arrow_map(dealt_groups(met, "key", F.col("rep"), KEY_CHUNK), lambda x: group_links(x, blocks.scheme), "u long, v long"), few=True)
        near = near.select(F.col("node").alias("rep"), F.col("component").alias("key"))
        together = written(reps.join(near, "rep").select("key", F.col("rep").alias("id"), "vec", "mult"), "candidates")
        dealt = dealt_groups(together, "key", F.col("id"), CHUNK)
        found = written(arrow_map(dealt, lambda x: turn_links(x, kind, threshold), "id long, n long, root long"), "turns")
        counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "rep")
        comps = components(found.filter("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
        ends = written(reps.select("vec", "mult", "id", "rep").join(counts, "rep", "left").join(comps, "rep", "left").select("vec", "mult", "id", "n", F.coalesce("component", "rep").alias("class")), "ends")
        least = ends.groupBy("class").agg(F.min("id").alias("component_id"))
        ends = ends.join(least, "class").select("vec", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
        ends = keep(written(ends, "links"))
    linked = salted_join(vectors.filter("vec is not null"), ends, "vec", "mult", F.col("id")).select("id", "n_links", "component_id")
    alone = vectors.filter("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
