"""Choosing rows by utility: greedy batches, proportional draws, merged rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.rng import gumbel, uniform

#: Utilities equal to so many digits tie, whatever machine computed them.
DIGITS = 9


def _ties(seed: int | None, *keys: str) -> list[Column]:
    """What decides ties: the ids, or a hash of seed and ids."""
    return [F.col(k) for k in keys] if seed is None else [F.xxhash64(F.lit(seed), *keys), *map(F.col, keys)]


def top_k(df: DataFrame, k: int, utility: str = "utility", id_col: str = "id", seed: int | None = None) -> DataFrame:
    """The k rows of largest utility with their ``step`` (1, 2, ...); nulls never, fewer rows if there are fewer."""
    order = [F.round(utility, DIGITS).desc(), *_ties(seed, id_col)]
    best = df.filter(F.col(utility).isNotNull()).orderBy(*order).limit(k)
    return best.withColumn("step", F.row_number().over(Window.orderBy(*order)))


def rand_argmax(df: DataFrame, utility: str = "utility", id_col: str = "id", group: str | None = None, seed: int | None = None, least: bool = False) -> DataFrame:
    """The row of largest (or least) utility, of each group if there is one; nulls never."""
    v = F.round(utility, DIGITS)
    key = F.struct((v if least else -v).alias("v"), *(c.alias(f"t{i}") for i, c in enumerate(_ties(seed, id_col))))
    rows = df.filter(F.col(utility).isNotNull())
    out = F.min_by(F.struct(id_col, utility), key).alias("_b")
    best = (rows.groupBy(group) if group else rows.groupBy()).agg(out).filter("_b is not null")
    return best.select(*([group] if group else []), f"_b.{id_col}", f"_b.{utility}")


def simple_batch(df: DataFrame, k: int, utility: str = "utility", id_col: str = "id", seed: int | None = None) -> DataFrame:
    """Rows (step, id, utility, picked): for each step all utilities, null for what was picked before."""
    picks = top_k(df, k, utility, id_col, seed).select(F.col(id_col).alias("_id"), F.col("step").alias("_step"))
    steps = picks.select(F.col("_step").alias("step"))
    full = df.select(id_col, utility).join(F.broadcast(picks), F.col(id_col) == F.col("_id"), "left")  # k rows
    grid = full.join(F.broadcast(steps), F.lit(True))
    u = F.when(F.col("_step").isNull() | (F.col("_step") >= F.col("step")), F.col(utility))
    return grid.select("step", id_col, u.alias(utility), F.coalesce(F.col("_step") == F.col("step"), F.lit(False)).alias("picked"))


def proportional(df: DataFrame, k: int, utility: str = "utility", id_col: str = "id", seed: int = 0) -> DataFrame:
    """k rows drawn without replacement with chances in proportion to the utility; zero only after all others."""
    w = F.col(utility)
    key = F.when(w > 0, F.log(w) + gumbel(seed, id_col)).otherwise(F.lit(-1e300) * uniform(seed, id_col))
    order = [F.desc("_key"), F.col(id_col)]
    best = df.filter(w.isNotNull()).withColumn("_key", key).orderBy(*order).limit(k)
    return best.withColumn("step", F.row_number().over(Window.orderBy(*order))).drop("_key")


def smallest(df: DataFrame, key: Column, n: int, id_col: str = "id", bins: int = 4096) -> DataFrame:
    """The n rows of smallest ``key``, a column of uniform numbers from 0 to 1, whatever n is.

    The bin that holds the n-th row is found by counts; only its rows are sorted.
    """
    rows = df.withColumn("_k", key).withColumn("_b", F.least(F.floor(F.col("_k") * bins), F.lit(bins - 1)).cast("int"))
    left, cut = n, bins
    for b, c in sorted((r[0], r[1]) for r in rows.groupBy("_b").count().collect()):  # at most ``bins`` rows
        if c > left:
            cut = b
            break
        left -= c
    below = rows.filter(F.col("_b") < cut)
    edge = rows.filter(F.col("_b") == cut).orderBy("_k", id_col).limit(left)
    return below.unionAll(edge).drop("_k", "_b")


def value_ranks(df: DataFrame, value: str, method: str = "dense", per: str | None = None) -> DataFrame:
    """Rows ([per,] _v, _r): the rank of each distinct value, the least first; for ``ordinal`` that of the first row that has it.

    Distinct values with their counts are dealt by range; a value's rank is that
    within its partition plus what the partitions below hold, so no task sees all.
    With ``per`` the ranks are those within its groups.
    """
    keys = [per] if per else []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    size = F.lit(1) if method == "dense" else F.col("_n")
    if per:
        below = F.coalesce(F.sum(size).over(Window.partitionBy(per).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = counts.withColumn("_below", below)
    else:
        dealt = counts.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()).persist()
        sizes = dict(sorted((r[0], r[1]) for r in dealt.groupBy("_p").agg(F.sum(size)).collect()))  # one row a partition
        base, total = F.lit(0), 0
        for p, n in sizes.items():
            base, total = F.when(F.col("_p") == p, total).otherwise(base), total + n
        below = F.coalesce(F.sum(size).over(Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = dealt.withColumn("_below", below + base)
    rank = {"dense": F.col("_below") + 1, "min": F.col("_below") + 1, "ordinal": F.col("_below") + 1, "max": F.col("_below") + F.col("_n"), "average": F.col("_below") + (F.col("_n") + 1) / 2}[method]
    return out.select(*keys, "_v", rank.alias("_r"))


def combine_ranking(df: DataFrame, *rankings: str, method: str = "dense", out: str = "rank", per: str | None = None, id_col: str | None = None) -> DataFrame:
    """Merged rankings: the rank of the first plus the sigmoid of the next, from left to right; nulls stay null.

    method: dense, min, max, average, or ordinal, where equal values are told apart
    by ``id_col`` (``id`` where there is one, else by a hash of the row). ``per``: a column, such as a batch's number, within whose groups is ranked.
    """
    df = df.withColumn(out, F.col(rankings[0]).cast("double"))
    id_col = id_col or ("id" if "id" in df.columns else None)
    keys = [per] if per else []
    for nxt in rankings[1:]:
        ranks = value_ranks(df, out, method, per).withColumnRenamed("_v", "_w")
        if per:
            ranks = ranks.withColumnRenamed(per, "_per")
        met = (F.col(out) == F.col("_w")) & (F.col(per).eqNullSafe(F.col("_per")) if per else F.lit(True))
        df = df.join(ranks, met, "left").drop("_w", "_per")
        if method == "ordinal":
            order = [F.col(id_col)] if id_col else [F.xxhash64(*df.columns)]
            df = df.withColumn("_r", F.when(F.col(out).isNotNull(), F.col("_r") + F.row_number().over(Window.partitionBy(*keys, out).orderBy(*order)) - 1))
        df = df.withColumn(out, F.col("_r") + 1 / (1 + F.exp(-F.col(nxt)))).drop("_r")
    return df
