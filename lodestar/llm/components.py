"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """As a small star, for links of which each node has a bounded number to smaller ones: its least neighbour gets all its others."""
    least = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return least.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).filter("u > v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", few: bool = False) -> DataFrame:
    """Rows (node, component) for each node with a link to another; component is the smallest node reachable.

    ``few``: every node has a bounded number of links to smaller ones, such as
    one for each of its keys; then most of them are contracted before the rounds.

    Links are undirected; repeated links, self-links and links with a null end
    (both ignored) may occur; no links give an empty table. Every round is
    written to the shared folder, and nothing but two sums comes to the driver.
    """
    e = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v"), F.col(u).isNull().alias("_n"), F.col(v).isNull().alias("_m"))
    e = e.filter("u > v and not _n and not _m").select("u", "v").distinct()
    e = written(_contracted(e) if few else e, "links")
    print_of = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    last = None
    while True:
        new = written(_small_star(_large_star(e)), "links")
        dropped(e)
        e = new
        now = tuple(e.select(print_of).first()[0])
        if now == last or not now[0]:
            break
        last = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
