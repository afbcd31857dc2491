"""Connected components of a link table, by alternating large-star and small-star steps.

Links never leave the executors. Every step is a map-side combined aggregation and a join on
the node; results are cut into the shared checkpoint folder, so lost executors cost
a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of u is tied to u's least neighbour, or to u if that is less. Nodes
    of very many links (hubs) end here: the least nodes are dealt by a key of their own, so that
    both sides of the join have an exchange and adaptive execution can split a hub's rows."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("w"), "m")
    tied = both.filter("v > u").join(least, F.col("u") == F.col("w"))
    return tied.select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every lesser neighbour of u, and u itself, is tied to u's least neighbour. After a large
    star a node has few lesser neighbours, so there are no hubs here."""
    least = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return least.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node), for every node of ``links`` (a, b: not null)."""
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") != F.col("b")).distinct())
    before = None
    for _ in range(most_rounds):
        mark = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("a").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or mark.n == 0:
            break
        before = mark
        links = cut(_small_star(_large_star(links)))
    else:
        raise RuntimeError("components did not converge")
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
