"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a grouped minimum and an equi-join, and is written to the shared folder, which then forgets the round
before. No node's neighbours are collected: a hub with a third of all links is pre-aggregated for its minimum, and meets
its links through ``join_hot``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hot, written


def _least(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, v) with ``m``, the least v of u."""
    side = rows.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_hot(rows, "u", side, "at", "n", n)


def _stars(links: DataFrame, n: int) -> DataFrame:
    """Large star, then small star: ``n`` links (u, v), u > v, of the same components, closer to their least nodes."""
    one = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    u, v, m = F.col("u"), F.col("v"), F.col("m")

    def spread(rows: DataFrame, *pairs: Column) -> DataFrame:
        return rows.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v").where("u > v").distinct()

    both = spread_both(links)
    large = spread(_least(both, 2 * n).where("v > u"), one(v, F.least(u, m)))
    return spread(_least(large, n), one(v, m), one(u, m))


def spread_both(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u long, v long; any order, repeats and loops allowed, nulls ignored),
    root being the least node of its component. Roots themselves are in the result; no links give no rows."""
    spark = links.sparkSession
    now = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(spark, now, "links")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == state:
            break
        state = (seen["n"], seen["s"])
        before, now = now, written(spark, _stars(now, seen["n"]), "links")
        forget(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
