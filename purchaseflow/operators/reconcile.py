"""Comparing two sides of a replicated table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence(name: str, source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row: source rows, distinct target ids, source ids missing in the target, OK or MISSING."""
    ids = source.select(F.col(key).cast("string").alias("k"))
    here = target.select(F.col(key).cast("string").alias("k")).distinct()
    lost = ids.join(here, "k", "left_anti")
    return in_one_row(name, source_rows=ids, target_ids=here, missing=lost).withColumn("state", F.when(F.col("missing") > 0, "MISSING").otherwise("OK"))


def in_one_row(name: str, **tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table, under its keyword."""
    counts = [df.agg(*((F.count(F.lit(1)) if k == c else F.lit(0).cast("long")).alias(c) for c in tables)) for k, df in tables.items()]
    return stacked(counts).agg(*(F.sum(c).alias(c) for c in tables)).select(F.lit(name).alias("table_name"), *tables)


def stacked(reports: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def two_sides(name: str, source: DataFrame, target: DataFrame, key: str, sums: Sequence[str]) -> DataFrame:
    """One row: ids on each side, live rows, missing and extra ids, exact sums over live rows, MATCH or MISMATCH."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(F.col(key).alias("k"), F.lit(1).alias(f"in_{tag}"), (1 - F.col("is_deleted")).alias(f"live_{tag}"), *(F.when(F.col("is_deleted") == 0, F.col(c)).cast("decimal(38,9)").alias(f"{tag}_{c}") for c in sums))

    both = side(source, "a").join(side(target, "b"), "k", "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    out = both.agg(
        F.count("in_a").alias("ids_a"), F.count("in_b").alias("ids_b"), F.coalesce(F.sum("live_a"), F.lit(0)).alias("live_a"), F.coalesce(F.sum("live_b"), F.lit(0)).alias("live_b"),
        count(F.col("in_b").isNull()).alias("missing"), count(F.col("in_a").isNull()).alias("extra"),
        *(F.coalesce(F.sum(f"{t}_{c}"), F.lit(0).cast("decimal(38,9)")).alias(f"sum_{t}_{c}") for c in sums for t in "ab"),
    )
    same = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("live_a") == F.col("live_b"))
    for c in sums:
        same = same & (F.col(f"sum_a_{c}") == F.col(f"sum_b_{c}"))
    return out.select(F.lit(name).alias("table_name"), "*", F.when(same, "MATCH").otherwise("MISMATCH").alias("state"))


def checksum(name: str, rows: DataFrame) -> DataFrame:
    """Order-independent checksum: rows, and the exact sum of 60 bits of MD5 over each whole row as text (null: ``~``),
    which any engine can compute."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rows.columns))
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(bits), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum")).select(F.lit(name).alias("table_name"), "*")


def probe(name: str, rows: DataFrame, column: str, amount: str, latest: str) -> DataFrame:
    """One row of scalars: rows, rows with ``column``, sum of ``amount``, greatest ``latest`` as text."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_known"), F.sum(F.col(amount).cast("decimal(38,4)")).cast("double").alias("total"), F.max(latest).cast("string").alias("latest")).select(F.lit(name).alias("table_name"), "*")


def distinct_exact(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count_distinct(column).alias("n_distinct"))


def copies(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The distinct rows of tables with the same columns, with ``n_0``, ``n_1``, ...: how often each table has them.

    All tables are dealt by ``keys`` once; what is grouped by these afterwards needs no other shuffle.
    """
    names = tables[0].columns
    each = reduce(DataFrame.unionByName, (rows.withColumn("_table", F.lit(k)) for k, rows in enumerate(tables)))
    return each.repartition(*keys).groupBy(*names).agg(*(F.count_if(F.col("_table") == k).alias(f"n_{k}") for k in range(len(tables))))
