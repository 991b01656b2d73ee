"""One-off corrections: time stamps stored in the wrong zone, junk rows, migration of old snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bulk_minutes(rows: DataFrame, column: str, least: int = 20) -> DataFrame:
    """Minutes in which at least so many rows were created: loads by machine, not by people."""
    return rows.groupBy(F.date_trunc("minute", column).alias("minute")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def shift(rows: DataFrame, column: str, hours: int = 7, least: int = 20) -> DataFrame:
    """Rows with ``shifted``: the time moved by ``hours``, but for rows of bulk minutes."""
    bulk = bulk_minutes(rows, column, least).select("minute", F.lit(True).alias("is_bulk"))
    out = rows.withColumn("minute", F.date_trunc("minute", column)).join(bulk, "minute", "left").withColumn("is_bulk", F.coalesce("is_bulk", F.lit(False)))
    moved = F.col(column) + F.expr(f"INTERVAL {hours} HOURS")
    return out.withColumn("shifted", F.when(F.col("is_bulk"), F.col(column)).otherwise(moved)).drop("minute")


def hour_histogram(rows: DataFrame, column: str) -> DataFrame:
    """One row: hour:count pairs in order of hours."""
    hours = rows.groupBy(F.hour(column).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return hours.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "c"))), lambda x: F.concat(x["h"].cast("string"), F.lit(":"), x["c"].cast("string"))), " ").alias("histogram"))


def junk(rows: DataFrame, en: str, cn: str, known: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a known junk name, or without an English name and with a Chinese one of under two letters."""
    name = F.coalesce(F.col(en), F.lit(""))
    return rows.where(name.isin(*known) | ((name == "") & (F.length(F.coalesce(F.col(cn), F.lit(""))) < 2)))
