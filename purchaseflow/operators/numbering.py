"""Numbers and identifiers: line numbers, document numbers, repair of duplicate and missing ids.

A window without a partition would bring all rows to one task; ``dense_numbers`` deals rows into ranges instead, counts
them by range, and adds to each range's own numbers the total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purchaseflow.sources.files import work_folder


def line_numbers(rows: DataFrame, document: str, position: str) -> DataFrame:
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy(document).orderBy(position)))


def dense_numbers(rows: DataFrame, order: Sequence[str], start: int | Column = 0, name: str = "number") -> DataFrame:
    """``rows`` with start + 1, start + 2, ... in ``order``, which has to be unique.

    Rows are dealt into ranges of the order, as many as the session has shuffle partitions, and written with the number
    of their range, so that a task that runs again can't cut the ranges anew. Only the table of range sizes is summed
    up by one task.
    """
    spark = rows.sparkSession
    path = work_folder(spark)
    rows.repartitionByRange(*(F.col(c) for c in order)).withColumn("_bucket", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_bucket", (F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    base = start if isinstance(start, Column) else F.lit(start)
    # one row for each range: bounded by the number of shuffle partitions
    return dealt.join(F.broadcast(before), "_bucket").withColumn(name, (base + F.col("_before") + own).cast("long")).drop("_bucket", "_before")


def padded(prefix: str, number: Column, width: int, year: Column | None = None) -> Column:
    """PREFIX-YYYY-NNN or PREFIX-NNNN: the width is a minimum."""
    digits = number.cast("string")
    digits = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return F.concat_ws("-", F.lit(prefix), *([year.cast("string")] if year is not None else []), digits)


def document_numbers(rows: DataFrame, counters: DataFrame, year: str, order: Sequence[str], prefix: str, width: int = 3) -> DataFrame:
    """``doc_no`` for each row: numbers run on from the counter (year, last_no) of its year.

    A year has no bound on its rows: all are numbered densely in order of year, and each year's least number is taken off.
    """
    dense = dense_numbers(rows, [year, *order], name="_all")
    first = dense.groupBy(F.col(year).alias("year")).agg((F.min("_all") - 1).alias("_before"))
    known = first.join(counters.select("year", "last_no"), "year", "left").select(F.col("year").alias(year), (F.coalesce("last_no", F.lit(0)) - F.col("_before")).alias("_add"))
    out = dense.join(F.broadcast(known), year)  # a row for each year
    return out.withColumn("doc_no", padded(prefix, F.col("_all") + F.col("_add"), width, F.col(year))).drop("_all", "_add")


def counter_seed(numbers: DataFrame, column: str, pattern: str) -> DataFrame:
    """(year, last_no) from document numbers; group 1 of the pattern is the year, group 2 the number. Others are ignored."""
    hit = numbers.where(F.col(column).rlike(pattern))
    return hit.groupBy(F.regexp_extract(column, pattern, 1).alias("year")).agg(F.max(F.regexp_extract(column, pattern, 2).cast("long")).alias("last_no"))


def next_number(ids: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the next free number of text ids ``PREFIX-<digits>``."""
    found = F.regexp_extract(column, rf"^{prefix}-(\d+)$", 1)
    return ids.agg((F.coalesce(F.max(F.nullif(found, F.lit("")).cast("long")), F.lit(0)) + 1).alias("next_no"))


def repair_live(rows: DataFrame, legacy: str, order: Sequence[str]) -> DataFrame:
    """Among live rows the first of each legacy id keeps it; the others get ids after the greatest, in order."""
    keep = F.row_number().over(Window.partitionBy(legacy).orderBy(*order)) == 1
    marked = rows.withColumn("_keep", keep)
    top = rows.agg(F.coalesce(F.max(legacy), F.lit(0))).first()[0]
    moved = dense_numbers(marked.where("NOT _keep"), [legacy, *order], int(top), "new_id")
    kept = marked.where("_keep").withColumn("new_id", F.col(legacy).cast("long"))
    return kept.unionByName(moved).drop("_keep")


def repair_all(rows: DataFrame, legacy: str, order: Sequence[str]) -> DataFrame:
    """Of rows that share a legacy id the live one keeps it, else the oldest; the others lose it (``fixed_id`` null).
    With two or more live rows nothing is changed and ``conflict`` is true."""
    w = Window.partitionBy(legacy)
    alive = F.sum(1 - F.col("is_deleted")).over(w)
    first = F.row_number().over(w.orderBy("is_deleted", *order)) == 1
    return rows.withColumn("conflict", F.col(legacy).isNotNull() & (alive > 1)).withColumn("fixed_id", F.when(F.col("conflict") | first, F.col(legacy)))


def surrogate_keys(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Children with the parent's derived key in place of its number; unknown parents give an empty string."""
    made = parents.select(key, F.sha1(F.concat(F.lit(f"{key}:"), F.col(key).cast("string"))).alias("parent_key"))
    return children.join(made, key, "left").withColumn("parent_key", F.coalesce("parent_key", F.lit("")))
