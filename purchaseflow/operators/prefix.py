"""Running sums and neighbouring values in an order, where a key may have any number of rows.

A window over a key sorts all its rows in one task. Here rows are dealt into ranges of (key, order) and written, so that a
task that runs again can't cut the ranges anew; each range works for itself, and what the ranges beside it add is carried
over for the keys that several ranges share. As ranges are cut in order these are the first and the last key of a range: no more
than there are ranges, so they are broadcast. Ranges are as many as the rows need, so a task's memory doesn't grow with the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purchaseflow.sources.files import stored, work_folder

RANGE = "_range"
#: Rows of a range, about: a task sorts some 100 MB of them.
ROWS = 250_000


def parts_for(rows: DataFrame) -> int:
    """How many ranges these rows are dealt into; 0 leaves it to Spark, as for rows that one task can take."""
    n = rows.count()
    return 0 if n <= ROWS else max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))


def spread(rows: DataFrame, parts: int, *by: str) -> DataFrame:
    """The rows by hash, in as many parts as they have ranges; windows and groups by these columns need no other shuffle."""
    return rows.repartition(parts, *by) if parts else rows


def _sized(rows: DataFrame, parts: int | None) -> tuple[DataFrame, int]:
    """The rows and their ``parts_for``; if that isn't known they are stored, so that counting doesn't make them again."""
    if parts is None:
        rows = stored(rows)
        parts = parts_for(rows)
    return rows, parts


def dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int = 0) -> DataFrame:
    """The rows in ranges of (keys, order), with the number of their range; the rows of a range are stored in order."""
    path, by = work_folder(rows.sparkSession), [F.col(c) for c in (*keys, *order)]
    ranges = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    ranges.sortWithinPartitions(*by).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _within(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(RANGE, *keys).orderBy(*order)


def _joined(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    other = carried.select(*(F.col(c).alias(f"_c_{c}") for c in (*keys, RANGE)), *(c for c in carried.columns if c not in (*keys, RANGE)))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in keys))
    return rows.join(F.broadcast(other), same & (F.col(RANGE) == F.col(f"_c_{RANGE}")), "left").drop(*(f"_c_{c}" for c in (*keys, RANGE)))


def _edges(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first and the last key of each stored range, by the places of its rows in their file."""
    placed = rows.select(*keys, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    ends = placed.groupBy(F.col("_file").alias("_e_file")).agg(F.max("_row").alias("_end"))
    at_ends = placed.join(F.broadcast(ends), F.col("_file") == F.col("_e_file")).where("_row = 0 OR _row = _end")
    return at_ends.select(*(F.col(c).alias(f"_e_{c}") for c in keys)).distinct()


def _shared(rows: DataFrame, keys: Sequence[str], **aggregates) -> DataFrame:
    """Aggregates by key and range of the keys that several ranges have; only the first and last keys of ranges are looked at."""
    edges = _edges(rows, keys)
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_e_{c}")) for c in keys))
    each = rows.join(F.broadcast(edges), same, "left_semi").groupBy(*keys, RANGE).agg(*(a.alias(n) for n, a in aggregates.items()))
    return each.withColumn("_ranges", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_ranges > 1").drop("_ranges")


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """``rows`` with, for each ``name: column`` of ``sums``, the sum of the column from the key's first row to this one. Nulls
    count as zero; rows alike in ``order`` are taken in any order, one after the other. Who knows the rows' ``parts_for`` gives it."""
    rows, parts = _sized(rows, parts)
    rows = dealt(rows, keys, order, parts)
    by_range = _shared(rows, keys, **{f"_s_{n}": F.sum(c) for n, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = by_range.select(*keys, RANGE, *(F.sum(f"_s_{n}").over(before).alias(f"_b_{n}") for n in sums))
    upto = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    own = spread(rows, parts, *keys, RANGE).withColumns({n: F.sum(c).over(upto) for n, c in sums.items()})
    both = _joined(own, carried, keys)
    zero = F.lit(0)
    return both.withColumns({n: F.coalesce(F.col(n), zero) + F.coalesce(F.col(f"_b_{n}"), zero) for n in sums}).drop(RANGE, *(f"_b_{n}" for n in sums))


def places(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``rows`` numbered 1, 2, ... within each key in ``order``, whose values don't repeat within a key."""
    return running_sums(rows.withColumn("_one", F.lit(1)), keys, order, {name: "_one"}).drop("_one")


def neighbours(rows: DataFrame, keys: Sequence[str], order: str, ahead: Sequence[str] = (), behind: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """``rows`` with ``next_<c>``, the first known value of ``c`` from this row on, for the columns ``ahead``, and
    ``last_<c>``, the last known one before this row, for those of ``behind``. ``order`` has no repeats within a key."""
    rows, parts = _sized(rows, parts)
    rows = dealt(rows, keys, [order], parts)
    known = lambda c: F.when(F.col(c).isNotNull(), F.col(order))
    by_range = _shared(rows, keys, **{f"_a_{c}": F.min_by(c, known(c)) for c in ahead}, **{f"_z_{c}": F.max_by(c, known(c)) for c in behind})
    ranges = Window.partitionBy(*keys).orderBy(RANGE)
    later, earlier = ranges.rowsBetween(1, Window.unboundedFollowing), ranges.rowsBetween(Window.unboundedPreceding, -1)
    carried = by_range.select(*keys, RANGE, *(F.first(f"_a_{c}", ignorenulls=True).over(later).alias(f"_n_{c}") for c in ahead), *(F.last(f"_z_{c}", ignorenulls=True).over(earlier).alias(f"_l_{c}") for c in behind))
    here = _within(keys, [order])
    on, back = here.rowsBetween(0, Window.unboundedFollowing), here.rowsBetween(Window.unboundedPreceding, -1)
    own = spread(rows, parts, *keys, RANGE).withColumns({f"next_{c}": F.first(c, ignorenulls=True).over(on) for c in ahead} | {f"last_{c}": F.last(c, ignorenulls=True).over(back) for c in behind})
    both = _joined(own, carried, keys)
    made = {f"next_{c}": F.coalesce(f"next_{c}", f"_n_{c}") for c in ahead} | {f"last_{c}": F.coalesce(f"last_{c}", f"_l_{c}") for c in behind}
    return both.withColumns(made).drop(RANGE, *(f"_n_{c}" for c in ahead), *(f"_l_{c}" for c in behind))
