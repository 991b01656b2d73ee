"""Versioned tables: append-only rows of which the newest version of a key counts, and soft deletes.

No operator filters on ``is_deleted`` before it has found the newest version: an older version would come back to life.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))


def current_state(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key; ``order`` lists the version and what breaks its ties, later values winning."""
    return rows.withColumn("_rank", F.row_number().over(_newest(keys, order))).where("_rank = 1").drop("_rank")


def live(rows: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted; to be used on a current state."""
    return rows.where(F.col("is_deleted") == 0)


def collapse_report(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Keys with several stored rows: how many, and the newest and the oldest version."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.max(version).alias("kept_version"), F.min(version).alias("oldest_version")).where("n_rows > 1")


def ambiguous(rows: DataFrame, keys: Sequence[str], version: str, content: Sequence[str]) -> DataFrame:
    """(key, version) whose stored rows differ in content: no rule says which one counts."""
    return rows.groupBy(*keys, version).agg(F.count_distinct(F.struct(*content)).alias("n_contents")).where("n_contents > 1")


def lookup(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Live current rows of the wanted keys, or leading parts of keys; the semi-join comes first, so only their versions are sorted."""
    return live(current_state(rows.join(wanted, [k for k in keys if k in wanted.columns], "left_semi"), keys, order))


def tombstones(current: DataFrame, doomed: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """New versions that mark the doomed keys' live rows deleted; to be appended."""
    return live(current).join(doomed.select(*keys).distinct(), list(keys), "left_semi").withColumns({"is_deleted": F.lit(1), "version": version})


def insert_if_absent(target: DataFrame, seed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``seed`` whose key the target doesn't have; to be appended."""
    return seed.join(target.select(*keys), list(keys), "left_anti")


def upsert_greatest(target: DataFrame, news: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counters after an upsert in which a value never goes back."""
    new = news.withColumnRenamed(value, "_new")
    return target.join(new, list(keys), "full_outer").select(*keys, F.greatest(value, "_new").alias(value))


def batch_update(current: DataFrame, updates: DataFrame, key: str, optional: Sequence[str]) -> DataFrame:
    """The updated rows: of an update's ``optional`` columns null and empty ones keep the old value."""
    new = updates.withColumnsRenamed({c: f"_{c}" for c in optional})
    joined = current.join(new, key)
    return joined.withColumns({c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), F.col(c)) for c in optional}).drop(*(f"_{c}" for c in optional))


def carry_forward(rows: DataFrame, key: str, column: str, order: Sequence[str]) -> DataFrame:
    """The newest known value of ``column`` of each key, for a feed that doesn't deliver it."""
    return rows.groupBy(key).agg(F.max_by(column, F.struct(*order)).alias(column))


def hard_delete(rows: DataFrame, doomed: DataFrame, key: str, references: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows left, blocked keys with the number of references of each kind): referenced keys are never deleted."""
    report = doomed.select(key).distinct()
    for name, child in references.items():
        report = report.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    used = sum((F.col(n) for n in references), F.lit(0))
    blocked = report.where(used > 0)
    return rows.join(report.where(used == 0), key, "left_anti"), blocked
