"""Replication in batches: new versions since a watermark, append-only logs by anti-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from purchaseflow.sources import files

EPOCH = "1970-01-01 00:00:00"
STATE = StructType().add("run_at", "timestamp").add("synced_through", "timestamp").add("mode", "string")


def version_of(updated: Column, floor: int = 0) -> Column:
    """Epoch milliseconds of the update, never under ``floor``; a raised floor makes rows that are sent again win."""
    return F.greatest(F.unix_millis(updated.cast("timestamp")), F.lit(floor).cast("long"))


def watermark(state: DataFrame, overlap_minutes: int = 15) -> str:
    """The start of the next run's window as text: the last one's end less the overlap, the epoch if there was none."""
    last = state.agg(F.date_format(F.max("synced_through") - F.expr(f"INTERVAL {overlap_minutes} MINUTES"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    return last or EPOCH


def changes(source: DataFrame, updated: str, since: str, floor: int = 0) -> DataFrame:
    """Rows changed after ``since`` with their version. The filter is on the stored column, so the scan takes it."""
    return source.where(F.col(updated) > F.lit(since).cast(source.schema[updated].dataType)).withColumn("sync_version", version_of(F.col(updated), floor))


def append_only(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Log rows that the target doesn't have; exact whatever the order in which they were committed."""
    return source.join(target.select(F.col(key).cast("string").alias("_k")).distinct(), F.col(key).cast("string") == F.col("_k"), "left_anti")


def apply_changes(target: DataFrame, news: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The target's current rows after appending new versions: the newest of each key; ``order`` breaks ties, else a hash."""
    both = target.unionByName(news)
    order = F.struct("sync_version", *order, F.xxhash64(*both.columns))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), order).alias("r")).select("r.*")


def advance(spark: SparkSession, state_path: str, started: str, mode: str = "incremental") -> None:
    """Notes that everything up to ``started`` has been copied."""
    row = spark.createDataFrame([(started, mode)], "started string, mode string")
    row.select(F.current_timestamp().alias("run_at"), F.col("started").cast("timestamp").alias("synced_through"), "mode").write.mode("append").parquet(state_path)


def run(sources: dict[str, tuple[DataFrame, str, str]], state_path: str, started: str, overlap_minutes: int = 15) -> str:
    """Appends the changes of every source (rows, column of the update, target path) since the watermark; returns it.

    Where no run has left a state yet, all rows are copied, those without a time of update too, and the state says ``full``.

    The watermark moves last, and to the start of this run: a run that fails at any table leaves it, so the next one
    copies the same changes again, and what was updated meanwhile is never missed. Versions make a repeat harmless.
    """
    spark = next(iter(sources.values()))[0].sparkSession
    since = watermark(files.read_or_empty(spark, state_path, STATE), overlap_minutes)
    for rows, updated, path in sources.values():
        news = changes(rows, updated, since)
        if since == EPOCH:
            news = news.unionByName(rows.where(F.col(updated).isNull() | (F.col(updated) <= F.lit(EPOCH).cast(rows.schema[updated].dataType))).withColumn("sync_version", F.coalesce(version_of(F.col(updated)), F.lit(0))))
        news.write.mode("append").parquet(path)
    advance(spark, state_path, started, "full" if since == EPOCH else "incremental")
    return since
