"""Versioned tables that are stored by key, so that their current state and joins by that key need no shuffle.

A table is cut into buckets by the hash of a leading part of its key (the document), each sorted by the whole key. Scans
keep that partitioning, so a window by key, or a join with a table of as many buckets on the same columns, runs bucket by
bucket. New versions are appended to the buckets of their keys alone; buckets without news get no file.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .files import work_folder


#: Rows of a bucket, about: a task sorts one bucket, so its memory doesn't grow with the table.
ROWS = 1_000_000


def buckets_for(rows: DataFrame, least: int = 8) -> int:
    """How many buckets a table of these rows should have; tables that are joined by bucket take the number of the largest."""
    return max(least, -(-rows.count() // ROWS))


def _writer(rows: DataFrame, by: Sequence[str], sort: Sequence[str], buckets: int, mode: str):
    dealt = rows.repartition(buckets, *by)  # one file a bucket
    return dealt.write.format("parquet").mode(mode).bucketBy(buckets, by[0], *by[1:]).sortBy(sort[0], *sort[1:])


def create(rows: DataFrame, by: Sequence[str], sort: Sequence[str], buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Stores ``rows`` in ``buckets`` by the columns ``by``, sorted by ``sort``; returns the table's name. Without a path the
    files are in a work folder and go when the application ends. ``buckets_for`` says how many it needs."""
    name = name or f"bucketed_{uuid.uuid4().hex}"
    _writer(rows, by, sort, buckets, "error").option("path", path or work_folder(rows.sparkSession)).saveAsTable(name)
    return name


def append(name: str, news: DataFrame, by: Sequence[str], sort: Sequence[str], buckets: int) -> None:
    """New versions of rows; only buckets that have some get a file. The bucket columns are those of the table."""
    spark = news.sparkSession
    _writer(news.select(*spark.table(name).columns), by, sort, buckets, "append").saveAsTable(name)


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
