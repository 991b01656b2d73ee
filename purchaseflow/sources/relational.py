"""Tables of a relational database, read in parts and written in bounded statements."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Rows and parameters of a statement at most.
ROWS, PARAMETERS = 500, 30_000


def key_bounds(spark: SparkSession, url: str, table: str, key: str, options: dict[str, str] | None = None) -> tuple[int, int] | None:
    """Least and greatest key, as the database has them; None for an empty table."""
    reader = spark.read.format("jdbc").options(**(options or {})).option("url", url)
    row = reader.option("query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {table}").load().first()
    return None if row is None or row[0] is None else (int(row[0]), int(row[1]))


def read_table(spark: SparkSession, url: str, table: str, key: str, parts: int, options: dict[str, str] | None = None) -> DataFrame:
    """The whole table through ``parts`` connections, each with a range of the numeric ``key``; rows without a key come with
    the first. Filters on stored columns and the choice of columns go to the database."""
    reader = spark.read.format("jdbc").options(**(options or {})).option("url", url).option("dbtable", table)
    bounds = key_bounds(spark, url, table, key, options)
    if bounds and parts > 1:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1] + 1).option("numPartitions", parts)
    return reader.load()


def key_quantiles(spark: SparkSession, url: str, table: str, key: str, parts: int, options: dict[str, str] | None = None) -> list:
    """Keys that cut the table into ``parts`` of as many rows each, as the database finds them in order of the key: a look-up
    in the key's index for each. A key that repeats may be several bounds; it is listed once."""
    reader = spark.read.format("jdbc").options(**(options or {})).option("url", url)
    total = int(reader.option("query", f"SELECT COUNT({key}) AS n FROM {table}").load().first()[0])
    found = set()
    for place in sorted({total * i // parts for i in range(1, parts)} - {0}):
        at = f"SELECT {key} AS k FROM {table} WHERE {key} IS NOT NULL ORDER BY {key} OFFSET {place - 1} ROWS FETCH NEXT 1 ROWS ONLY"
        found.add(reader.option("query", at).load().first()[0])
    return sorted(found)


def _literal(value) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def read_even(spark: SparkSession, url: str, table: str, key: str, parts: int, options: dict[str, str] | None = None) -> DataFrame:
    """The whole table in at most ``parts`` ranges of ``key`` with about as many rows each, however the keys lie: linear
    ranges of a skewed key would be one full and many empty. Rows without a key are a part of their own; each row comes once.
    A key that has more than a part's share of the rows makes its part larger, as ranges can't cut it."""
    bounds = key_quantiles(spark, url, table, key, parts, options)
    ranges = [f"{key} <= {_literal(b)}" if k == 0 else f"{key} > {_literal(bounds[k - 1])} AND {key} <= {_literal(b)}" for k, b in enumerate(bounds)]
    ranges.append(f"{key} > {_literal(bounds[-1])}" if bounds else f"{key} IS NOT NULL")
    return spark.read.jdbc(url, table, predicates=[*ranges, f"{key} IS NULL"], properties=options or {})


def rows_a_statement(n_columns: int) -> int:
    """Rows of a statement: ROWS at most, and no more than PARAMETERS values."""
    return max(1, min(ROWS, PARAMETERS // n_columns))


def _execute(spark: SparkSession, url: str, statements: Sequence[str], options: dict[str, str]) -> None:
    """All of the statements in one transaction."""
    properties = spark._jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, value)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def _tagged(rows: DataFrame) -> DataFrame:
    """The rows with the numbers of their part and of the attempt that writes them."""
    names = rows.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array([attempt] * b.num_rows, pa.int64())], names=[*names, "_part", "_attempt"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("_part", IntegerType()), StructField("_attempt", LongType())]))


def _stage(rows: DataFrame, url: str, staged: str, options: dict[str, str]) -> None:
    writer = _tagged(rows).write.format("jdbc").options(**options).option("url", url).option("dbtable", staged)
    writer.option("batchsize", rows_a_statement(len(rows.columns) + 2)).mode("append").save()


def _merge(staged: str, table: str, columns: Sequence[str], keys: Sequence[str]) -> list[str]:
    names = ", ".join(f'"{c}"' for c in columns)
    same = " AND ".join(f'{table}."{k}" = s."{k}"' for k in keys)
    once = f'SELECT {names} FROM {staged} s WHERE s."_attempt" = (SELECT MIN(x."_attempt") FROM {staged} x WHERE x."_part" = s."_part")'
    return [f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staged} s WHERE {same})", f"INSERT INTO {table} ({names}) {once}"]


def upsert(rows: DataFrame, url: str, table: str, keys: Sequence[str], options: dict[str, str] | None = None) -> None:
    """Puts ``rows``, one a key, into the database's table in place of those with their keys, all or nothing.

    Tasks write into a staging table of the same types, in statements of ``rows_a_statement`` rows; each attempt of a task is a
    transaction and marks its rows. One transaction then deletes the old rows of the staged keys and inserts of each
    part what one attempt wrote, so a task that ran twice counts once, and a job that fails before that has changed nothing.
    The staging table goes in any case. Columns are named as in the table, without quotes in their names.
    """
    spark, options = rows.sparkSession, options or {}
    staged = f"staged_{uuid.uuid4().hex[:16]}"
    names = ", ".join(f'"{c}"' for c in rows.columns)
    _execute(spark, url, [f'CREATE TABLE {staged} AS SELECT {names}, CAST(0 AS INT) AS "_part", CAST(0 AS BIGINT) AS "_attempt" FROM {table} WITH NO DATA'], options)
    try:
        _stage(rows, url, staged, options)
        _execute(spark, url, _merge(staged, table, rows.columns, keys), options)
    finally:
        _execute(spark, url, [f"DROP TABLE {staged}"], options)


def statements_of(rows: DataFrame) -> DataFrame:
    """(part, n_rows, n_statements) of what ``upsert`` sends for each part of ``rows``."""
    size = rows_a_statement(len(rows.columns) + 2)
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_statements", F.ceil(F.col("n_rows") / size))
