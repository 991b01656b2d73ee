"""What the operators of this subpackage share: reading tables, shared storage and text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: White space of all contracts here: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: ContextVar[list[str] | None] = ContextVar("folders made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine has none (as in tests), a folder under the warehouse is set; on a cluster, where that
    may be any machine's own disk, RuntimeError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext.getCheckpointDir()):
        found = own
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for intermediate data, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = file.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(file)  # only what exists can be marked
    system.deleteOnExit(file)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def folders_made() -> Iterator[list[str]]:
    """The folders that ``new_folder`` makes while this is open, oldest first, for ``remove`` once nothing reads them."""
    token = _MADE.set([])
    try:
        yield _MADE.get()
    finally:
        _MADE.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders of intermediate data; those that are gone already are no error."""
    for path in paths:
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` once to the shared folder and reads it from there. Its shuffle files go with the job."""
    path = new_folder(spark, name)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the folder of a table that ``written`` gave, once nothing reads it any more."""
    remove(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


#: Keys at most that join_hot broadcasts.
HOT_KEYS = 100_000


def join_hot(rows: DataFrame, key: str, side: DataFrame, side_key: str, count: str, total: int, keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with ``side``, which has one row a key and in ``count`` how many of the ``total`` rows have
    it. Keys with more than total / ``keys`` rows, of which there are ``keys`` at most, are broadcast, so no task gets
    all rows of a hot key; ``side_key`` and ``count`` are dropped."""
    most = max(1000, total // keys)
    hot, calm = F.broadcast(side.where(F.col(count) > most)), side.where(F.col(count) <= most)
    on = F.col(key) == F.col(side_key)
    return rows.join(hot, on).union(rows.join(hot, on, "left_anti").join(calm, on)).drop(side_key, count)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def column(name: str) -> Column:
    """A column by its name as it stands, dots, dashes and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def integral(docs: DataFrame, id_col: str) -> None:
    """Raises TypeError where ids are no whole numbers: "smallest id" is about numbers here."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{id_col} must be a whole number, not {kind.simpleString()}")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have, also not in other letter case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000, most: int = 16 << 20, weight=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of a stream of rows: at most ``size`` rows, and about ``most`` bytes by ``weight(row)``."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weight(row) if weight else 0
        if len(held) >= size or load >= most:
            yield _batch(held, schema)
            held, load = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def portions(it: Iterable[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size`` at most, so that few texts at a time are held as Python objects."""
    for b in it:
        for k in range(0, b.num_rows, size):
            yield b.slice(k, size)


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; bytes.split() knows just that white space."""
    return data.split()


_UPPER = bytes(range(65, 91))
LOWER_ASCII = bytes.maketrans(_UPPER, _UPPER.lower())

