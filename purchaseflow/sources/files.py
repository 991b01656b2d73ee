"""Files: NDJSON, CSV, audit log, whole replacement with a staged write."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_folder(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share, ``spark.checkpoint.dir``; what is written there goes
    when the application ends. A session on one machine may have none (a folder of the warehouse serves then); on a
    cluster that raises RuntimeError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    top = f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
    store, folder = _store(spark, top)
    store.mkdirs(folder)
    store.deleteOnExit(folder)
    return f"{top}/data"


def stored(rows: DataFrame) -> DataFrame:
    """The rows written to a work folder and read from there, for what is used several times."""
    path = work_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """The file system of a path, and the path as its own class."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _move(spark: SparkSession, source: str, target: str) -> bool:
    store, old = _store(spark, source)
    return store.rename(old, _store(spark, target)[1])


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_ndjson(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """With a header, in a fixed order of columns."""
    rows.select(*columns).write.option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text; a broken line is kept in ``_corrupt_record`` with the rest null."""
    schema = ", ".join(f"{c} string" for c in [*columns, "_corrupt_record"])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)


def append_log(spark: SparkSession, path: str, source: str, parsed: int, matched: int, new_ids: list[str], total: int) -> None:
    row = [(source, parsed, matched, len(new_ids), " ".join(new_ids), total)]
    log = spark.createDataFrame(row, "source_file string, items_parsed long, matched long, new_added long, new_item_ids string, total_after long")
    log.withColumn("timestamp", F.current_timestamp()).write.mode("append").parquet(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside the table, then moves the old one aside and the new one in its place.

    The old table is deleted only when the new one stands there; if that move fails, the old one is put back and OSError
    raised. Between the two renames a reader may find no table; it never finds half of one.
    """
    spark = rows.sparkSession
    tag = uuid.uuid4().hex
    staged, aside = f"{path}.staged-{tag}", f"{path}.old-{tag}"
    rows.write.parquet(staged)
    store, table = _store(spark, path)
    there = store.exists(table)
    if there and not _move(spark, path, aside):
        store.delete(_store(spark, staged)[1], True)
        raise OSError(f"{path} can't be moved aside")
    if not _move(spark, staged, path):
        if there:
            _move(spark, aside, path)
        store.delete(_store(spark, staged)[1], True)
        raise OSError(f"{staged} can't be moved to {path}")
    if there:
        store.delete(_store(spark, aside)[1], True)


def publish(rows: DataFrame, path: str, checks: dict[str, DataFrame]) -> dict[str, int]:
    """All or nothing: writes only if every check (a table of findings) is empty; returns the findings' counts."""
    found = {name: check.count() for name, check in checks.items()}
    if not any(found.values()):
        replace_table(rows, path)
    return found


#: Outcomes of a load: published; refused by a check, nothing written; published, but not what was meant; failed, the old rows stand.
PUBLISHED, REFUSED, DIFFERENT, FAILED = range(4)


def write_version(rows: DataFrame, path: str) -> int:
    """Writes the rows as the table's next version, a folder of its own, and returns its number. Readers take the greatest
    version that Spark has marked as whole, so there is always one to read and nothing is renamed. Of two writers at a time
    one raises."""
    jvm = rows.sparkSession.sparkContext._jvm
    store, _ = _store(rows.sparkSession, path)
    taken = [int(f.getPath().getName().split("=")[1]) for f in store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version=*")) or []]
    number = max(taken, default=0) + 1
    rows.write.mode("errorifexists").parquet(f"{path}/version={number}")
    return number


def read_version(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest whole version of a table; an empty one if there is none."""
    whole = folders(spark, path, "version=*/_SUCCESS")
    newest = max(whole, key=lambda f: int(f.rsplit("=", 1)[1]), default=None)
    return spark.read.schema(schema).parquet(newest) if newest else spark.createDataFrame([], schema)


def load(rows: DataFrame, path: str, checks: dict[str, DataFrame], differences: Callable[[DataFrame], DataFrame]) -> tuple[int, dict[str, int]]:
    """(outcome, counts of findings): a version is written only if all checks are empty; what is stored then is read
    back, and ``differences`` gives the rows in which it isn't what was meant. A job that Spark can't finish is FAILED."""
    found = {name: check.count() for name, check in checks.items()}
    if any(found.values()):
        return REFUSED, found
    try:
        write_version(rows, path)
    except (PySparkException, Py4JJavaError):
        return FAILED, found
    found["differences"] = differences(read_version(rows.sparkSession, path, rows.schema)).count()
    return (DIFFERENT if found["differences"] else PUBLISHED), found


def apply_once(rows: DataFrame, path: str, job: str) -> bool:
    """Adds the rows of a job to the table at ``path`` if the job isn't there yet; returns whether it was added.

    A job is a folder of the table, and the mark that Spark writes at its end is the log of applied jobs: rows and entry
    become visible in one step. What a job left that broke off is seen by no reader and is overwritten.
    """
    store, mark = _store(rows.sparkSession, f"{path}/_job={job}/_SUCCESS")
    if store.exists(mark):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/_job={job}")
    return True


def read_applied(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all jobs that ``apply_once`` has added whole; none is an empty table."""
    found = folders(spark, path, "_job=*/_SUCCESS")
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, or an empty one if nothing is there."""
    store, found = _store(spark, path)
    return spark.read.schema(schema).parquet(path) if store.exists(found) else spark.createDataFrame([], schema)


def folders(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """The folders below ``path`` that hold a file of this pattern, such as ``batch=*/_SUCCESS``."""
    jvm = spark.sparkContext._jvm
    store, _ = _store(spark, path)
    found = store.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}"))
    return sorted(f.getPath().getParent().toString() for f in found or [])


#: Names of files that aren't data: hidden ones, markers, what is still being written, open sheets.
LEFT_OUT = r"^(_.*|\..*|.*\.tmp|~\$.*)$"
_SQUEEZED = "gz"


def _whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, whole) of files by their bytes: a compressed one must come to its end, others are whole as they are."""
    for files in parts:
        yield pd.DataFrame({"file": files["file"], "whole": [_ends(p, b) for p, b in zip(files["file"], files["content"], strict=True)]})


def _ends(path: str, content: bytes) -> bool:
    if not path.endswith(f".{_SQUEEZED}"):
        return True
    rest = content
    while rest:
        member = zlib.decompressobj(31)
        try:
            while rest and not member.eof:
                member.decompress(rest, 1 << 20)
                rest = member.unconsumed_tail
        except zlib.error:
            return False
        if not member.eof:
            return False
        rest = member.unused_data
    return bool(content)


def read_what_can(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of the NDJSON files of a folder and those below: files that don't come to their end are set aside whole.

    ``rows`` has the schema's columns, ``_corrupt_record`` (a broken line as it is, with the rest null) and ``file``.
    ``report`` has file, n_bytes and state of each file: read, unreadable (cut off, or not what its ending says) or left
    out (LEFT_OUT). Tasks try each file, one at a time and without keeping what they decompress; rows are then read by Spark
    and taken from whole files only, also where a bad one gave some before its end.
    """
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    named = seen.select(F.col("path").alias("file"), F.col("length").alias("n_bytes"), "content", F.element_at(F.split("path", "/"), -1).rlike(LEFT_OUT).alias("ignored"))
    tried = named.where("NOT ignored").select("file", "content").mapInPandas(_whole, "file string, whole boolean")
    report = named.drop("content").join(tried, "file", "left").select("file", "n_bytes", F.when(F.col("ignored"), "left out").when(F.col("whole"), "read").otherwise("unreadable").alias("state"))
    kept = StructType([*schema, *StructType().add("_corrupt_record", "string")])
    lines = spark.read.schema(kept).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).json(path)
    rows = lines.select("*", F.col("_metadata.file_path").alias("file"))
    good = report.where("state = 'read'").select("file")
    return rows.join(good, "file", "left_semi").select(*kept.names, "file"), report


def blank_to_null(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the empty texts of ``columns`` as null, one row with how many each column had)."""
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns}), rows.agg(*(F.count_if(F.col(c) == "").alias(c) for c in columns))


def conform(rows: DataFrame, schema: StructType) -> tuple[DataFrame, list[str], list[str]]:
    """(rows in the target's columns and types, columns dropped, columns defaulted)."""
    have, want = set(rows.columns), {f.name for f in schema}
    made = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return rows.select(*made), sorted(have - want), sorted(want - have)
