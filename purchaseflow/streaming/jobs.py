"""Replication as streams: versions into a versioned table, logs by id exactly once, and order status in event time."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from purchaseflow.operators import sync
from purchaseflow.operators.purchasing import next_state
from purchaseflow.sources import files

#: The batch that wrote a row, as a folder of the target.
BATCH = "_batch"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(rows: DataFrame, each: Callable[[DataFrame, str], None], checkpoint: str, mode: str = "append"):
    """Runs the stream over all that is there now, batch by batch. ``each`` gets a batch's rows and its tag: the same when
    the batch runs again, another one for each batch and each stream."""
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"
    query = rows.writeStream.outputMode(mode).foreachBatch(lambda df, n: each(df, f"{stream}-{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def keep_batch(rows: DataFrame, batch: str, target: str) -> None:
    """Writes a batch into a folder of its own, whole or not at all for readers of ``read_batches``; again in place of itself."""
    rows.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch}")


def read_batches(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """All batches that were written whole, without the number of the batch; nothing there is an empty table."""
    found = files.folders(spark, target, f"{BATCH}=*/_SUCCESS")
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def sync_stream(changes: dict[str, DataFrame], updated: str, targets: dict[str, Sequence[str]], checkpoint: str, floor: int = 0, written: Callable[[str, str], None] | None = None) -> dict:
    """Copies streams of changed rows into versioned tables: each row with ``sync_version``, never under ``floor``.

    ``changes`` has a stream for each table and ``targets`` the folders to which it goes, several if it has several sinks.
    The tag of the batch is the key of a write: a batch that fails after some of its writes runs again with the same rows
    and puts them in place of those, so every sink has one copy. ``written(target, batch)`` is called after each write.
    """
    queries = {}
    for name, rows in changes.items():

        def each(batch: DataFrame, tag: str, name: str = name) -> None:
            versioned = batch.withColumn("sync_version", sync.version_of(F.col(updated), floor))
            if len(targets[name]) > 1:
                versioned = versioned.persist()
            try:
                for target in targets[name]:
                    keep_batch(versioned, tag, target)
                    if written:
                        written(target, tag)
            finally:
                versioned.unpersist()

        queries[name] = _run(rows, each, f"{checkpoint}/{name}")
    return queries


def append_once_stream(rows: DataFrame, key: str, time: str, target: str, checkpoint: str):
    """Log rows by id, each once, however late it comes again: the first that is seen stays.

    Each batch is compared with the days of the table that it touches, by an anti-join that reads just these folders, so no
    state is kept, nothing is forgotten and no row is too late; rows of an id must have one time. Batches are folders below
    their days, so one that runs again leaves one copy.
    """

    def each(batch: DataFrame, tag: str) -> None:
        spark = batch.sparkSession
        dated = batch.dropDuplicates([key]).withColumn("_day", F.to_date(time))
        days = [r[0] for r in dated.select("_day").distinct().collect()]
        old = known_rows(spark, target, dated.schema, days).where(F.col(BATCH) != tag)
        fresh = dated.join(old.select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")
        fresh.withColumn(BATCH, F.lit(tag)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", BATCH).parquet(target)

    return _run(rows, each, checkpoint)


def known_rows(spark: SparkSession, target: str, schema: StructType, days: Sequence | None = None) -> DataFrame:
    """The table that ``append_once_stream`` writes (with ``_day`` and the batch), limited to some days: only their folders are read."""
    whole = StructType([f for f in schema if f.name not in ("_day", BATCH)]).add("_day", "date").add(BATCH, "string")
    table = files.read_or_empty(spark, target, whole)
    return table if days is None else table.where(F.col("_day").isin(days) | (F.col("_day").isNull() if None in days else F.lit(False)))


STATUS = "document_id long, kind string, state string, refused long, seen long, at timestamp, seq long, action string, note string"
_TYPES = {"document_id": "Int64", "refused": "Int64", "seen": "Int64", "seq": "Int64", "at": "datetime64[us, UTC]"}


class OrderStatus(StatefulProcessor):
    """The status machines of a group of documents in event time.

    Commands of which the time is after the watermark are open: one that comes later may still go before them. They are kept
    as they are, and the status that is reported is that of the settled ones followed by the open ones in order of (at,
    seq). When the watermark passes a command, nothing can go before it any more: it is settled, and if the machine
    refuses it, it leaves as a row of its own. So the state holds a status and the commands of one watermark's delay.

    A call of the processor, each message about its state and each frame it returns cost milliseconds, which is far more than
    a command's step. So they are made for a group of documents, whose state is one text: (document, state, refused, seen,
    open commands) of each. A group has one timer, for its first open command.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "documents string")

    def _load(self) -> dict[int | None, list]:
        """[state, refused, seen, open commands] of each document."""
        return {doc: rest for doc, *rest in json.loads(self.kept.get()[0])} if self.kept.exists() else {}

    def _store(self, documents: dict[int | None, list], timer: int | None) -> None:
        self.kept.update((json.dumps([[doc, *rest] for doc, rest in documents.items()], separators=(",", ":")),))
        first = self._first(documents)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)

    @staticmethod
    def _first(documents: dict[int | None, list]) -> int | None:
        return min((commands[0][0] // 1000 for *_, commands in documents.values() if commands), default=None)

    @staticmethod
    def _fold(start: Sequence, commands: Sequence[Sequence]) -> tuple[tuple, list[tuple]]:
        (now, refused, seen), bad = start, []
        for c in commands:
            then = next_state(now, c[2], c[3])
            if then is None:
                bad.append((now, *c))
            now, refused, seen = then or now, refused + (then is None), seen + 1
        return (now, refused, seen), bad

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in STATUS.split(", ")]).astype(_TYPES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        documents = self._load()
        timer, touched = self._first(documents), {}
        for part in rows:
            for doc, at, seq, action, note in json.loads(f"[{','.join(part['command'])}]"):
                doc = None if doc is None else int(doc)
                touched[doc] = documents.setdefault(doc, ["pending_approval", 0, 0, []])
                touched[doc][3].append([int(at), int(seq), action, note])
        for *_, commands in touched.values():
            commands.sort(key=lambda c: c[:2])
        self._store(documents, timer)
        yield self._rows([(doc, "status", *self._fold(settled, commands)[0], None, None, None, None) for doc, (*settled, commands) in touched.items()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 + 999
        documents, left = self._load(), []
        for doc, (*settled, commands) in documents.items():
            n = bisect.bisect_right(commands, passed, key=lambda c: c[0])
            if n:
                after, refused = self._fold(settled, commands[:n])
                documents[doc] = [*after, commands[n:]]
                left += [(doc, "refused", now, None, None, pd.Timestamp(at, unit="us", tz="UTC"), seq, action, note) for now, at, seq, action, note in refused]
        self._store(documents, None)  # Spark takes the timer that expired
        yield self._rows(left)

    def close(self) -> None:
        pass


def order_status_stream(commands: DataFrame, target: str, checkpoint: str, delay: str = "1 hour", groups: int = 1024):
    """Order status from commands (document_id, at, seq, action, note) that come in any order within ``delay`` of event time.

    ``status`` below the target gets a row for each document that a batch touched, with the number of its commands so far
    (``seen``), by which readers take the newest; ``refused`` gets each refused command once the watermark has passed it, with
    the state it met. Commands later than that don't reach the machine; the query's progress counts them as dropped by
    the watermark. A batch that runs again replaces its own folders.

    Documents are dealt into ``groups``, which a checkpoint keeps: the state of a group is read and written as a whole when
    a batch has commands for it, so there should be some for each task, of a size that a task easily holds.
    """
    spark = commands.sparkSession
    group = F.pmod(F.xxhash64("document_id"), F.lit(groups)).alias("_group")
    command = F.to_json(F.array(*(F.col(c).cast("string") for c in ("document_id", "_us", "seq", "action", "note"))))
    timed = commands.withColumn("_us", F.unix_micros("at")).select(group, "at", command.alias("command")).withWatermark("at", delay)
    out = timed.groupBy("_group").transformWithStateInPandas(OrderStatus(), STATUS, "Update", "EventTime")

    def each(rows: DataFrame, tag: str) -> None:
        rows.persist()
        keep_batch(rows.where("kind = 'status'").select("document_id", "state", "refused", "seen"), tag, f"{target}/status")
        keep_batch(rows.where("kind = 'refused'").select("document_id", "at", "seq", "action", "note", "state"), tag, f"{target}/refused")
        rows.unpersist()

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return _run(out, each, checkpoint, "update")
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def current_status(spark: SparkSession, target: str) -> DataFrame:
    """The newest status of each document of an ``order_status_stream``."""
    rows = read_batches(spark, f"{target}/status", StructType.fromDDL("document_id long, state string, refused long, seen long"))
    newest = rows.groupBy("document_id").agg(F.max_by(F.struct("state", "refused", "seen"), "seen").alias("s"))
    return newest.select("document_id", "s.state", "s.refused", "s.seen")
