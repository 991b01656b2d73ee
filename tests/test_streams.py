"""Streams against their batch forms: disorder, restarts, failures, repeats."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from purchaseflow.operators import purchasing, reconcile, sync
from purchaseflow.operators import versioned as v
from purchaseflow.plans import jobs as plans
from purchaseflow.sources import files
from purchaseflow.streaming import jobs as streams

COMMANDS = "document_id long, at timestamp, seq long, action string, note string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def refused_of(commands):
    """(document, seq, state it met) of refused commands, the plain way."""
    out, state = [], {}
    for doc, _, seq, action, note in sorted(commands, key=lambda c: (c[1], c[2])):
        now = state.setdefault(doc, "pending_approval")
        then = purchasing.next_state(now, action, note)
        state[doc] = then or now
        if then is None:
            out.append((doc, seq, now))
    return sorted(out)


def test_status_of_commands_in_disorder_over_triggers_and_a_restart(spark):
    rng, start = random.Random(8), datetime(2025, 3, 1)
    commands = [(rng.randrange(7), start + timedelta(minutes=rng.randrange(1500)), k, rng.choice(["approve", "reject", "resubmit", "other"]), rng.choice(["why", ""])) for k in range(160)]
    commands += [(3, start + timedelta(minutes=700), 900 + k, a, "x") for k, a in enumerate(("approve", "reject", "resubmit"))]  # one time, in order of seq
    late = sorted(commands, key=lambda c: (c[1] + timedelta(minutes=rng.randrange(119)), rng.random()))
    base = files.work_folder(spark)
    whole = purchasing.fold_status(spark.createDataFrame(commands, COMMANDS))

    def arrive(part):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        rows = streams.source(spark, f"{base}/in", spark.createDataFrame([], COMMANDS).schema, 1)
        return streams.order_status_stream(rows, f"{base}/out", f"{base}/state", "2 hours")

    for k in range(0, 100, 25):
        arrive(late[k : k + 25])
    run()
    for k in range(100, len(late), 25):
        arrive(late[k : k + 25])
    query = run()
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 0
    assert rows_of(streams.current_status(spark, f"{base}/out")) == rows_of(whole)

    arrive([(99, start + timedelta(days=9), 5000, "approve", "")])  # moves the watermark past all others
    arrive([(99, start + timedelta(days=19), 5001, "other", "")])
    query = run()
    refused = spark.read.parquet(f"{base}/out/refused").where("document_id <> 99")
    assert sorted(map(tuple, refused.select("document_id", "seq", "state").collect())) == refused_of(commands)
    assert rows_of(streams.current_status(spark, f"{base}/out").where("document_id <> 99")) == rows_of(whole)

    arrive([(1, start, 6000, "approve", "")])  # far too late: never reaches the machine, and is counted
    query = run()
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 1


def test_a_batch_that_fails_after_a_write_leaves_one_copy(spark):
    base = files.work_folder(spark)
    rows = spark.createDataFrame([(k % 5, datetime(2025, 1, 1, k), f"v{k}") for k in range(20)], "id long, updated timestamp, value string")
    for k in range(4):
        rows.where(f"CAST(substr(value, 2) AS INT) % 4 = {k}").coalesce(1).write.mode("append").parquet(f"{base}/in")
    sinks, calls = [f"{base}/a", f"{base}/b"], []

    def fails(target, batch):
        calls.append((target, batch))
        if len(calls) in (3, 5):  # after the first and after the second write of a batch
            raise RuntimeError("gone")

    def run():
        streams.sync_stream({"t": streams.source(spark, f"{base}/in", rows.schema, 1)}, "updated", {"t": sinks}, f"{base}/state", floor=1_735_700_000_000, written=fails)

    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            run()
    run()
    schema = rows.withColumn("sync_version", F.lit(0).cast("long")).schema
    for s in sinks:
        got = streams.read_batches(spark, s, schema)
        assert rows_of(got.drop("sync_version")) == rows_of(rows)
        assert got.agg(F.min("sync_version")).first()[0] == 1_735_700_000_000
        assert rows_of(sync.apply_changes(got.limit(0), got, ["id"]).select("id", "value")) == rows_of(v.current_state(rows, ["id"], ["updated"]).select("id", "value"))
    assert streams.read_batches(spark, f"{base}/nothing", schema).count() == 0


def test_ids_that_come_back_late_are_refused_and_days_are_pruned(spark):
    base = files.work_folder(spark)
    log = "id long, at timestamp, text string"
    day = lambda k: datetime(2025, 1, 1 + k, 12)

    def run(rows, name="s"):
        spark.createDataFrame(rows, log).coalesce(1).write.mode("append").parquet(f"{base}/in")
        streams.append_once_stream(streams.source(spark, f"{base}/in", spark.createDataFrame([], log).schema, 1), "id", "at", f"{base}/out", f"{base}/{name}")
        return rows_of(spark.read.parquet(f"{base}/out").select("id", "text"))

    run([(1, day(0), "a"), (2, day(0), "b"), (2, day(0), "b")])
    run([(3, day(9), "c")])  # event time is nine days on
    assert run([(1, day(0), "a"), (4, day(9), "d")]) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert run([(5, None, "e"), (5, None, "e")], "s") == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    assert run([(6, day(3), "f")], "another")[:5] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    known = streams.known_rows(spark, f"{base}/out", spark.createDataFrame([], log).schema, [day(9).date()])
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_day" in plan or "PartitionFilters: [_day" in plan
    assert rows_of(known.select("id")) == [(3,), (4,)]


def test_first_run_of_a_sync_copies_all_and_the_next_what_is_new(spark):
    base = files.work_folder(spark)
    rows = spark.createDataFrame([(1, None), (2, datetime(1969, 5, 5)), (3, datetime(2025, 1, 1, 9)), (4, datetime(2025, 1, 1, 10, 50)), (5, datetime(2025, 1, 1, 11, 30))], "id long, updated timestamp")
    known = lambda hour: rows.where(F.col("updated").isNull() | (F.col("updated") <= F.lit(datetime(2025, 1, 1, hour))))
    assert sync.run({"t": (known(11), "updated", f"{base}/t")}, f"{base}/state", "2025-01-01 11:00:00") == sync.EPOCH
    assert rows_of(spark.read.parquet(f"{base}/t").select("id")) == [(1,), (2,), (3,), (4,)]
    assert sync.run({"t": (rows, "updated", f"{base}/t")}, f"{base}/state", "2025-01-01 12:00:00") == "2025-01-01 10:45:00"
    assert rows_of(spark.read.parquet(f"{base}/t").select("id")) == [(1,), (2,), (3,), (4,), (4,), (5,)]
    assert sorted(r.mode for r in spark.read.parquet(f"{base}/state").collect()) == ["full", "incremental"]


def test_a_job_that_broke_off_is_applied_again_and_a_whole_one_never(spark):
    path = f"{files.work_folder(spark)}/table"
    read = lambda: rows_of(files.read_applied(spark, path, spark.range(1).schema))
    assert read() == []
    spark.range(5).write.parquet(f"{path}/_job=load")
    local = f"{path.removeprefix('file:')}/_job=load/_SUCCESS"
    os.remove(local)  # as a driver leaves it that dies before the end
    assert read() == []
    assert files.apply_once(spark.range(3), path, "load") and not files.apply_once(spark.range(9), path, "load")
    assert files.apply_once(spark.range(7, 8), path, "more") and read() == [(0,), (1,), (2,), (7,)]


def test_rows_of_sinks_are_counted_and_arrivals_have_files_of_all_tasks(spark):
    """Tables are compared by one count of each row, so what is twice or in one of them only shows."""
    rows = lambda *v: spark.createDataFrame([(k, x) for k, x in v], "id long, x string")
    got = reconcile.copies([rows((1, "a"), (1, "a"), (2, None)), rows((1, "a"), (2, None)), rows((1, "b"))], ["id"])
    assert rows_of(got) == [(1, "a", 2, 1, 0), (1, "b", 0, 0, 1), (2, None, 1, 1, 0)]
    path = files.work_folder(spark)
    assert plans._arrive(spark.range(0, 400, 1, 3), path, 4, "id") == 3
    assert rows_of(spark.read.parquet(path)) == rows_of(spark.range(400))


def test_state_of_an_order_status_stream_is_kept_by_group(spark):
    """The calls on the state are as many as groups, not as documents, and each document has its own status all the same."""
    rng, start, base = random.Random(9), datetime(2025, 3, 1), files.work_folder(spark)
    commands = [(rng.choice([None, *range(300)]), start + timedelta(minutes=rng.randrange(50)), k, rng.choice(["approve", "reject", "resubmit"]), rng.choice(["why", 'a "b", [c]', "", None])) for k in range(1500)]
    for k in range(2):
        spark.createDataFrame(commands[k::2], COMMANDS).coalesce(1).write.mode("append").parquet(f"{base}/in")
    rows = streams.source(spark, f"{base}/in", spark.createDataFrame([], COMMANDS).schema, 1)
    query = streams.order_status_stream(rows, f"{base}/out", f"{base}/state", "2 hours", groups=4)
    assert rows_of(streams.current_status(spark, f"{base}/out")) == rows_of(purchasing.fold_status(spark.createDataFrame(commands, COMMANDS)))
    # a value and a timer (which Spark keeps by key and by time) of each group
    assert 4 <= query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 4
