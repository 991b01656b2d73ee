"""Prefix sums, allocation, budgets, bucketed tables, relational sinks and conversion against plain versions."""

from __future__ import annotations

import gzip
import json
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from purchaseflow.operators import ledger, prefix, validate
from purchaseflow.operators import versioned as v
from purchaseflow.plans import ledger as plans
from purchaseflow.sources import bucketed, files, relational
from purchaseflow.sources import tables as t


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(autouse=True)
def as_many_ranges_as_partitions(spark):
    """Small tables keep all their ranges, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sums_of_a_key_that_spans_all_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), k, rng.choice([None, 1, 5, -2])) for k in rng.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "k string, at long, x long").repartition(5)
    ranges = prefix.dealt(df, ["k"], ["at"]).where("k = 'hot'").select("_range").distinct().count()
    assert ranges > 1
    sums, want = defaultdict(int), []
    for k, at, x in sorted(rows, key=lambda r: r[1]):
        sums[k] += x or 0
        want.append((k, at, x, sums[k]))
    assert rows_of(prefix.running_sums(df, ["k"], ["at"], {"run": "x"})) == sorted(want, key=repr)
    assert prefix.running_sums(df.limit(0), ["k"], ["at"], {"run": "x"}).collect() == []


def test_neighbours_are_found_across_ranges(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, None]), at, rng.choice([None, None, None, at * 10])) for at in rng.sample(range(3000), 500)]
    got = prefix.neighbours(spark.createDataFrame(rows, "k int, at long, x long").repartition(3), ["k"], "at", ahead=["x"], behind=["x"])
    want = []
    for k, at, x in rows:
        own = sorted((r[1], r[2]) for r in rows if r[0] == k and r[2] is not None)
        want.append((k, at, x, next((b for a, b in own if a >= at), None), next((b for a, b in reversed(own) if a < at), None)))
    assert rows_of(got.select("k", "at", "x", "next_x", "last_x")) == sorted(want, key=repr)


def brute_allocation(sides):
    """Unit by unit."""
    units = {n: [doc for doc, q in sorted(rows) for _ in range(max(0, q))] for n, rows in sides.items()}
    return Counter(tuple(u[i] if i < len(u) else None for u in units.values()) for i in range(max(map(len, units.values()), default=0)))


def test_allocation_agrees_with_unit_by_unit(spark):
    rng = random.Random(6)
    data = {n: [(k, doc, rng.choice([0, -1, 1, 2, 3, 7])) for k in (1, 1, 1, 2, 3) for doc in rng.sample(range(1000), 30 if n != "c" else 12)] for n in "abc"}
    data["a"] = [r for r in data["a"] if r[0] != 3]  # a key that one side doesn't have
    sides = {n: spark.createDataFrame([*rows, (1, None, None)], "k int, doc long, q long") for n, rows in data.items()}
    pieces = ledger.allocate(sides, ["k"], "doc", [], "q").collect()
    for k in (1, 2, 3):
        got = Counter()
        for r in pieces:
            if r["k"] == k:
                got[r["a"], r["b"], r["c"]] += r["q"]
        assert got == brute_allocation({n: [(doc, q) for kk, doc, q in rows if kk == k] for n, rows in data.items()})
        own = sorted((r["begin"], r["q"]) for r in pieces if r["k"] == k)
        assert own[0][0] == 0 and all(a + q == b for (a, q), (b, _) in zip(own, own[1:]))
    assert ledger.allocate({n: s.limit(0) for n, s in sides.items()}, ["k"], "doc", [], "q").collect() == []


def test_three_way_rests_add_up(spark):
    d = lambda *rows: spark.createDataFrame(rows, "k int, doc long, q decimal(18,4)")
    from decimal import Decimal as D

    got = ledger.three_way_match(d((1, 1, D(10)), (1, 2, D(5))), d((1, 7, D(12))), d((1, 8, D(4)), (1, 9, D(14))), ["k"], "doc", [], "q").orderBy("begin").collect()
    assert [(r.order_doc, r.receipt_doc, r.invoice_doc, float(r.q), r.state) for r in got] == [
        (1, 7, 8, 4.0, "matched"), (1, 7, 9, 6.0, "matched"), (2, 7, 9, 2.0, "matched"), (2, None, 9, 3.0, "to be received"), (None, None, 9, 3.0, "beyond order"),
    ]
    assert sum(r.unreceived for r in got) == 3 and sum(r.unordered for r in got) == 3


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_are_not_shuffled(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("v1_bucketed", "j1_bucketed", "j2_bucketed"):
            plan = plan_of(getattr(plans, name)(spark, sf_dir))
            assert "Exchange" not in plan and "SelectedBucketsCount" in plan, name
        # a table that isn't stored that way is what is shuffled
        assert "Exchange" in plan_of(v.current_state(t.request_line_versions(spark, sf_dir), t.LINE_KEYS, t.LINE_ORDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_new_versions_touch_only_their_buckets(spark, sf_dir):
    path = files.work_folder(spark)
    rows = t.request_line_versions(spark, sf_dir)
    name = bucketed.create(rows.where("pr_id <> 7"), ["pr_id"], ["pr_id", "line_no"], 8, path=path)
    before = set(os.listdir(path.removeprefix("file:")))
    bucketed.append(name, rows.where("pr_id = 7"), ["pr_id"], ["pr_id", "line_no"], 8)
    more = {f for f in set(os.listdir(path.removeprefix("file:"))) - before if f.startswith("part")}
    assert len(more) == 1 and rows_of(bucketed.read(spark, name).select("pr_id", "line_no", "version")) == rows_of(rows.select("pr_id", "line_no", "version"))


def test_upsert_after_a_task_that_failed(spark):
    url = "jdbc:derby:memory:sink;create=true"
    old = spark.createDataFrame([(k, "old") for k in range(40)], "ID int, NAME string")
    old.write.format("jdbc").option("url", url).option("createTableColumnTypes", "NAME VARCHAR(40)").option("dbtable", "items").save()
    read = lambda: rows_of(spark.read.jdbc(url, "items"))
    news = spark.range(20, 2020, numPartitions=4).selectExpr("CAST(id AS INT) AS ID", "CONCAT('new', id) AS NAME")
    bad = news.withColumn("NAME", F.when(F.col("ID") == 1900, F.raise_error(F.lit("half-way"))).otherwise(F.col("NAME")))
    with pytest.raises(Exception, match="half-way"):
        relational.upsert(bad, url, "items", ["ID"])
    assert read() == rows_of(old)
    want = sorted([(k, "old") for k in range(20)] + [(k, f"new{k}") for k in range(20, 2020)], key=repr)
    for _ in range(2):
        relational.upsert(news, url, "items", ["ID"])
        assert read() == want
    # all tasks ran twice, as after the loss of an executor that had committed
    old.limit(0).withColumns({"_part": F.lit(0), "_attempt": F.lit(0).cast("long")}).write.format("jdbc").option("url", url).option("createTableColumnTypes", "NAME VARCHAR(40)").option("dbtable", "twice").save()
    for _ in range(2):
        relational._stage(news, url, "twice", {})
    assert spark.read.jdbc(url, "twice").count() == 2 * news.count()
    relational._execute(spark, url, [*relational._merge("twice", "items", news.columns, ["ID"]), "DROP TABLE twice"], {})
    assert read() == want
    tables = spark.read.format("jdbc").option("url", url).option("query", "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").load()
    assert [r[0] for r in tables.collect()] == ["ITEMS"]
    assert relational.rows_a_statement(2) == 500 and relational.rows_a_statement(100) == 300 and relational.rows_a_statement(50_000) == 1
    assert [tuple(r)[1:] for r in relational.statements_of(news).collect()] == [(500, 1)] * 4


def test_even_ranges_of_a_skewed_key(spark):
    url = "jdbc:derby:memory:skew;create=true"
    rng = random.Random(3)
    keys = [int(10 ** rng.uniform(0, 8)) for _ in range(1500)] + [10**9, None, None] + [5, 5, 5]
    rows = spark.createDataFrame([(k, f"n{i}") for i, k in enumerate(keys)], "ID int, NAME string")
    rows.coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "skew").save()
    got = relational.read_even(spark, url, "skew", "ID", 8)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert rows_of(got) == rows_of(rows) and max(sizes) <= 2 * len(keys) / 8 and len(sizes) >= 8
    linear = relational.read_table(spark, url, "skew", "ID", 8)
    assert max(r["count"] for r in linear.groupBy(F.spark_partition_id()).count().collect()) > 0.9 * len(keys)
    rows.limit(0).write.format("jdbc").option("url", url).option("dbtable", "nobody").save()
    assert relational.read_even(spark, url, "nobody", "ID", 8).count() == 0
    texts = spark.createDataFrame([(f"k'{i:03}",) for i in range(100)], "CODE string")
    texts.write.format("jdbc").option("url", url).option("createTableColumnTypes", "CODE VARCHAR(20)").option("dbtable", "codes").save()
    assert rows_of(relational.read_even(spark, url, "codes", "CODE", 4)) == rows_of(texts)


def test_files_that_can_not_be_read_are_reported(spark, tmp_path):
    line = lambda k: json.dumps({"id": k, "name": f"n{k}"}) + "\n"
    good = gzip.compress("".join(map(line, range(2000))).encode())
    sub = tmp_path / "sub"
    sub.mkdir()
    (tmp_path / "good.json.gz").write_bytes(good)
    (tmp_path / "two.json.gz").write_bytes(gzip.compress(line(3000).encode()) + gzip.compress(line(3001).encode()))
    (tmp_path / "cut.json.gz").write_bytes(good[: len(good) // 2])
    (tmp_path / "not.json.gz").write_bytes(b"plain text\n")
    (sub / "plain.json").write_text(line(4000) + "{broken\n" + line(4001))
    (sub / "half.json.tmp").write_text(line(5000))
    (tmp_path / "~$open.json").write_text(line(5001))
    rows, report = files.read_what_can(spark, str(tmp_path), StructType().add("id", "long").add("name", "string"))
    states = {r["file"].rsplit("/", 1)[1]: r["state"] for r in report.collect()}
    assert {k: s for k, s in states.items() if s == "unreadable"} == {"cut.json.gz": "unreadable", "not.json.gz": "unreadable"}
    assert {k for k, s in states.items() if s == "read"} == {"good.json.gz", "two.json.gz", "plain.json"}
    got = rows.collect()
    assert sorted(r["id"] for r in got if r["id"] is not None) == [*range(2000), 3000, 3001, 4000, 4001]
    assert [r["_corrupt_record"] for r in got if r["id"] is None] == ["{broken"]


def test_conversion_counts_in_the_same_pass(spark):
    target = StructType().add("n", "short", False).add("amount", "decimal(5,2)").add("note", "string")
    texts = spark.createDataFrame([(1, "1", "1.50", "a"), (2, None, "12345", None), (3, "99999", "x", "\x00"), (4, " 1", "", "ok")], "id int, n string, amount string, note string")
    counts = Observation("counts")
    out = validate.convert_to(texts, target, counts)
    got = {r.id: [e["column_name"] for e in r.errors] for r in out.collect()}
    assert got == {1: [], 2: ["n", "amount"], 3: ["n", "amount", "note"], 4: ["n", "amount"]}
    assert counts.get == {"n_rows": 4, "n_bad": 3, "n": 3, "amount": 3, "note": 1}
    with pytest.raises(TypeError):
        validate.convert_to(texts, StructType().add("n", "binary"))
    assert len(re.findall("Scan", out._jdf.queryExecution().executedPlan().toString())) == 1


def test_keyword_rules_against_all_rules_in_turn(spark, monkeypatch):
    from purchaseflow.operators import keywords

    rng = random.Random(12)
    letters = "abcde"
    rules = [(s, rng.randrange(3000), f"c{rng.randrange(40)}", "".join(rng.choices(letters, k=rng.randrange(2, 6))).upper()) for s in ("x", "y") for _ in range(2500)]
    rules += [("z", 9, "all", ""), ("z", 4, "Nut", "NUT"), ("x", 1, "null", None), ("other", 0, "o", "a")]
    texts = [None, "", "walnut", "Ñandú NUT"] + ["".join(rng.choices(letters + " ", k=rng.randrange(30))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    table = spark.createDataFrame(rules, "rule_set string, rule_no int, category string, keyword string")

    def first(text, s):
        hits = [no for q, no, _, w in rules if q == s and w is not None and text is not None and w.lower() in text.lower()]
        return min(c for q, no, c, _ in rules if q == s and no == min(hits)) if hits else "none"

    want = [(i, x, *(first(x, s) for s in "xyz")) for i, x in enumerate(texts)]
    for size in (keywords.PORTION, 4000):  # at once, and in portions
        monkeypatch.setattr(keywords, "PORTION", size)
        assert rows_of(keywords.classify(rows, "text", table, ["x", "y", "z"], "none")) == sorted(want, key=repr)
    assert rows_of(keywords.classify(rows, "text", table.limit(0), ["x"], "none").select("x").distinct()) == [("none",)]


def test_buckets_grow_with_the_table(spark, sf_dir, monkeypatch):
    assert bucketed.buckets_for(spark.range(100)) == 8
    monkeypatch.setattr(bucketed, "ROWS", 300)
    lines = t.scan(spark, sf_dir, "lineitem").count()
    assert bucketed.buckets_for(spark.range(2500)) == 9
    got = plan_of(plans.j2_bucketed(spark, sf_dir))
    assert f"out of {-(-lines // 300)}" in got and rows_of(plans.j2_bucketed(spark, sf_dir).select("pr_id", "line_no")) == rows_of(plans._num(plans.bucketed_current(spark, sf_dir)).select("pr_id", "line_no"))


def test_ranges_grow_with_the_rows(spark, monkeypatch):
    """A task has as many rows of a large table as of a small one, and only the keys at the ends of ranges are looked at twice."""
    monkeypatch.setattr(prefix, "ROWS", 100)
    rng = random.Random(10)
    rows = [(rng.choice(["hot", "hot", None, *(f"k{i}" for i in range(300))]), at, rng.randrange(1, 6)) for at in rng.sample(range(9000), 1950)]
    df = spark.createDataFrame(rows, "k string, at long, x long").repartition(3)
    assert prefix.parts_for(df) == 20 and prefix.parts_for(df.limit(100)) == 0
    got, sums, want = prefix.running_sums(df, ["k"], ["at"], {"run": "x"}), defaultdict(int), []
    for k, at, x in sorted(rows, key=lambda r: r[1]):
        sums[k] += x
        want.append((k, at, x, sums[k]))
    assert got.rdd.getNumPartitions() == 20 and rows_of(got) == sorted(want, key=repr)
    ranges = prefix.dealt(df, ["k"], ["at"], 20)
    assert ranges.groupBy(prefix.RANGE).count().agg(F.max("count")).first()[0] < 200
    shared = prefix._shared(ranges, ["k"], n=F.count(F.lit(1)))
    assert rows_of(shared) == rows_of(ranges.groupBy("k", prefix.RANGE).count().join(ranges.groupBy("k").agg(F.count_distinct(prefix.RANGE).alias("r")).where("r > 1").withColumnRenamed("k", "_k"), F.expr("k <=> _k")).select("k", prefix.RANGE, "count"))
    assert prefix._edges(ranges, ["k"]).count() <= 2 * 20
    # of all sides together, and so of the pieces
    sides = {n: spark.createDataFrame([(k % 5, k, rng.randrange(1, 9)) for k in range(300)], "k int, doc long, q long") for n in "ab"}
    pieces = ledger.allocate(sides, ["k"], "doc", [], "q")
    assert pieces.rdd.getNumPartitions() == 6
    for k in range(5):
        made = Counter()
        for r in pieces.where(f"k = {k}").collect():
            made[r["a"], r["b"]] += r["q"]
        assert made == brute_allocation({n: [(r.doc, r.q) for r in s.where(f"k = {k}").collect()] for n, s in sides.items()})
