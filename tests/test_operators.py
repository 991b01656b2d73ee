"""Scenarios of the migration, and the hard algorithms against their plain versions."""

from __future__ import annotations

import os
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from purchaseflow.functions import naming as n
from purchaseflow.operators import match, numbering, purchasing, reconcile, sync, validate
from purchaseflow.operators import versioned as v
from purchaseflow.sources import files

from .conftest import DATA


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_mutable_sort_key_collapses_by_primary_key(spark):
    """Two versions of one document under different dates are two rows of the sort key, but one document."""
    rows = spark.createDataFrame([("a", "2025-01-01", 1000, 0), ("a", "2025-02-01", 2000, 0), ("b", "2025-01-01", 1, 0), ("b", "2025-01-01", 3, 1)], "id string, day string, version long, is_deleted int")
    assert v.current_state(rows, ["id", "day"], ["version"]).count() == 3
    one = v.current_state(rows, ["id"], ["version"])
    assert rows_of(one.select("id", "version")) == [("a", 2000), ("b", 3)]
    assert rows_of(v.live(one).select("id")) == [("a",)]


def test_live_is_not_looked_up_before_the_newest_version(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "id int, version int, is_deleted int")
    assert v.lookup(rows, rows.select("id").distinct(), ["id"], ["version"]).count() == 0


def test_sixteen_digit_money_is_exact(spark):
    rows = spark.createDataFrame([(1, Decimal("98765432109876.54"), 0), (2, Decimal("1111.10"), 0)], "id int, total decimal(18,2), is_deleted int")
    got = reconcile.two_sides("t", rows, rows, "id", ["total"]).first()
    assert got.state == "MATCH" and got.sum_a_total == Decimal("98765432110987.64")


def test_sync_twice_and_in_any_order(spark):
    rng = random.Random(5)
    data = [(k, datetime(2025, 1, 1, k % 24, rng.randrange(60), m), f"v{m}") for k in range(40) for m in rng.sample(range(60), 3)]
    source = spark.createDataFrame(data, "id long, updated timestamp, value string")
    changes = sync.changes(source, "updated", sync.EPOCH)
    whole = rows_of(sync.apply_changes(changes.limit(0), changes, ["id"]))
    assert rows_of(sync.apply_changes(changes, changes, ["id"])) == whole
    now = changes.limit(0)
    for k in rng.sample(range(4), 4):
        now = sync.apply_changes(now, changes.where(F.pmod(F.hash("value"), F.lit(4)) == k), ["id"])
    assert rows_of(now) == whole
    state = spark.createDataFrame([(datetime(2025, 1, 1, 10),)], "synced_through timestamp")
    assert sync.watermark(state) == "2025-01-01 09:45:00" and sync.watermark(state.limit(0)) == sync.EPOCH


def test_validation_scenarios(spark):
    lines = spark.createDataFrame([(1, "p1"), (2, "P1"), (3, ""), (4, "gone"), (5, None)], "id int, parent string")
    parents = spark.createDataFrame([("p1",)], "pid string")
    assert [r.id for r in validate.orphans(lines, "parent", parents, "pid", ignore_case=True).collect()] == [4]
    assert sorted(r.id for r in validate.orphans(lines, "parent", parents, "pid", empty_is_none=False).collect()) == [2, 3, 4]
    users = spark.createDataFrame([("ann", 0), ("ann", 1), ("bob", 0), ("bob", 0)], "name string, is_deleted int").withColumn("id", F.monotonically_increasing_id())
    assert [r.name for r in validate.duplicates(v.live(users), ["name"], "id").collect()] == ["bob"]
    texts = spark.createDataFrame([(1, "12", "2025-02-30"), (2, "x", "2025-02-28"), (3, "", None)], "id int, n string, day string")
    good, errors = validate.convert_all(texts, "id", {"n": "long", "day": "date"})
    assert rows_of(errors.select("id", "column_name")) == [(1, "day"), (2, "n")]
    assert rows_of(good.select("id", "n")) == [(1, 12), (2, None), (3, None)]


def test_failed_check_leaves_what_was_there(spark):
    path = files.work_folder(spark)
    old, new = spark.range(3), spark.range(9)
    files.publish(old, path, {})
    assert files.publish(new, path, {"bad": new.where("id > 7")}) == {"bad": 1}
    assert spark.read.parquet(path).count() == 3
    files.publish(new, path, {"bad": new.where("id > 70")})
    assert spark.read.parquet(path).count() == 9


def test_a_failed_move_leaves_the_old_table(spark, monkeypatch):
    path = files.work_folder(spark)
    files.replace_table(spark.range(3), path)
    move = files._move
    monkeypatch.setattr(files, "_move", lambda s, a, b: ".staged-" not in a and move(s, a, b))
    with pytest.raises(OSError):
        files.replace_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    monkeypatch.undo()
    files.replace_table(spark.range(9), path)
    assert spark.read.parquet(path).count() == 9
    left = path.rsplit("/", 1)[0]
    assert [x for x in os.listdir(left) if "staged" in x or "old" in x] == []


def test_a_failed_sync_leaves_the_watermark(spark):
    base = files.work_folder(spark)
    rows = spark.createDataFrame([(1, datetime(2025, 1, 1, 9)), (2, datetime(2025, 1, 1, 11))], "id long, updated timestamp")
    bad = rows.withColumn("broken", F.raise_error(F.lit("no")).cast("string"))
    sync.advance(spark, f"{base}/state", "2025-01-01 10:00:00")
    with pytest.raises(Exception, match="no"):
        sync.run({"good": (rows, "updated", f"{base}/good"), "bad": (bad, "updated", f"{base}/bad")}, f"{base}/state", "2025-01-01 12:00:00")
    assert sync.watermark(spark.read.parquet(f"{base}/state")) == "2025-01-01 09:45:00"
    assert sync.run({"good": (rows, "updated", f"{base}/good")}, f"{base}/state", "2025-01-01 12:00:00") == "2025-01-01 09:45:00"
    assert sync.watermark(spark.read.parquet(f"{base}/state")) == "2025-01-01 11:45:00"
    # the failed run may have copied the good table already; versions make that harmless
    good = spark.read.parquet(f"{base}/good")
    assert {r.id for r in good.collect()} == {2} and sync.apply_changes(good.limit(0), good, ["id"]).count() == 1


def test_numbers_run_on_from_nothing(spark, tmp_path):
    from purchaseflow.plans import registry

    for name in ("part", "orders", "events"):
        table = spark.read.parquet(f"{DATA}/{name}.parquet")
        (table.limit(0) if name == "part" else table).write.parquet(f"{tmp_path}/{name}.parquet")
    made = registry.queries()["w5_deferred_ids"](spark, str(tmp_path)).agg(F.min("new_id"), F.max("new_id"), F.count("*")).first()
    assert made[0] == 1 and made[1] == made[2] > 0
    assert registry.queries()["m14_item_requests"](spark, str(tmp_path)).agg(F.min("item_no")).first()[0] == 1


def test_vat_only_where_it_is_included(spark):
    lines = spark.createDataFrame([(k, Decimal("10"), Decimal("100"), 0) for k in (1, 2, 3)], "po_id int, ordered_qty decimal(18,4), unit_price decimal(18,2), is_deleted int")
    terms = spark.createDataFrame([(1, 10, Decimal("100"), "pph23", True), (2, 10, Decimal("100"), "pph23", False), (3, 10, Decimal("100"), "", None)], "po_id int, discount_pct int, charges decimal(18,2), withholding string, include_vat boolean")
    got = {r.po_id: (float(r.vat), float(r.withheld), float(r.total)) for r in purchasing.order_totals(lines, terms).collect()}
    assert got == {1: (110.0, 18.0, 1092.0), 2: (0.0, 18.0, 982.0), 3: (0.0, 0.0, 1000.0)}


def test_relational_tables_are_read_in_parts(spark):
    from purchaseflow.sources import relational

    url = "jdbc:derby:memory:orders;create=true"
    rows = spark.createDataFrame([(k, f"n{k}") for k in range(1, 101)] + [(None, "none")], "ID int, NAME string")
    rows.coalesce(1).write.format("jdbc").option("url", url).option("dbtable", "orders").save()
    got = relational.read_table(spark, url, "orders", "ID", 4)
    assert got.rdd.getNumPartitions() == 4
    assert rows_of(got) == rows_of(rows)
    changed = got.where("ID > 90").select("NAME")
    assert changed.count() == 10 and "GreaterThan(ID,90)" in changed._jdf.queryExecution().executedPlan().toString()
    rows.limit(0).write.format("jdbc").option("url", url).option("dbtable", "nothing").save()
    assert relational.read_table(spark, url, "nothing", "ID", 4).count() == 0


def test_legacy_ids(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 0), (3, 8, 1), (4, 8, 1), (5, 9, 0), (6, 9, 0), (7, None, 0)], "pk int, legacy_id int, is_deleted int")
    got = {r.pk: (r.fixed_id, r.conflict) for r in numbering.repair_all(rows, "legacy_id", ["pk"]).collect()}
    assert got == {1: (None, False), 2: (7, False), 3: (8, False), 4: (None, False), 5: (9, True), 6: (9, True), 7: (None, False)}


def test_dense_numbers_need_no_single_task(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 3000)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(7)
    got = {r.id: r.number for r in numbering.dense_numbers(df, ["id"], 100).collect()}
    assert got == {i: 100 + k for k, i in enumerate(sorted(ids), 1)}
    assert numbering.dense_numbers(df.limit(0), ["id"]).count() == 0


def test_padding_is_a_minimum(spark):
    row = spark.range(1).select(numbering.padded("PR", F.lit(7), 3, F.lit(2025)).alias("a"), numbering.padded("ITEM", F.lit(12345), 4).alias("b")).first()
    assert tuple(row) == ("PR-2025-007", "ITEM-12345")


def plain_indel(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            table[i][j] = i + j if not i or not j else table[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(table[i - 1][j], table[i][j - 1])
    return table[-1][-1]


def test_fuzzy_pairs_are_those_of_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdxyz", k=rng.choice([1, 2, 5, 9, 10, 11, 19, 30]))) for _ in range(60)]

    def typo(s):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(s) + 1)
            s = s[:k] + rng.choice(["", "q", s[k : k + 1]]) + s[k + rng.randrange(2) :]
        return s

    left, right = [(k, typo(s)) for k, s in enumerate(base * 2)], [(1000 + k, s) for k, s in enumerate(base)] + [(2000, "")]
    want = {(a, b) for _, a in left for _, b in right if a and b and 100 * (1 - plain_indel(a, b) / (len(a) + len(b))) >= 90}
    got = match.similar_pairs(spark.createDataFrame(left, "id long, key string"), spark.createDataFrame(right, "id long, key string"))
    assert {(r.key, r.key_b) for r in got.collect()} == want


def test_greedy_rounds_are_the_sequential_rule(spark):
    rng = random.Random(4)
    for size in (1, 12, 40):
        pairs = {(a, b) for a, b in ((rng.randrange(size), rng.randrange(size)) for _ in range(size * 2)) if a < b}
        kept = {}
        for j in range(size):
            kept[j] = not any(kept[i] for i, x in pairs if x == j)
        got = match.greedy_new(spark.createDataFrame(sorted(pairs), "earlier long, later long"), spark.range(size), lambda df: spark.createDataFrame(df.collect(), df.schema))
        assert {r.id: r.kept for r in got.collect()} == kept


def test_new_items_are_those_of_the_sequential_rule(spark):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdxyz", k=rng.choice([11, 19, 30]))) for _ in range(25)]

    def near(a, b):
        return a == b or 100 * (1 - plain_indel(a, b) / (len(a) + len(b))) >= 90

    typo = lambda s: s[: (k := rng.randrange(len(s)))] + "q" + s[k + rng.randrange(2) :]
    master = [(1000 + k, s) for k, s in enumerate(base[:8])]
    batch = [(k, rng.choice([s, typo(s), typo(typo(s))])) for k, s in enumerate(base * 3)]
    known, want = [s for _, s in master], {}
    for k, s in batch:
        want[k] = not any(near(s, x) for x in known)
        if want[k]:
            known.append(s)
    cut = lambda df: spark.createDataFrame(df.collect(), df.schema)
    got = match.new_items(spark.createDataFrame(batch, "id long, key string"), spark.createDataFrame(master, "id long, key string"), cut)
    assert {r.id: r.kept for r in got.collect()} == want and 0 < sum(want.values()) < len(batch)
    assert match.new_items(spark.createDataFrame([], "id long, key string"), spark.createDataFrame(master, "id long, key string"), cut).count() == 0


def test_order_state_machine(spark):
    rows = [(1, 1, 1, "approve", ""), (1, 2, 2, "reject", "late"), (2, 1, 1, "reject", ""), (2, 2, 2, "reject", "no"), (2, 3, 3, "resubmit", ""), (2, 4, 4, "approve", "")]
    got = rows_of(purchasing.fold_status(spark.createDataFrame(rows, "document_id long, at long, seq long, action string, note string")))
    assert got == [(1, "approved", 1, 2), (2, "approved", 1, 4)]


def test_bilingual_names(spark):
    cases = {"锚索 PC Strand Φ17.8": ("锚索", "PC Strand"), "VRLA 电池 Lead Acid Battery": ("电池", "VRLA Lead Acid Battery"), "面粉": ("面粉", ""), "Bread Flour": ("", "Bread Flour"), "Bolt M16*50": ("", "Bolt"), "": ("", "")}
    df = spark.createDataFrame([(k,) for k in cases], "name string")
    cn, en = n.split_bilingual(F.col("name"))
    assert {r.name: (r.cn, r.en) for r in df.select("name", cn.alias("cn"), en.alias("en")).collect()} == cases


def test_specifications(spark):
    cases = {"Seamless Pipe SCH40": ("Seamless Pipe", "SCH40", "sch_size"), "Wire Rope - φ26": ("Wire Rope", "φ26", "diameter"), "DN100": (None, None, "manual"), "Gate Valve DN 100 brass": ("Gate Valve", "DN 100 brass", "dn_size"), "Plain": ("Plain", None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "name string").select("name", n.extract_spec(F.col("name"), F.lit(None).cast("string")).alias("s"))
    assert {r.name: tuple(r.s) for r in df.collect()} == cases


def test_uom_maps_disagree(spark):
    df = spark.createDataFrame([("盒",), ("unit",), ("PCS",), ("xyz",)], "u string")
    got = {r.u: (r.a, r.b) for r in df.select("u", n.normalise_uom(F.col("u"), n.UOM_INGEST).alias("a"), n.normalise_uom(F.col("u"), n.UOM_CANONICAL, False).alias("b")).collect()}
    assert got == {"盒": ("box", "drum"), "unit": ("unit", "pcs"), "PCS": ("pcs", "pcs"), "xyz": ("xyz", "xyz")}


def test_rollup_and_fulfilment(spark):
    lines = spark.createDataFrame([(1, "rejected"), (1, "rejected"), (2, "approved"), (2, "rejected"), (3, "pending"), (3, "approved")], "pr_id int, status string")
    assert rows_of(purchasing.roll_up(lines)) == [(1, "rejected"), (2, "approved"), (3, None)]


def test_search_of_every_fiftieth_item(spark, tmp_path):
    from purchaseflow.plans import registry

    rng = random.Random(5)
    words = ["almond", "antique", "aqua", "azure", "beige", "bisque", "black", "blush", "brown", "chiffon"]
    part = [(k, " ".join(rng.sample(words, 3)), "TYPE", f"Brand#{k % 5}", k % 50) for k in range(1, 301)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")

    def two(x: str) -> set[str]:
        return {x.lower()[i : i + 2] for i in range(len(x) - 1)}

    full = {k: name + (" 轴承" if k % 3 == 0 else "" if k % 3 == 1 else " 水泵 M16*50") for k, name, *_ in part}
    fields = {k: ((3, two(name)), (3, two(full[k])), (2, two(f"{size}mm")), (1, two(str(k)))) for k, name, _, _, size in part}

    def search(text: str, k: int) -> list[tuple[float, int]]:
        g = two(text)
        scores = [(1 - sum(w * len(g & have) for w, have in fields[i]) / (9 * len(g)), i) for i in fields] if g else []
        return sorted(x for x in scores if x[0] <= 0.4)[:k]

    got = registry.queries()["j12_search_top_k"](spark, str(tmp_path)).collect()
    want = [(q, i, p, round(s, 9)) for q, name, *_ in part if q % 50 == 0 for p, (s, i) in enumerate(search(name, 5), 1)]
    assert len({q for q, *_ in want}) == 6
    assert sorted((r.query_id, r.item_id, r.place, round(r.score, 9)) for r in got) == sorted(want)

    want = []
    for q in range(50, 301, 50):
        chinese = "".join(c for c in full[q] if "\u4e00" <= c <= "\u9fff")
        english = " ".join("".join(" " if "\u3000" <= c <= "\u9fff" else c for c in full[q]).split())
        best: dict[int, float] = {}
        for text in {full[q], english, chinese}:
            for s, i in search(text, 4):
                best[i] = min(s, best.get(i, 1.0))
        want += [(q, i, round(s, 9)) for s, i in sorted((s, i) for i, s in best.items())[:4]]
    got = registry.queries()["j13_multi_probe"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.item_id, round(r.score, 9)) for r in got) == sorted(want)
