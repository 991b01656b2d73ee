"""Documents on small tables: nulls, repeated decisions, empty tables, faults of every kind."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from purchaseflow.operators import documents, snapshot, validate
from purchaseflow.sources import files

REQUESTS = "pr_id long, status string, is_deleted int"
LINES = "pr_id long, line_no int, item_id long, requested_qty decimal(18,4), status string, is_deleted int, uom string"
ITEMS = "item_id long, name_en string"
DECISIONS = "seq long, pr_id long, line_no int, decision string, given_qty decimal(18,4), actor string, notes string"
SUBMISSIONS = "submission_id long, year int, vendor_name string, discount_pct int, withholding string, include_vat boolean"
ORDER_LINES = "submission_id long, position int, pr_id long, line_no int, qty decimal(18,4), unit_price decimal(18,2), purpose string"
CHARGES = "submission_id long, position int, kind string, amount decimal(18,2), description string"


def stored(spark):
    requests = spark.createDataFrame([(1, "pending", 0), (2, "pending", 1), (3, None, 0)], REQUESTS)
    rows = [(1, 1, 10, Decimal(5), "pending", 0, "box"), (1, 2, 11, None, None, 0, None), (1, 3, 12, Decimal(1), "pending", 1, ""), (2, 1, 10, Decimal(5), "approved", 0, "pcs"), (3, 1, None, Decimal(2), "approved", 0, "pcs")]
    return requests, spark.createDataFrame(rows, LINES), spark.createDataFrame([(10, "Valve"), (11, "")], ITEMS)


def test_decisions_follow_each_other(spark):
    rows = [
        (1, 1, 1, "approved", None, "a", None), (2, 1, 1, "rejected", Decimal(9), "b", "no"), (3, 1, 2, "approved", None, "a", None), (4, 1, 3, "approved", None, "a", None),
        (5, 2, 1, "approved", None, "a", None), (6, 9, 1, "approved", None, "a", None), (7, 1, 1, None, None, "a", None), (8, 1, 2, "approved", Decimal(4), None, None), (9, None, None, "approved", None, "a", ""),
    ]
    changed, actions, requests, refused = documents.decide_lines(*stored(spark), spark.createDataFrame(rows, DECISIONS))
    assert sorted(map(tuple, changed.collect())) == [(1, 1, "rejected", Decimal("0.0000")), (1, 2, "approved", Decimal("4.0000"))]
    seen = [tuple(r) for r in actions.orderBy("seq").select("seq", "from_status", "to_status", "approved_qty", "notes").collect()]
    assert seen == [(1, "pending", "approved", Decimal("5.0000"), "Item: Valve"), (2, "approved", "rejected", Decimal("0.0000"), "Item: Valve — no"), (8, None, "approved", Decimal("4.0000"), "Item: 11")]
    assert [tuple(r) for r in requests.collect()] == [(1, "approved")]
    reasons = dict(refused.select("seq", "reason").collect())
    assert reasons == {3: "quantity must be over 0", 4: "line not found", 5: "request not found", 6: "request not found", 7: "unknown decision", 9: "request not found"}


def test_requests_wait_for_pending_lines(spark):
    one = spark.createDataFrame([(1, 1, 1, "approved", None, "a", None)], DECISIONS)
    assert documents.decide_lines(*stored(spark), one)[2].count() == 0
    none = documents.decide_lines(*stored(spark), one.limit(0))
    assert [part.count() for part in none] == [0, 0, 0, 0]


def test_decisions_on_requests_leave_lines(spark):
    rows = [(1, 1, "approved", "a", None), (2, 1, "rejected", "a", "x"), (3, 2, "approved", "a", None), (4, 3, "approved", "", None), (5, 3, "perhaps", "a", None), (6, 3, "approved", "a", None)]
    changed, actions, refused = documents.decide_requests(stored(spark)[0], spark.createDataFrame(rows, "seq long, pr_id long, decision string, actor string, notes string"))
    assert dict(changed.collect()) == {1: "rejected", 3: "approved"}
    assert [tuple(r) for r in actions.orderBy("seq").select("seq", "from_status", "to_status").collect()] == [(1, "pending", "approved"), (2, "approved", "rejected"), (6, "", "approved")]
    assert dict(refused.select("seq", "reason").collect()) == {3: "request not found", 4: "actor and decision are required", 5: "unknown decision"}


def test_orders_are_refused_whole(spark):
    lines = stored(spark)[1]
    asked = [(1, 2024, "V", 10, "pph23", True), (2, 2024, "V", None, None, None), (3, 2024, None, 0, "", False), (4, 2024, "V", 0, "odd", False), (5, 2024, "V", 0, "", False), (6, 2023, "V", 500, "", False), (7, 2024, "V", 0, "", False), (8, 2024, "V", 0, "", False)]
    wanted = [(1, 7, 3, 1, Decimal(2), Decimal(100), None), (1, 9, 2, 1, Decimal(1), Decimal(50), "x"), (2, 1, 3, 1, None, Decimal(1), None), (4, 1, 3, 1, Decimal(1), Decimal(1), None), (6, 1, 3, 1, Decimal(1), Decimal("9.99"), None), (7, 1, 1, 1, Decimal(1), Decimal(1), None), (7, 2, 1, 9, Decimal(1), Decimal(1), None), (8, 1, 3, 1, Decimal(1), Decimal(1), None)]
    costs = [(1, 1, "freight", Decimal(20), "y" * 600), (8, 1, None, Decimal(1), None), (8, 2, "other", None, None), (6, 3, "other", Decimal(0), None)]
    headers, made, charges, refused = documents.create_orders(
        spark.createDataFrame(asked, SUBMISSIONS), spark.createDataFrame(wanted, ORDER_LINES), spark.createDataFrame(costs, CHARGES), lines, spark.createDataFrame([(2024, 41)], "year int, last_no int"),
    )
    got = {r["submission_id"]: r for r in headers.collect()}
    assert {k: r["doc_no"] for k, r in got.items()} == {1: "PO-2024-042", 6: "PO-2023-001"}
    # 250 less 10 %: 225; charges 20, VAT on 245: 26.95, withheld 4.50
    assert (got[1]["subtotal"], got[1]["vat"], got[1]["withheld"], got[1]["total"], got[1]["primary_pr"]) == (Decimal("250.00"), Decimal("26.95"), Decimal("4.50"), Decimal("267.45"), 3)
    assert got[6]["total"] == 0
    assert sorted(tuple(r) for r in made.select("doc_no", "po_line", "pr_id", "uom", "purpose").collect()) == [("PO-2023-001", 1, 3, "pcs", ""), ("PO-2024-042", 1, 3, "pcs", ""), ("PO-2024-042", 2, 2, "pcs", "x")]
    assert sorted(tuple(r) for r in charges.selectExpr("doc_no", "account", "length(description)").collect()) == [("PO-2023-001", "5190", 0), ("PO-2024-042", "5100", 500)]
    assert dict(refused.collect()) == {
        2: "a line needs request line, price and quantity", 3: "vendor and lines are required", 4: "unknown withholding: odd", 5: "vendor and lines are required", 7: "not approved: 1/1", 8: "unknown charge: ",
    }


def test_item_requests(spark):
    fields = "request_id long, name_en string, name_cn string, category string, spec string, uom string, is_deleted int"
    asked = spark.createDataFrame([(1, "Valve", None, "X", None, "", 0), (2, "", "阀", None, None, None, 0), (3, "Pump", None, None, None, None, 0), (4, "Gone", None, None, None, None, 1), (5, "Seal", None, None, None, "box", 0)], fields)
    told = spark.createDataFrame([(1, 1, "rejected", None), (2, 1, "approved", None), (3, 2, "approved", None), (4, 3, "rejected", "n"), (5, 4, "approved", None), (6, 9, "approved", None), (7, 5, "approved", "ok")], "seq long, request_id long, decision string, notes string")
    items, changed, refused = documents.decide_item_requests(asked, told, 7)
    assert [tuple(r) for r in items.orderBy("item_no").select("item_code", "name_en", "uom").collect()] == [("ITEM-0008", "Valve", "pcs"), ("ITEM-0009", "Seal", "box")]
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "approved", "", "ITEM-0008"), (3, "rejected", "n", None), (5, "approved", "ok", "ITEM-0009")]
    assert dict(refused.collect()) == {2: "name_en required", 4: "item request not found", 9: "item request not found"}


def test_snapshot_loses_no_row(spark):
    old = spark.createDataFrame([(1, 1, "a"), (None, 2, ""), (7, 3, None)], "pr_id long, approval_id int, approved_by string").selectExpr("*", "null as action", "'2020-13-01' as at", "null as notes")
    parents = spark.createDataFrame([(1,), (1,)], "pr_id long")
    got = snapshot.actions(old, parents, "2001-02-03 04:05:06").orderBy("approval_id").collect()
    assert [bool(r["request_key"]) for r in got] == [True, False, False]
    assert {(r["actor"], r["action"], str(r["action_at"])) for r in got} == {("a", "approve", "2001-02-03 04:05:06"), ("", "approve", "2001-02-03 04:05:06")}


def test_references_and_members_with_nulls(spark):
    children = spark.createDataFrame([(1, "a"), (2, ""), (None, None), (9, "b"), (9, "b")], "parent long, other string")
    parents = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    rules = [(children, {"first": ("parent", "p"), "second": ("other", "q")}), (children.limit(0), {"none": ("parent", "p")})]
    counts = validate.referential_counts(rules, {"p": (parents, "id"), "q": (spark.createDataFrame([("a",)], "k string"), "k")})
    assert dict(counts.collect()) == {"first": 3, "second": 2, "none": 0}
    assert sorted(map(tuple, validate.members(children, ["parent", "other"]).collect())) == [(9, "b", 2), (9, "b", 2)]
    nulls = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k long, id int")
    assert sorted(r["id"] for r in validate.members(nulls, ["k"]).collect()) == [1, 2]


def test_a_failed_load_leaves_the_old_version(spark):
    path, same = files.work_folder(spark), lambda stored: stored.where("id < 0")
    assert files.read_version(spark, path, spark.range(1).schema).count() == 0
    assert files.load(spark.range(3), path, {}, same)[0] == files.PUBLISHED
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    assert files.load(broken, path, {}, same)[0] == files.FAILED
    assert files.read_version(spark, path, spark.range(1).schema).count() == 3
    assert files.load(spark.range(9), path, {"bad": spark.range(2)}, same) == (files.REFUSED, {"bad": 2})
    assert files.load(spark.range(9), path, {}, lambda stored: stored.where("id = 8"))[0] == files.DIFFERENT
    assert files.read_version(spark, path, spark.range(1).schema).count() == 9


def test_refused_orders_are_found_without_making_any(spark, monkeypatch):
    """Only who asks for numbers pays for them; the sums of headers come with the check of the lines, not from a second pass."""
    sums = []
    monkeypatch.setattr(documents, "places", lambda *a: sums.append(a) or pytest.fail("numbered"))
    lines = stored(spark)[1]
    asked = spark.createDataFrame([(1, 2024, "V", 10, "", False), (2, 2024, "", 0, "", False), (3, 2024, "V", 0, "", False)], SUBMISSIONS)
    most = Decimal("9999999999999999.99")
    wanted = [(1, 7, 3, 1, Decimal(2), Decimal(100), None), (3, 1, 1, 1, Decimal("99999999999999"), most, None), (3, 2, 3, 1, Decimal(1), None, None)]
    new = documents.NewOrders(asked, spark.createDataFrame(wanted, ORDER_LINES), spark.createDataFrame([], CHARGES), lines, spark.createDataFrame([], "year int, last_no int"))
    assert dict(new.refused.collect()) == {2: "vendor and lines are required", 3: "not approved: 1/1"}
    assert [(r["doc_no"], r["subtotal"], r["discount_pct"], r["total"]) for r in new.headers.collect()] == [("PO-2024-001", Decimal("200.00"), 10, Decimal("180.00"))]


def test_refused_decisions_are_found_without_the_order_of_others(spark, monkeypatch):
    monkeypatch.setattr(documents, "neighbours", lambda *a, **k: pytest.fail("sorted"))
    rows = [(1, 1, 1, "approved", None, "a", None), (2, 9, 1, "approved", None, "a", None), (3, 1, 2, "rejected", None, "a", None)]
    decided = documents.LineDecisions(*stored(spark), spark.createDataFrame(rows, DECISIONS))
    assert dict(decided.refused.select("seq", "reason").collect()) == {2: "request not found"}
    assert [tuple(r) for r in decided.requests.collect()] == [(1, "approved")]
