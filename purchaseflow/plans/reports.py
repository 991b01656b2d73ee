"""Registered queries: versioned tables, joins, reports, calculations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from purchaseflow.operators import numbering, prefix
from purchaseflow.operators import purchasing as p
from purchaseflow.operators import versioned as v
from purchaseflow.sources import tables as t

from .registry import query

WITH = "WITH " + t.SQL
ORDERED = "od AS (SELECT pr_id, line_no, CAST(sum(ordered_qty) AS DECIMAL(18,4)) AS ordered_qty FROM ol WHERE is_deleted = 0 GROUP BY ALL)"


def _num(df: DataFrame) -> DataFrame:
    """Decimals as doubles, which both engines print alike."""
    return df.withColumns({c: F.col(c).cast("double") for c, kind in df.dtypes if kind.startswith("decimal")})


def current_lines(spark: SparkSession, d: str) -> DataFrame:
    return v.current_state(t.request_line_versions(spark, d), t.LINE_KEYS, t.LINE_ORDER)


LINE = ("pr_id", "line_no", "item_id", "vendor_id", "requested_qty", "price", "status", "is_deleted")
LINE_SQL = "pr_id, line_no, item_id, vendor_id, CAST(requested_qty AS DOUBLE) AS requested_qty, CAST(price AS DOUBLE) AS price, status, is_deleted"

REQUEST_LIST_SQL = f"""{WITH}, {ORDERED},
s AS (SELECT ln.pr_id, ln.status, ln.approved_qty, coalesce(od.ordered_qty, 0) AS ordered_qty FROM ln LEFT JOIN od USING (pr_id, line_no) WHERE is_deleted = 0),
c AS (SELECT pr_id, count(*) AS item_count, count(*) FILTER (status = 'approved') AS approved_count,
             count(*) FILTER (status = 'approved' AND ordered_qty >= approved_qty) AS fulfilled_count FROM s GROUP BY pr_id),
j AS (SELECT rq.pr_id, requester_id, status, priority, coalesce(item_count, 0) AS item_count, coalesce(approved_count, 0) AS approved_count, coalesce(fulfilled_count, 0) AS fulfilled_count
      FROM rq LEFT JOIN c USING (pr_id) WHERE is_deleted = 0)
SELECT *, CASE WHEN status = 'approved' THEN CASE WHEN approved_count = 0 THEN 'unfulfilled' WHEN fulfilled_count >= approved_count THEN 'fulfilled' WHEN fulfilled_count > 0 THEN 'partial' ELSE 'unfulfilled' END END AS fulfilment,
       CAST(approved_count AS VARCHAR) || '/' || CAST(item_count AS VARCHAR) || ' approved' AS approval FROM j"""


@query("request_list", REQUEST_LIST_SQL)
def request_list(spark, d):
    out = p.request_list(t.requests(spark, d), current_lines(spark, d), t.order_lines(spark, d))
    return out.select("pr_id", "requester_id", "status", "priority", "item_count", "approved_count", "fulfilled_count", "fulfilment", "approval")


@query("a1_request_counts", f"SELECT pr_id, item_count, approved_count, fulfilled_count FROM ({REQUEST_LIST_SQL})")
def request_counts(spark, d):
    return request_list(spark, d).select("pr_id", "item_count", "approved_count", "fulfilled_count")


@query("m3_list_fulfilment", f"SELECT fulfilment, count(*) AS n FROM ({REQUEST_LIST_SQL}) GROUP BY fulfilment")
def m3(spark, d):
    return request_list(spark, d).groupBy("fulfilment").agg(F.count(F.lit(1)).alias("n"))


@query("m5_approval_text", f"SELECT approval, count(*) AS n FROM ({REQUEST_LIST_SQL}) GROUP BY approval")
def m5(spark, d):
    return request_list(spark, d).groupBy("approval").agg(F.count(F.lit(1)).alias("n"))


@query("v1_current_state", f"{WITH} SELECT {LINE_SQL} FROM ln")
def v1(spark, d):
    return _num(current_lines(spark, d).select(*LINE))


@query("v2_pk_collapse", f"{WITH} SELECT pr_id, line_no, count(*) AS n_rows, strftime(max(version), '%Y-%m-%d') AS kept_version, strftime(min(version), '%Y-%m-%d') AS oldest_version FROM lv GROUP BY ALL HAVING count(*) > 1")
def v2(spark, d):
    out = v.collapse_report(t.request_line_versions(spark, d), t.LINE_KEYS, "version")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("kept_version", "oldest_version")})


@query("v3_ambiguous_versions", f"{WITH} SELECT pr_id, line_no, count(DISTINCT (item_id, vendor_id, requested_qty, price)) AS n_contents FROM lv GROUP BY pr_id, line_no, version HAVING count(DISTINCT (item_id, vendor_id, requested_qty, price)) > 1")
def v3(spark, d):
    return v.ambiguous(t.request_line_versions(spark, d), t.LINE_KEYS, "version", ("item_id", "vendor_id", "requested_qty", "price")).drop("version")


@query("v4_live", f"{WITH} SELECT {LINE_SQL} FROM ln WHERE is_deleted = 0")
def v4(spark, d):
    return _num(v.live(current_lines(spark, d)).select(*LINE))


@query("v5_key_lookup", f"{WITH} SELECT {LINE_SQL} FROM ln WHERE is_deleted = 0 AND pr_id IN (SELECT pr_id FROM rq WHERE status = 'rejected')")
def v5(spark, d):
    wanted = t.requests(spark, d).where("status = 'rejected'").select("pr_id")
    return _num(v.lookup(t.request_line_versions(spark, d), wanted, t.LINE_KEYS, t.LINE_ORDER).select(*LINE))


@query("v6_soft_delete", f"{WITH} SELECT pr_id, line_no, 1 AS is_deleted FROM ln WHERE is_deleted = 0 AND status = 'rejected'")
def v6(spark, d):
    lines = current_lines(spark, d)
    return v.tombstones(lines, lines.where("status = 'rejected'"), t.LINE_KEYS, F.current_timestamp()).select("pr_id", "line_no", "is_deleted")


@query("v7_cascade_delete", f"{WITH} SELECT pr_id, line_no, 1 AS is_deleted FROM ln WHERE is_deleted = 0 AND pr_id IN (SELECT pr_id FROM rq WHERE is_deleted = 1)")
def v7(spark, d):
    doomed = t.requests(spark, d).where("is_deleted = 1")
    return v.tombstones(current_lines(spark, d), doomed, ["pr_id"], F.current_timestamp()).select("pr_id", "line_no", "is_deleted")


@query("v8_insert_if_absent", f"{WITH} SELECT c_custkey AS requester_id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT requester_id FROM rq)")
def v8(spark, d):
    seed = t.scan(spark, d, "customer").select(F.col("c_custkey").alias("requester_id"), F.col("c_name").alias("name"))
    return v.insert_if_absent(t.requests(spark, d), seed, ["requester_id"])


@query("v9_upsert_greatest", f"{WITH} SELECT coalesce(a.y, b.y) AS y, greatest(a.last_no, b.last_no) AS last_no FROM (SELECT year(pr_date) AS y, count(*) AS last_no FROM rq WHERE status = 'approved' GROUP BY 1) a FULL JOIN (SELECT year(version) AS y, count(*) AS last_no FROM lv GROUP BY 1) b ON a.y = b.y")
def v9(spark, d):
    a = t.requests(spark, d).where("status = 'approved'").groupBy(F.year("pr_date").alias("y")).agg(F.count(F.lit(1)).alias("last_no"))
    b = t.request_line_versions(spark, d).groupBy(F.year("version").alias("y")).agg(F.count(F.lit(1)).alias("last_no"))
    return v.upsert_greatest(a, b, ["y"], "last_no")


@query("v10_batch_update", f"{WITH} SELECT item_id, CASE WHEN size % 3 = 0 THEN brand ELSE name_en END AS name_en, category FROM it WHERE size % 2 = 0")
def v10(spark, d):
    current = t.items(spark, d).select("item_id", "name_en", "category")
    new = t.items(spark, d).where("size % 2 = 0").select("item_id", F.when(F.col("size") % 3 == 0, F.col("brand")).otherwise("").alias("name_en"), F.lit(None).cast("string").alias("category"))
    return v.batch_update(current, new, "item_id", ("name_en", "category"))


@query("v11_carry_forward", f"""{WITH} SELECT document_id, action FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY "at" DESC, event_id DESC) AS rn FROM cm) WHERE rn = 1""")
def v11(spark, d):
    return v.carry_forward(t.commands(spark, d), "document_id", "action", ("at", "event_id"))


@query("v12_hard_delete", f"{WITH} SELECT item_id FROM it WHERE NOT (is_deleted = 1 AND item_id NOT IN (SELECT item_id FROM ol))")
def v12(spark, d):
    items = t.items(spark, d)
    return v.hard_delete(items, items.where("is_deleted = 1"), "item_id", {"n_order_lines": t.order_lines(spark, d)})[0].select("item_id")


@query("j15_blocked_deletes", f"{WITH} SELECT item_id, coalesce(a, 0) AS n_order_lines, coalesce(b, 0) AS n_request_lines FROM it LEFT JOIN (SELECT item_id, count(*) a FROM ol GROUP BY 1) USING (item_id) LEFT JOIN (SELECT item_id, count(*) b FROM ln GROUP BY 1) USING (item_id) WHERE is_deleted = 1 AND coalesce(a, 0) + coalesce(b, 0) > 0")
def j15(spark, d):
    items = t.items(spark, d)
    return v.hard_delete(items, items.where("is_deleted = 1"), "item_id", {"n_order_lines": t.order_lines(spark, d), "n_request_lines": current_lines(spark, d)})[1]


@query("j1_headers_left_lines", f"{WITH} SELECT rq.pr_id, count(line_no) AS n_lines FROM rq LEFT JOIN (SELECT * FROM ln WHERE is_deleted = 0) USING (pr_id) GROUP BY rq.pr_id")
def j1(spark, d):
    lines = current_lines(spark, d).where("is_deleted = 0").select("pr_id", "line_no")
    return t.requests(spark, d).select("pr_id").join(lines, "pr_id", "left").groupBy("pr_id").agg(F.count("line_no").alias("n_lines"))


@query("j2_lines_ordered", f"{WITH}, {ORDERED} SELECT ln.pr_id, ln.line_no, CAST(coalesce(od.ordered_qty, 0) AS DOUBLE) AS ordered_qty FROM ln LEFT JOIN od USING (pr_id, line_no)")
def j2(spark, d):
    return _num(p.with_ordered(current_lines(spark, d), t.order_lines(spark, d)).select("pr_id", "line_no", "ordered_qty"))


@query("j3_lines_live_items", f"{WITH} SELECT pr_id, line_no, name_en FROM ln JOIN it USING (item_id) WHERE it.is_deleted = 0")
def j3(spark, d):
    return current_lines(spark, d).join(t.items(spark, d).where("is_deleted = 0").select("item_id", "name_en"), "item_id").select("pr_id", "line_no", "name_en")


@query("j4_lines_live_headers", f"{WITH} SELECT ln.pr_id, line_no, requester_id FROM ln JOIN rq USING (pr_id) WHERE rq.is_deleted = 0")
def j4(spark, d):
    return current_lines(spark, d).join(t.requests(spark, d).where("is_deleted = 0").select("pr_id", "requester_id"), "pr_id").select("pr_id", "line_no", "requester_id")


@query("j6_anti_join", f"{WITH} SELECT pr_id FROM rq WHERE pr_id NOT IN (SELECT pr_id FROM ln)")
def j6(spark, d):
    return t.requests(spark, d).select("pr_id").join(t.request_line_versions(spark, d).select("pr_id"), "pr_id", "left_anti")


@query("a2_ordered_quantity", f"{WITH}, {ORDERED} SELECT pr_id, line_no, CAST(ordered_qty AS DOUBLE) AS ordered_qty FROM od")
def a2(spark, d):
    return _num(p.ordered_quantity(t.order_lines(spark, d)))


@query("a3_order_list", f"{WITH} SELECT po_id, count(*) AS n_lines, string_agg(DISTINCT CAST(pr_id AS VARCHAR), ',' ORDER BY CAST(pr_id AS VARCHAR)) AS requests FROM ol WHERE is_deleted = 0 GROUP BY po_id")
def a3(spark, d):
    rows = t.order_lines(spark, d).where("is_deleted = 0")
    return rows.groupBy("po_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("pr_id").cast("string"), F.lit("")))), ",").alias("requests"))


@query("a4_requests_in_line_order", f"{WITH}, f AS (SELECT po_id, pr_id, min(line_no) AS first_line FROM ol GROUP BY ALL) SELECT po_id, string_agg(CAST(pr_id AS VARCHAR), ',' ORDER BY first_line, pr_id) AS requests FROM f GROUP BY po_id")
def a4(spark, d):
    first = t.order_lines(spark, d).groupBy("po_id", "pr_id").agg(F.min("line_no").alias("first_line"))
    return first.groupBy("po_id").agg(F.array_sort(F.collect_list(F.struct("first_line", "pr_id"))).alias("s")).select("po_id", F.array_join(F.transform("s", lambda x: x["pr_id"].cast("string")), ",").alias("requests"))


@query("a5_request_estimate", f"{WITH} SELECT pr_id, CAST(sum(price * requested_qty) AS DOUBLE) AS estimate FROM ln JOIN it USING (item_id) WHERE it.is_deleted = 0 AND ln.is_deleted = 0 GROUP BY pr_id")
def a5(spark, d):
    rows = current_lines(spark, d).where("is_deleted = 0").join(t.items(spark, d).where("is_deleted = 0").select("item_id"), "item_id")
    return _num(rows.groupBy("pr_id").agg(F.sum(F.col("price") * F.col("requested_qty")).alias("estimate")))


@query("a7_distinct_values", f"{WITH} SELECT DISTINCT priority FROM rq WHERE priority <> '' ORDER BY priority")
def a7(spark, d):
    return t.requests(spark, d).select("priority").where("priority != ''").distinct().orderBy("priority")


@query("a8_template_counts", f"{WITH} SELECT c.category, count(*) FILTER (it.is_deleted = 0) AS n_items FROM (SELECT DISTINCT category FROM it) c LEFT JOIN it USING (category) GROUP BY c.category")
def a8(spark, d):
    items = t.items(spark, d)
    live = items.where("is_deleted = 0").select("category", "item_id")
    return items.select("category").distinct().join(live, "category", "left").groupBy("category").agg(F.count("item_id").alias("n_items"))


@query("a9_nested_by_department", f"{WITH} SELECT coalesce(nullif(category, ''), 'Other') AS department, row_number() OVER (PARTITION BY coalesce(nullif(category, ''), 'Other') ORDER BY size, item_id) AS place, item_id FROM it WHERE is_deleted = 0")
def a9(spark, d):
    """Items in their place within their department; rows, as a department may have any number of them."""
    rows = t.items(spark, d).where("is_deleted = 0").withColumn("department", F.coalesce(F.nullif("category", F.lit("")), F.lit("Other")))
    return prefix.places(rows.select("department", "size", "item_id"), ["department"], ["size", "item_id"], "place").select("department", F.col("place").cast("long").alias("place"), "item_id")


@query("a10_roll_up", f"{WITH} SELECT pr_id, CASE WHEN bool_or(status IN ('', 'pending')) THEN NULL WHEN bool_and(status = 'rejected') THEN 'rejected' ELSE 'approved' END AS new_status FROM ln WHERE is_deleted = 0 GROUP BY pr_id")
def a10(spark, d):
    return p.roll_up(current_lines(spark, d).where("is_deleted = 0"))


TERMS_SQL = "tm AS (SELECT DISTINCT po_id, (po_id % 130) - 10 AS discount_pct, CAST(po_id % 7 * 1000 AS DECIMAL(18,2)) AS charges, CASE po_id % 5 WHEN 0 THEN 'pph23' WHEN 1 THEN 'pph15' WHEN 2 THEN 'pph22_solar' WHEN 3 THEN 'pph22_impor' ELSE '' END AS withholding, po_id % 3 <> 0 AS include_vat FROM ol)"


def terms(spark, d):
    kind = F.when(F.col("po_id") % 5 == 0, "pph23").when(F.col("po_id") % 5 == 1, "pph15").when(F.col("po_id") % 5 == 2, "pph22_solar").when(F.col("po_id") % 5 == 3, "pph22_impor").otherwise("")
    return t.order_lines(spark, d).select("po_id").distinct().select("po_id", (F.col("po_id") % 130 - 10).alias("discount_pct"), (F.col("po_id") % 7 * 1000).cast("decimal(18,2)").alias("charges"), kind.alias("withholding"), (F.col("po_id") % 3 != 0).alias("include_vat"))


TOTALS_SQL = f"""{WITH}, {TERMS_SQL},
s AS (SELECT po_id, round(CAST(sum(unit_price * ordered_qty) AS DECIMAL(28,6)), 2) AS subtotal FROM ol WHERE is_deleted = 0 GROUP BY po_id),
a AS (SELECT *, round(subtotal * CAST(least(greatest(discount_pct, 0), 100) AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS discount FROM s JOIN tm USING (po_id)),
b AS (SELECT *, CAST(subtotal - discount AS DECIMAL(18,2)) AS net FROM a),
c AS (SELECT *, CASE WHEN include_vat THEN round((net + charges) * CAST(0.11 AS DECIMAL(5,4)), 2) ELSE 0 END AS vat,
      round(net * CASE withholding WHEN 'pph23' THEN CAST(0.02 AS DECIMAL(5,4)) WHEN 'pph15' THEN CAST(0.012 AS DECIMAL(5,4)) WHEN 'pph22_solar' THEN CAST(0.003 AS DECIMAL(5,4)) WHEN 'pph22_impor' THEN CAST(0.025 AS DECIMAL(5,4)) ELSE CAST(0 AS DECIMAL(5,4)) END, 2) AS withheld FROM b)
SELECT po_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount AS DOUBLE) AS discount, CAST(vat AS DOUBLE) AS vat, CAST(withheld AS DOUBLE) AS withheld, CAST(net + charges + vat - withheld AS DOUBLE) AS total FROM c"""


@query("m1_order_totals", TOTALS_SQL)
def m1(spark, d):
    return _num(p.order_totals(t.order_lines(spark, d), terms(spark, d)).select("po_id", "subtotal", "discount", "vat", "withheld", "total"))


@query("a22_include_vat", f"SELECT po_id, CASE WHEN vat > 0 THEN 1 ELSE 0 END AS include_vat FROM ({TOTALS_SQL})")
def a22(spark, d):
    return p.order_totals(t.order_lines(spark, d), terms(spark, d)).select("po_id", F.when(F.col("vat") > 0, 1).otherwise(0).alias("include_vat"))


@query("m2_charge_accounts", f"{WITH} SELECT pr_id, CASE kind WHEN 'freight' THEN '5100' WHEN 'packing' THEN '5110' WHEN 'insurance' THEN '5120' WHEN 'handling' THEN '5130' ELSE '5190' END AS account FROM (SELECT pr_id, CASE substr(priority, 1, 1) WHEN '1' THEN 'freight' WHEN '2' THEN 'packing' WHEN '3' THEN 'insurance' WHEN '4' THEN 'handling' ELSE 'other' END AS kind FROM rq)")
def m2(spark, d):
    first = F.substring("priority", 1, 1)
    kind = F.when(first == "1", "freight").when(first == "2", "packing").when(first == "3", "insurance").when(first == "4", "handling").otherwise("other")
    table = F.create_map(*(F.lit(x) for kv in p.CHARGE_ACCOUNTS.items() for x in kv))
    return t.requests(spark, d).select("pr_id", table[kind].alias("account"))


WANTED = "coalesce(nullif(approved_qty, 0), nullif(requested_qty, 0), 0)"


@query("m4_line_fulfilment", f"{WITH}, {ORDERED}, s AS (SELECT ln.*, coalesce(od.ordered_qty, 0) AS oq FROM ln LEFT JOIN od USING (pr_id, line_no)) SELECT pr_id, line_no, CASE WHEN oq = 0 THEN 'unfulfilled' WHEN oq >= {WANTED} THEN 'fulfilled' ELSE 'partial' END AS fulfilment FROM s")
def m4(spark, d):
    return p.with_ordered(current_lines(spark, d), t.order_lines(spark, d)).select("pr_id", "line_no", p.line_fulfilment().alias("fulfilment"))


@query("m6_open_lines", f"{WITH}, {ORDERED} SELECT ln.pr_id, ln.line_no, name_en, CAST(coalesce(od.ordered_qty, 0) AS DOUBLE) AS ordered_qty FROM ln JOIN it USING (item_id) JOIN rq USING (pr_id) LEFT JOIN od USING (pr_id, line_no) WHERE ln.is_deleted = 0 AND ln.status = 'approved' AND it.is_deleted = 0 AND rq.is_deleted = 0 AND coalesce(od.ordered_qty, 0) < {WANTED}")
def m6(spark, d):
    return _num(p.open_lines(t.requests(spark, d), current_lines(spark, d), t.items(spark, d), t.order_lines(spark, d)).select("pr_id", "line_no", "name_en", "ordered_qty"))


@query("p5_unfulfilled_filter", f"{WITH}, {ORDERED} SELECT ln.pr_id, ln.line_no FROM ln LEFT JOIN od USING (pr_id, line_no) WHERE coalesce(od.ordered_qty, 0) < {WANTED}")
def p5(spark, d):
    return p.with_ordered(current_lines(spark, d), t.order_lines(spark, d)).where(F.col("ordered_qty") < p.wanted()).select("pr_id", "line_no")


M7_SQL = f"""{WITH}, {ORDERED}, lr AS (SELECT pr_id, status FROM rq WHERE is_deleted = 0),
b AS (SELECT ln.pr_id, ln.line_no, price * requested_qty AS amount, ln.status || ' ' || CASE WHEN coalesce(od.ordered_qty, 0) = 0 THEN 'unfulfilled' WHEN od.ordered_qty >= {WANTED} THEN 'fulfilled' ELSE 'partial' END AS text
      FROM ln JOIN it USING (item_id) LEFT JOIN od USING (pr_id, line_no) WHERE ln.is_deleted = 0 AND it.is_deleted = 0 AND ln.pr_id IN (SELECT pr_id FROM lr))
SELECT lr.pr_id, 'header' AS part, CAST(0 AS BIGINT) AS position, status AS text, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS amount FROM lr LEFT JOIN b USING (pr_id) GROUP BY lr.pr_id, status
UNION ALL SELECT pr_id, 'line', line_no, text, CAST(amount AS DOUBLE) FROM b
UNION ALL SELECT document_id, 'action', row_number() OVER (PARTITION BY document_id ORDER BY "at", event_id), action, 0.0 FROM cm WHERE event_id % 4 <> 0 AND document_id IN (SELECT pr_id FROM lr)"""


@query("m7_request_detail", M7_SQL)
def m7(spark, d):
    kind = F.when(F.col("event_id") % 4 == 0, "PO").otherwise("PR")
    actions = t.commands(spark, d).select(kind.alias("document_type"), "document_id", "at", F.col("event_id").alias("seq"), "action")
    return _num(p.request_detail(t.requests(spark, d), current_lines(spark, d), t.items(spark, d), t.order_lines(spark, d), actions))


@query("m8_order_detail", f"WITH tt AS ({TOTALS_SQL}) SELECT po_id, s_name AS vendor_name, n_lines, CAST(po_id % 7 * 1000 AS DOUBLE) AS charges, subtotal, vat, withheld, total, po_id % 4 <> 0 AS matches FROM tt JOIN (SELECT l_suppkey * 100 + month(l_shipdate) AS po_id, min(l_suppkey) AS s_suppkey, count(*) AS n_lines FROM lineitem WHERE l_linestatus = 'F' AND NOT l_tax >= 0.08 GROUP BY 1) USING (po_id) JOIN supplier USING (s_suppkey)")
def m8(spark, d):
    """Every fourth order's stored total is off by one, which the recomputed total shows."""
    lines, known = t.order_lines(spark, d), terms(spark, d)
    stored = p.order_totals(lines, known).select("po_id", (F.col("total") + F.when(F.col("po_id") % 4 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("stored_total"))
    out = p.order_detail(lines, known, t.vendors(spark, d), stored)
    return _num(out.select("po_id", "vendor_name", "n_lines", "charges", "subtotal", "vat", "withheld", "total", "matches"))


@query("j5_order_to_request_chain", f"{WITH} SELECT ol.po_id, count(*) AS n, count(ln.line_no) AS n_lines, count(rq.pr_id) AS n_requests FROM ol LEFT JOIN ln ON ol.pr_id = ln.pr_id AND ol.line_no = ln.line_no LEFT JOIN rq ON ln.pr_id = rq.pr_id GROUP BY ol.po_id")
def j5(spark, d):
    lines = current_lines(spark, d).select("pr_id", "line_no", F.lit(1).alias("has_line"))
    rows = t.order_lines(spark, d).select("po_id", "pr_id", "line_no").join(lines, ["pr_id", "line_no"], "left").join(t.requests(spark, d).select("pr_id", F.lit(1).alias("has_request")), "pr_id", "left")
    return rows.groupBy("po_id").agg(F.count(F.lit(1)).alias("n"), F.count("has_line").alias("n_lines"), F.count("has_request").alias("n_requests"))


@query("m9_apply_decisions", f"{WITH}, dc AS (SELECT pr_id, line_no, CASE WHEN item_id % 3 = 0 THEN 'rejected' ELSE 'approved' END AS decision, CASE WHEN item_id % 5 = 0 THEN CAST(0 AS DECIMAL(18,4)) WHEN item_id % 5 = 1 THEN CAST(7 AS DECIMAL(18,4)) END AS given FROM ln WHERE status = 'pending') SELECT pr_id, line_no, CAST(CASE WHEN decision = 'approved' THEN coalesce(given, requested_qty) ELSE 0 END AS DOUBLE) AS new_qty, CASE WHEN decision = 'approved' AND coalesce(given, requested_qty) <= 0 THEN 'quantity must be over 0' END AS rejected_because, CASE WHEN decision = 'approved' AND coalesce(given, requested_qty) <= 0 THEN status ELSE decision END AS to_status FROM ln JOIN dc USING (pr_id, line_no)")
def m9(spark, d):
    lines = current_lines(spark, d)
    given = F.when(F.col("item_id") % 5 == 0, 0).when(F.col("item_id") % 5 == 1, 7).cast("decimal(18,4)")
    decisions = lines.where("status = 'pending'").select("pr_id", "line_no", F.when(F.col("item_id") % 3 == 0, "rejected").otherwise("approved").alias("decision"), given.alias("given_qty"))
    return _num(p.decide(lines, decisions).select("pr_id", "line_no", "new_qty", "rejected_because", "to_status"))


@query("m10_header_decision", f"{WITH} SELECT pr_id, 'pending' AS from_status, CASE WHEN pr_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS to_status FROM rq WHERE status = 'pending' AND is_deleted = 0")
def m10(spark, d):
    rows = t.requests(spark, d).where("status = 'pending' AND is_deleted = 0")
    return rows.select("pr_id", F.col("status").alias("from_status"), F.when(F.col("pr_id") % 2 == 0, "approved").otherwise("rejected").alias("to_status"))


MOVES = {"click": "approve", "view": "reject", "purchase": "resubmit"}


def order_commands(spark, d):
    action = F.when(F.col("action") == "click", "approve").when(F.col("action") == "view", "reject").when(F.col("action") == "purchase", "resubmit").otherwise("other")
    return t.commands(spark, d).select("document_id", "at", F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("event_id") % 3 != 0, "note").otherwise("").alias("note"))


ORDER_STATUS_SQL = f"""WITH RECURSIVE {t.SQL},
c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY "at", event_id) AS n, CASE action WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'resubmit' ELSE 'other' END AS action, event_id % 3 <> 0 AS noted FROM cm),
f AS (SELECT DISTINCT document_id, CAST(0 AS BIGINT) AS n, 'pending_approval' AS state, CAST(0 AS BIGINT) AS refused FROM c
      UNION ALL SELECT document_id, n, coalesce(then_, state), refused + CASE WHEN then_ IS NULL THEN 1 ELSE 0 END FROM (
          SELECT c.document_id, c.n, f.state, f.refused, CASE WHEN f.state = 'pending_approval' AND action = 'approve' THEN 'approved' WHEN f.state = 'pending_approval' AND action = 'reject' AND noted THEN 'rejected' WHEN f.state = 'rejected' AND action = 'resubmit' THEN 'pending_approval' END AS then_
          FROM f JOIN c ON c.document_id = f.document_id AND c.n = f.n + 1))
SELECT document_id, state, refused, n AS seen FROM f QUALIFY n = max(n) OVER (PARTITION BY document_id)"""


@query("m11_order_status", ORDER_STATUS_SQL)
def m11(spark, d):
    return p.fold_status(order_commands(spark, d))


@query("p1_renamed", f"{WITH} SELECT pr_id AS id, requester_id AS requested_by, strftime(pr_date, '%Y-%m-%d') AS requested_on FROM rq")
def p1(spark, d):
    return t.requests(spark, d).select(F.col("pr_id").alias("id"), F.col("requester_id").alias("requested_by"), F.date_format("pr_date", "yyyy-MM-dd").alias("requested_on"))


@query("p2_optional_filters", f"{WITH} SELECT pr_id, status FROM rq WHERE is_deleted = 0 AND status = 'approved'")
def p2(spark, d):
    out = t.requests(spark, d).where("is_deleted = 0")
    for column, wanted in (("status", "approved"), ("requester_id", None)):
        out = out if wanted is None else out.where(F.col(column) == wanted)
    return out.select("pr_id", "status")


@query("p3_substring_search", f"{WITH} SELECT item_id, name_en FROM it WHERE strpos(lower(name_en), 're') > 0 OR strpos(lower(brand), '#1') > 0")
def p3(spark, d):
    return t.items(spark, d).where(F.contains(F.lower("name_en"), F.lit("re")) | F.contains(F.lower("brand"), F.lit("#1"))).select("item_id", "name_en")


@query("p4_status_filter", f"{WITH} SELECT pr_id FROM rq WHERE status = 'approved'")
def p4(spark, d):
    return t.requests(spark, d).where("status = 'approved'").select("pr_id")


@query("p8_semi_filter", f"{WITH} SELECT pr_id, line_no FROM ln WHERE pr_id IN (SELECT pr_id FROM rq WHERE is_deleted = 1)")
def p8(spark, d):
    return current_lines(spark, d).join(t.requests(spark, d).where("is_deleted = 1").select("pr_id"), "pr_id", "left_semi").select("pr_id", "line_no")


@query("p10_mine", f"{WITH} SELECT requester_id, count(*) AS n FROM rq WHERE requester_id % 10 = 3 GROUP BY 1")
def p10(spark, d):
    return t.requests(spark, d).where("requester_id % 10 = 3").groupBy("requester_id").agg(F.count(F.lit(1)).alias("n"))


@query("o1_byte_order", f"{WITH} SELECT name_en, row_number() OVER (ORDER BY name_en) AS place FROM (SELECT DISTINCT name_en FROM it)")
def o1(spark, d):
    return numbering.dense_numbers(t.items(spark, d).select("name_en").distinct(), ["name_en"], 0, "place").select("name_en", "place")


@query("o4_top_k", f"{WITH} SELECT vendor_id, vendor_name FROM ve WHERE strpos(lower(vendor_name), '1') > 0 ORDER BY vendor_name, vendor_id LIMIT 10")
def o4(spark, d):
    return t.vendors(spark, d).where(F.contains(F.lower("vendor_name"), F.lit("1"))).orderBy("vendor_name", "vendor_id").limit(10).select("vendor_id", "vendor_name")


@query("o5_top_k_per_group", f"{WITH} SELECT requester_id, pr_id FROM (SELECT *, row_number() OVER (PARTITION BY requester_id ORDER BY total DESC, pr_id) AS rn FROM rq) WHERE rn <= 3")
def o5(spark, d):
    rank = F.row_number().over(Window.partitionBy("requester_id").orderBy(F.desc("total"), "pr_id"))
    return t.requests(spark, d).withColumn("rn", rank).where("rn <= 3").select("requester_id", "pr_id")


@query("o7_set_union", f"{WITH} SELECT vendor_id FROM lv UNION SELECT vendor_id FROM ol")
def o7(spark, d):
    return t.request_line_versions(spark, d).select("vendor_id").union(t.order_lines(spark, d).select("vendor_id")).distinct()


@query("o8_set_difference", f"{WITH} SELECT 'only_requests' AS side, count(*) AS n FROM (SELECT DISTINCT item_id FROM lv WHERE status = 'rejected' AND item_id NOT IN (SELECT item_id FROM ol)) UNION ALL SELECT 'only_orders', count(*) FROM (SELECT DISTINCT item_id FROM ol WHERE item_id NOT IN (SELECT item_id FROM lv WHERE status = 'rejected'))")
def o8(spark, d):
    a, b = t.request_line_versions(spark, d).where("status = 'rejected'").select("item_id").distinct(), t.order_lines(spark, d).select("item_id").distinct()
    count = lambda x, y, name: x.join(y, "item_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return count(a, b, "only_requests").union(count(b, a, "only_orders"))


@query("d1_spend_rollup", f"{WITH} SELECT category, vendor_id, CAST(sum(unit_price * ordered_qty) AS DOUBLE) AS spend FROM ol JOIN it USING (item_id) GROUP BY ROLLUP (category, vendor_id)")
def d1(spark, d):
    rows = t.order_lines(spark, d).join(t.items(spark, d).select("item_id", "category"), "item_id")
    return _num(rows.rollup("category", "vendor_id").agg(F.sum(F.col("unit_price") * F.col("ordered_qty")).alias("spend")))


@query("d2_request_aging", f"{WITH} SELECT CAST(least(floor(date_diff('day', pr_date, DATE '1998-12-31') / 365), 7) AS BIGINT) AS years, count(*) AS n FROM rq WHERE status = 'pending' GROUP BY 1")
def d2(spark, d):
    age = F.least(F.floor(F.datediff(F.lit("1998-12-31").cast("date"), "pr_date") / 365), F.lit(7)).cast("long")
    return t.requests(spark, d).where("status = 'pending'").groupBy(age.alias("years")).agg(F.count(F.lit(1)).alias("n"))


@query("d3_open_orders", f"{WITH} SELECT po_id, CAST(sum(ordered_qty) AS DOUBLE) AS open_qty FROM ol WHERE is_deleted = 0 AND line_no % 2 = 0 GROUP BY po_id")
def d3(spark, d):
    rows = t.order_lines(spark, d).where("is_deleted = 0").withColumn("received_qty", F.when(F.col("line_no") % 2 == 0, 0).otherwise(F.col("ordered_qty")))
    return _num(rows.where("received_qty < ordered_qty").groupBy("po_id").agg(F.sum("ordered_qty").alias("open_qty")))


@query("d6_gl_journal", f"SELECT po_id, account, debit, credit FROM (SELECT po_id, '5000' AS account, total AS debit, 0.0::DOUBLE AS credit FROM ({TOTALS_SQL}) UNION ALL SELECT po_id, '2100', 0.0::DOUBLE, total FROM ({TOTALS_SQL}))")
def d6(spark, d):
    zero = F.lit(0.0)
    total = F.col("total").cast("double")
    pair = F.array(F.struct(F.lit("5000").alias("account"), total.alias("debit"), zero.alias("credit")), F.struct(F.lit("2100").alias("account"), zero.alias("debit"), total.alias("credit")))
    return p.order_totals(t.order_lines(spark, d), terms(spark, d)).select("po_id", F.explode(pair).alias("e")).select("po_id", "e.account", "e.debit", "e.credit")


@query("d7_pipeline_stage", f"{WITH} SELECT stage, count(*) AS n FROM (SELECT CASE WHEN status = 'pending' THEN 'submitted' WHEN status = 'rejected' THEN 'closed' WHEN pr_id IN (SELECT pr_id FROM ol) THEN 'ordered' ELSE 'approved' END AS stage FROM rq) GROUP BY stage")
def d7(spark, d):
    has = t.order_lines(spark, d).select("pr_id").distinct().withColumn("ordered", F.lit(True))
    stage = F.when(F.col("status") == "pending", "submitted").when(F.col("status") == "rejected", "closed").when(F.col("ordered"), "ordered").otherwise("approved")
    return t.requests(spark, d).join(has, "pr_id", "left").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("d8_price_on_date", f"{WITH}, pr AS (SELECT item_id, vendor_id, CAST(version AS DATE) AS valid_from, max(price) AS price FROM lv GROUP BY ALL), a AS (SELECT ln.pr_id, line_no, item_id, vendor_id, CAST(pr_date + 90 AS DATE) AS day FROM ln JOIN rq USING (pr_id)) SELECT a.pr_id, a.line_no, CAST(pr.price AS DOUBLE) AS price FROM a ASOF LEFT JOIN pr ON a.item_id = pr.item_id AND a.vendor_id = pr.vendor_id AND a.day >= pr.valid_from")
def d8(spark, d):
    """The price of each line's item and vendor ninety days after its request."""
    prices = t.request_line_versions(spark, d).groupBy("item_id", "vendor_id", F.to_date("version").alias("valid_from")).agg(F.max("price").alias("price"))
    asked = current_lines(spark, d).select("pr_id", "line_no", "item_id", "vendor_id").join(t.requests(spark, d).select("pr_id", F.date_add("pr_date", 90).alias("day")), "pr_id")
    return _num(p.price_on(asked, prices).select("pr_id", "line_no", "price"))
