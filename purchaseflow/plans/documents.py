"""Registered queries: orders made in full, decisions with action rows, item requests, new items, the older system's snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from purchaseflow.operators import documents, snapshot
from purchaseflow.sources import files
from purchaseflow.sources import tables as t

from .registry import query
from .reports import WITH, _num, current_lines

# --- decisions -----------------------------------------------------------------------------------------------------

LINE_DECISIONS_SQL = f"""{WITH}, dc AS (
    SELECT pr_id * 100 + line_no * 10 + k AS seq, pr_id, line_no, CASE (item_id + k) % 5 WHEN 0 THEN 'rejected' WHEN 4 THEN 'maybe' ELSE 'approved' END AS decision,
           CASE item_id % 6 WHEN 0 THEN CAST(0 AS DECIMAL(18,4)) WHEN 1 THEN CAST(7 AS DECIMAL(18,4)) END AS given_qty, 'chief ' || k AS actor, CASE WHEN k = 1 THEN 'again' ELSE '' END AS notes
    FROM ln, (VALUES (0), (1)) AS x(k) WHERE CASE WHEN k = 0 THEN item_id % 4 <> 0 ELSE item_id % 7 = 0 END),
q AS (SELECT dc.*, ln.item_id, ln.status, CASE WHEN decision = 'approved' THEN coalesce(given_qty, requested_qty) ELSE 0 END AS approved_qty, ln.is_deleted AS no_line, rq.is_deleted AS no_request
      FROM dc JOIN ln USING (pr_id, line_no) LEFT JOIN rq USING (pr_id)),
w AS (SELECT *, CASE WHEN decision = 'maybe' THEN 'unknown decision' WHEN no_request = 1 OR no_request IS NULL THEN 'request not found' WHEN no_line = 1 THEN 'line not found' WHEN decision = 'approved' AND approved_qty <= 0 THEN 'quantity must be over 0' END AS reason FROM q),
ok AS (SELECT * FROM w WHERE reason IS NULL),
la AS (SELECT pr_id, line_no, arg_max(decision, seq) AS status, arg_max(approved_qty, seq) AS approved_qty FROM ok GROUP BY ALL)"""


def line_decisions(spark, d) -> documents.LineDecisions:
    """Most lines are decided once, some twice, some wrongly."""
    lines = files.stored(current_lines(spark, d).select("pr_id", "line_no", "item_id", "requested_qty", "status", "is_deleted"))
    k = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    rows = lines.select("pr_id", "line_no", "item_id", k).where("CASE WHEN k = 0 THEN item_id % 4 <> 0 ELSE item_id % 7 = 0 END")
    rest = (F.col("item_id") + F.col("k")) % 5
    decisions = rows.select(
        (F.col("pr_id") * 100 + F.col("line_no") * 10 + F.col("k")).alias("seq"), "pr_id", "line_no", F.when(rest == 0, "rejected").when(rest == 4, "maybe").otherwise("approved").alias("decision"),
        F.when(F.col("item_id") % 6 == 0, 0).when(F.col("item_id") % 6 == 1, 7).cast("decimal(18,4)").alias("given_qty"), F.concat(F.lit("chief "), F.col("k").cast("string")).alias("actor"), F.when(F.col("k") == 1, "again").otherwise("").alias("notes"),
    )
    return documents.LineDecisions(t.requests(spark, d), lines, t.items(spark, d), decisions)


@query("m9_decided_lines", f"{LINE_DECISIONS_SQL} SELECT pr_id, line_no, status, CAST(approved_qty AS DOUBLE) AS approved_qty FROM la")
def m9_lines(spark, d):
    return _num(line_decisions(spark, d).changed)


@query("m9_decision_actions", f"{LINE_DECISIONS_SQL} SELECT seq, 'PR' AS document_type, pr_id, line_no, actor, decision AS action, coalesce(lag(decision) OVER (PARTITION BY pr_id, line_no ORDER BY seq), ok.status) AS from_status, decision AS to_status, CAST(approved_qty AS DOUBLE) AS approved_qty, 'Item: ' || coalesce(nullif(name_en, ''), CAST(item_id AS VARCHAR)) || CASE WHEN notes = '' THEN '' ELSE ' — ' || notes END AS notes FROM ok LEFT JOIN it USING (item_id)")
def m9_actions(spark, d):
    return _num(line_decisions(spark, d).actions)


@query("m9_request_status", f"{LINE_DECISIONS_SQL}, n AS (SELECT ln.pr_id, coalesce(la.status, ln.status) AS status FROM ln LEFT JOIN la USING (pr_id, line_no) WHERE is_deleted = 0 AND ln.pr_id IN (SELECT pr_id FROM la)) SELECT pr_id, CASE WHEN bool_and(status = 'rejected') THEN 'rejected' ELSE 'approved' END AS status FROM n GROUP BY pr_id HAVING NOT bool_or(status IN ('', 'pending'))")
def m9_requests(spark, d):
    return line_decisions(spark, d).requests


@query("m9_refused_decisions", f"{LINE_DECISIONS_SQL} SELECT seq, pr_id, line_no, reason FROM w WHERE reason IS NOT NULL")
def m9_refused(spark, d):
    return line_decisions(spark, d).refused


REQUEST_DECISIONS_SQL = f"""{WITH}, dc AS (
    SELECT pr_id * 10 + k AS seq, pr_id, CASE (pr_id + k) % 5 WHEN 0 THEN 'rejected' WHEN 4 THEN 'maybe' ELSE 'approved' END AS decision, CASE WHEN pr_id % 29 = 0 THEN '' ELSE 'chief' END AS actor, CASE WHEN k = 1 THEN 'again' END AS notes
    FROM rq, (VALUES (0), (1)) AS x(k) WHERE k = 0 OR pr_id % 3 = 0),
w AS (SELECT dc.*, status, CASE WHEN actor = '' THEN 'actor and decision are required' WHEN decision = 'maybe' THEN 'unknown decision' WHEN is_deleted = 1 THEN 'request not found' END AS reason FROM dc JOIN rq USING (pr_id))"""


def request_decisions(spark, d):
    rows = t.requests(spark, d)
    rest = (F.col("pr_id") + F.col("k")) % 5
    decisions = rows.select("pr_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where("k = 0 OR pr_id % 3 = 0").select(
        (F.col("pr_id") * 10 + F.col("k")).alias("seq"), "pr_id", F.when(rest == 0, "rejected").when(rest == 4, "maybe").otherwise("approved").alias("decision"),
        F.when(F.col("pr_id") % 29 == 0, "").otherwise("chief").alias("actor"), F.when(F.col("k") == 1, "again").alias("notes"),
    )
    return documents.decide_requests(rows, decisions)


@query("m10_request_actions", f"{REQUEST_DECISIONS_SQL} SELECT seq, 'PR' AS document_type, pr_id, actor, decision AS action, coalesce(lag(decision) OVER (PARTITION BY pr_id ORDER BY seq), status) AS from_status, decision AS to_status, coalesce(notes, '') AS notes FROM w WHERE reason IS NULL")
def m10_actions(spark, d):
    return request_decisions(spark, d)[1]


@query("m10_decided_requests", f"{REQUEST_DECISIONS_SQL} SELECT pr_id, arg_max(decision, seq) AS status FROM w WHERE reason IS NULL GROUP BY pr_id")
def m10_requests(spark, d):
    return request_decisions(spark, d)[0]


@query("m10_refused_decisions", f"{REQUEST_DECISIONS_SQL} SELECT seq, pr_id, reason FROM w WHERE reason IS NOT NULL")
def m10_refused(spark, d):
    return request_decisions(spark, d)[2]


# --- orders from request lines ----------------------------------------------------------------------------------------

ORDERS_SQL = f"""{WITH}, sl AS (
    SELECT pr_id * 10 + line_no % 3 AS submission_id, line_no AS position, pr_id, CASE WHEN item_id % 37 = 0 THEN line_no + 20 ELSE line_no END AS request_line, requested_qty AS qty, CASE WHEN item_id % 50 <> 0 THEN price END AS unit_price,
           CASE WHEN item_id % 2 = 0 THEN 'stock' ELSE '' END AS purpose FROM ln),
sb AS (SELECT DISTINCT submission_id, 2020 + pr_id % 3 AS year, CASE WHEN submission_id % 19 = 0 THEN '' ELSE 'Vendor ' || submission_id % 100 END AS vendor_name, submission_id % 130 - 10 AS discount_pct,
              CASE submission_id % 6 WHEN 0 THEN 'pph23' WHEN 1 THEN '' WHEN 3 THEN 'pph15' WHEN 4 THEN CASE WHEN submission_id % 8 = 0 THEN 'pph99' ELSE 'pph22_impor' END END AS withholding, submission_id % 3 = 1 AS include_vat FROM sl),
cr AS (SELECT submission_id, k AS position, CASE WHEN submission_id % 43 = 0 THEN 'tip' ELSE CASE (submission_id + k) % 5 WHEN 0 THEN 'freight' WHEN 1 THEN 'packing' WHEN 2 THEN 'insurance' WHEN 3 THEN 'handling' ELSE 'other' END END AS kind,
              CAST(CASE WHEN submission_id % 47 = 0 THEN 0 - k ELSE submission_id % 500 + k END AS DECIMAL(18,2)) AS amount, CASE WHEN k = 2 THEN repeat('x', submission_id % 3 * 300) END AS description FROM sb, (VALUES (1), (2)) AS x(k) WHERE submission_id % 4 <> 0),
jl AS (SELECT sl.*, k.item_id, CASE WHEN k.item_id % 3 = 0 THEN 'box' ELSE 'pcs' END AS uom, CASE WHEN unit_price IS NULL THEN 'a line needs request line, price and quantity' WHEN k.item_id IS NULL THEN 'not found: ' || sl.pr_id || '/' || request_line WHEN k.status <> 'approved' THEN 'not approved: ' || sl.pr_id || '/' || request_line END AS error
       FROM sl LEFT JOIN (SELECT * FROM ln WHERE is_deleted = 0) k ON sl.pr_id = k.pr_id AND sl.request_line = k.line_no),
e AS (SELECT submission_id, arg_min(pr_id, position) AS primary_pr, count(*) AS n_lines, arg_min(error, position) FILTER (error IS NOT NULL) AS le FROM jl GROUP BY submission_id),
h AS (SELECT sb.*, primary_pr, n_lines, coalesce(charges, 0) AS charges, CASE WHEN vendor_name = '' THEN 'vendor and lines are required' WHEN withholding = 'pph99' THEN 'unknown withholding: pph99' WHEN charges IS NOT NULL AND submission_id % 43 = 0 THEN 'unknown charge: tip' WHEN charges IS NOT NULL AND submission_id % 47 = 0 THEN 'a charge needs an amount of 0 or more' ELSE le END AS reason
      FROM sb JOIN e USING (submission_id) LEFT JOIN (SELECT submission_id, sum(amount) AS charges FROM cr GROUP BY 1) USING (submission_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY submission_id) + 5 AS no FROM h WHERE reason IS NULL),
od AS (SELECT * EXCLUDE (no), 'PO-' || year || '-' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS doc_no FROM o)"""


def new_orders(spark, d) -> documents.NewOrders:
    """A third of each request's lines in an order, with charges and every kind of fault."""
    stored = files.stored(current_lines(spark, d).select("pr_id", "line_no", "item_id", "requested_qty", "price", "status", "is_deleted"))
    of = (F.col("pr_id") * 10 + F.col("line_no") % 3).alias("submission_id")
    lines = stored.select(
        of, F.col("line_no").alias("position"), "pr_id", F.when(F.col("item_id") % 37 == 0, F.col("line_no") + 20).otherwise(F.col("line_no")).alias("line_no"), F.col("requested_qty").alias("qty"),
        F.when(F.col("item_id") % 50 != 0, F.col("price")).alias("unit_price"), F.when(F.col("item_id") % 2 == 0, "stock").alias("purpose"),
    )
    s = F.col("submission_id")
    kind = F.when(s % 6 == 0, "pph23").when(s % 6 == 1, "").when(s % 6 == 3, "pph15").when(s % 6 == 4, F.when(s % 8 == 0, "pph99").otherwise("pph22_impor"))
    year = (2020 + F.col("pr_id") % 3).alias("year")
    # by the submission alone, as it is joined by that
    asked = stored.select(of).distinct().withColumn("pr_id", F.expr("(submission_id - pmod(submission_id, 10)) div 10")).select(
        s, year, F.when(s % 19 == 0, "").otherwise(F.concat(F.lit("Vendor "), (s % 100).cast("string"))).alias("vendor_name"), (s % 130 - 10).alias("discount_pct"), kind.alias("withholding"), F.when(s % 3 != 2, s % 3 == 1).alias("include_vat"),
    )
    k = F.col("position")
    names = F.when((s + k) % 5 == 0, "freight").when((s + k) % 5 == 1, "packing").when((s + k) % 5 == 2, "insurance").when((s + k) % 5 == 3, "handling").otherwise("other")
    charges = asked.where(s % 4 != 0).select(s, F.explode(F.array(F.lit(1), F.lit(2))).alias("position")).select(
        s, k, F.when(s % 43 == 0, "tip").otherwise(names).alias("kind"), F.when(s % 47 == 0, -k).otherwise(s % 500 + k).cast("decimal(18,2)").alias("amount"), F.when(k == 2, F.repeat(F.lit("x"), (s % 3 * 300).cast("int"))).alias("description"),
    )
    known = stored.select("pr_id", "line_no", "item_id", F.when(F.col("item_id") % 3 == 0, "box").otherwise("pcs").alias("uom"), "status", "is_deleted")
    return documents.NewOrders(asked, lines, charges, known, stored.select(year).distinct().withColumn("last_no", F.lit(5)))


@query("m13_order_headers", f"""{ORDERS_SQL},
s AS (SELECT submission_id, round(CAST(sum(unit_price * qty) AS DECIMAL(28,6)), 2) AS subtotal FROM jl WHERE submission_id IN (SELECT submission_id FROM od) GROUP BY 1),
a AS (SELECT od.*, subtotal, round(subtotal * CAST(least(greatest(discount_pct, 0), 100) AS DECIMAL(5,2)) * CAST(0.01 AS DECIMAL(4,2)), 2) AS discount FROM od JOIN s USING (submission_id)),
b AS (SELECT *, CAST(subtotal - discount AS DECIMAL(18,2)) AS net FROM a),
c AS (SELECT *, CASE WHEN include_vat THEN round((net + charges) * CAST(0.11 AS DECIMAL(5,4)), 2) ELSE 0 END AS vat, round(net * CASE withholding WHEN 'pph23' THEN CAST(0.02 AS DECIMAL(5,4)) WHEN 'pph15' THEN CAST(0.012 AS DECIMAL(5,4)) WHEN 'pph22_impor' THEN CAST(0.025 AS DECIMAL(5,4)) ELSE CAST(0 AS DECIMAL(5,4)) END, 2) AS withheld FROM b)
SELECT submission_id, doc_no, vendor_name, primary_pr, n_lines, CAST(charges AS DOUBLE) AS charges, CAST(subtotal AS DOUBLE) AS subtotal, CAST(discount AS DOUBLE) AS discount, CAST(vat AS DOUBLE) AS vat, CAST(withheld AS DOUBLE) AS withheld,
       CAST(net + charges + vat - withheld AS DOUBLE) AS total, 'pending_approval' AS status, 'IDR' AS currency, lower(doc_no || ' ' || vendor_name) AS search_text FROM c""")
def m13_headers(spark, d):
    made = new_orders(spark, d).headers
    return _num(made.select("submission_id", "doc_no", "vendor_name", "primary_pr", "n_lines", "charges", "subtotal", "discount", "vat", "withheld", "total", "status", "currency", "search_text"))


@query("m13_order_lines", f"{ORDERS_SQL} SELECT doc_no, row_number() OVER (PARTITION BY doc_no ORDER BY position) AS po_line, jl.pr_id, request_line, item_id, uom, CAST(qty AS DOUBLE) AS qty, CAST(unit_price AS DOUBLE) AS unit_price, CAST(qty * unit_price AS DOUBLE) AS total_price, purpose, 'open' AS status FROM jl JOIN od USING (submission_id)")
def m13_lines(spark, d):
    return _num(new_orders(spark, d).lines.select("doc_no", F.col("po_line").cast("long"), "pr_id", "request_line", "item_id", "uom", "qty", "unit_price", "total_price", "purpose", "status"))


@query("m13_order_charges", f"{ORDERS_SQL} SELECT doc_no, position AS line_no, kind, CASE kind WHEN 'freight' THEN '5100' WHEN 'packing' THEN '5110' WHEN 'insurance' THEN '5120' WHEN 'handling' THEN '5130' ELSE '5190' END AS account, CAST(amount AS DOUBLE) AS amount, substr(coalesce(description, ''), 1, 500) AS description FROM cr JOIN od USING (submission_id)")
def m13_charges(spark, d):
    return _num(new_orders(spark, d).charges.select("doc_no", F.col("line_no").cast("int"), "kind", "account", "amount", "description"))


@query("m13_refused_orders", f"{ORDERS_SQL} SELECT submission_id, reason FROM h WHERE reason IS NOT NULL")
def m13_refused(spark, d):
    return new_orders(spark, d).refused


# --- items ------------------------------------------------------------------------------------------------------------

FIELDS_SQL = "CASE WHEN item_id % 31 <> 0 THEN name_en END AS name_en, CASE WHEN item_id % 2 = 0 THEN '轴承 ' || item_id ELSE '' END AS name_cn, CASE WHEN item_id % 5 <> 0 THEN category END AS category, size || 'mm' AS spec, CASE item_id % 3 WHEN 0 THEN 'box' WHEN 1 THEN '' END AS uom"
CODE_SQL = "'ITEM-' || CASE WHEN item_no < 10000 THEN lpad(CAST(item_no AS VARCHAR), 4, '0') ELSE CAST(item_no AS VARCHAR) END"
NEW_ITEM_SQL = f"{CODE_SQL} AS item_code, name_en, name_cn, coalesce(category, '') AS category, spec, coalesce(nullif(uom, ''), 'pcs') AS uom, lower(name_en || ' ' || name_cn || ' ' || coalesce(category, '')) AS search_text"
NEW_ITEM = ("item_code", "name_en", "name_cn", "category", "spec", "uom", "search_text")


def item_fields(spark, d):
    i = F.col("item_id")
    return t.items(spark, d).select(
        i, F.when(i % 31 != 0, F.col("name_en")).alias("name_en"), F.when(i % 2 == 0, F.concat(F.lit("轴承 "), i.cast("string"))).otherwise("").alias("name_cn"), F.when(i % 5 != 0, F.col("category")).alias("category"),
        F.concat(F.col("size").cast("string"), F.lit("mm")).alias("spec"), F.when(i % 3 == 0, "box").when(i % 3 == 1, "").alias("uom"), "is_deleted",
    )


@query("m15_create_items", f"{WITH}, f AS (SELECT item_id, {FIELDS_SQL}, CASE WHEN item_id % 4 = 0 THEN 'stock' ELSE 'expense' END AS item_type FROM it), n AS (SELECT *, 100 + row_number() OVER (ORDER BY item_id) AS item_no FROM f WHERE name_en <> '') SELECT item_id, {NEW_ITEM_SQL}, item_type, 'active' AS status FROM n")
def m15_items(spark, d):
    asked = item_fields(spark, d).withColumns({"department": F.lit(None).cast("string"), "item_type": F.when(F.col("item_id") % 4 == 0, "stock")})
    return documents.create_items(asked, ["item_id"], 100)[0].select("item_id", *NEW_ITEM, "item_type", "status")


ITEM_REQUESTS_SQL = f"""{WITH}, f AS (SELECT item_id AS request_id, {FIELDS_SQL}, is_deleted FROM it),
dc AS (SELECT item_id * 10 + k AS seq, item_id AS request_id, CASE (item_id + k) % 4 WHEN 0 THEN 'rejected' WHEN 3 THEN 'later' ELSE 'approved' END AS decision, CASE WHEN k = 1 THEN 'second thought' END AS notes FROM it, (VALUES (0), (1)) AS x(k) WHERE k = 0 OR item_id % 3 = 0),
la AS (SELECT request_id, arg_max(decision, seq) AS decision, arg_max(coalesce(notes, ''), seq) AS admin_notes FROM dc GROUP BY 1),
w AS (SELECT *, CASE WHEN is_deleted = 1 THEN 'item request not found' WHEN decision = 'later' THEN 'unknown decision' WHEN decision = 'approved' AND name_en IS NULL THEN 'name_en required' END AS reason FROM la JOIN f USING (request_id)),
n AS (SELECT *, 100 + row_number() OVER (ORDER BY request_id) AS item_no FROM w WHERE reason IS NULL AND decision = 'approved')"""


def item_requests(spark, d):
    asked = item_fields(spark, d).withColumnRenamed("item_id", "request_id")
    i, k = F.col("request_id"), F.col("k")
    rest = (i + k) % 4
    decisions = asked.select(i, F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where("k = 0 OR request_id % 3 = 0").select(
        (i * 10 + k).alias("seq"), i, F.when(rest == 0, "rejected").when(rest == 3, "later").otherwise("approved").alias("decision"), F.when(k == 1, "second thought").alias("notes"),
    )
    return documents.decide_item_requests(asked, decisions, 100)


@query("m14_new_items", f"{ITEM_REQUESTS_SQL} SELECT request_id, {NEW_ITEM_SQL} FROM n")
def m14_items(spark, d):
    return item_requests(spark, d)[0].select("request_id", *NEW_ITEM)


@query("m14_decided_requests", f"{ITEM_REQUESTS_SQL} SELECT request_id, decision AS status, admin_notes, {CODE_SQL} AS approved_item FROM w LEFT JOIN (SELECT request_id, item_no FROM n) USING (request_id) WHERE reason IS NULL")
def m14_requests(spark, d):
    return item_requests(spark, d)[1]


@query("m14_refused_requests", f"{ITEM_REQUESTS_SQL} SELECT request_id, reason FROM w WHERE reason IS NOT NULL")
def m14_refused(spark, d):
    return item_requests(spark, d)[2]


# --- snapshot of the older system ---------------------------------------------------------------------------------------

TODAY, NOW = "2000-01-01", "2000-01-01 00:00:00"
OLD_SQL = f"""{WITH},
xr AS (SELECT pr_id, CASE WHEN pr_id % 5 <> 0 THEN 'PR/' || pr_id END AS pr_number, CASE WHEN pr_id % 7 <> 0 THEN 'user ' || requester_id END AS requested_by, CASE pr_id % 3 WHEN 0 THEN 'mine' WHEN 1 THEN '' END AS department, CASE WHEN pr_id % 11 <> 0 THEN pr_date END AS requested_on, CASE WHEN pr_id % 4 <> 0 THEN status ELSE '' END AS status, CAST(NULL AS VARCHAR) AS notes FROM rq WHERE is_deleted = 0),
xl AS (SELECT pr_id, line_no, CASE WHEN item_id % 13 <> 0 THEN item_id END AS item_id, CASE line_no % 3 WHEN 0 THEN 0 WHEN 1 THEN requested_qty END AS qty_requested, CASE WHEN item_id % 6 <> 0 THEN requested_qty ELSE 0 END AS qty, CASE WHEN approved_qty <> 0 THEN approved_qty END AS qty_approved,
              CASE WHEN item_id % 3 = 0 THEN 0 ELSE price END AS est_unit_price, CASE WHEN item_id % 2 = 0 THEN price + 1 END AS estimated_unit_price, CASE WHEN item_id % 3 = 1 THEN 'box' WHEN item_id % 3 = 0 THEN '' END AS uom, CASE WHEN line_no = 1 THEN 'mine' END AS department, status FROM ln),
xa AS (SELECT event_id AS approval_id, document_id AS pr_id, CASE WHEN event_id % 9 <> 0 THEN 'chief' END AS approved_by, CASE WHEN event_id % 5 <> 0 THEN action ELSE '' END AS action, CASE event_id % 3 WHEN 0 THEN strftime("at", '%Y-%m-%d %H:%M:%S') WHEN 1 THEN 'yesterday' END AS "at", '' AS notes FROM cm),
xo AS (SELECT po_id, CASE WHEN po_id % 5 <> 0 THEN 'PO/' || po_id END AS po_number, min(pr_id) AS pr_id, CASE WHEN po_id % 3 <> 0 THEN min(vendor_id) END AS vendor_id, CASE WHEN po_id % 4 <> 0 THEN 'Vendor ' || min(vendor_id) ELSE '' END AS vendor_name, CAST(CASE WHEN po_id % 2 = 0 THEN sum(unit_price) END AS DECIMAL(18,2)) AS total_amount, CASE po_id % 3 WHEN 0 THEN 'sent' WHEN 1 THEN '' END AS status FROM ol WHERE po_id % 13 <> 5 GROUP BY po_id),
rk AS (SELECT pr_id, sha1('pr_id:' || pr_id) AS request_key FROM xr), ok AS (SELECT po_id, sha1('po_id:' || po_id) AS order_key FROM xo)"""
QTY_SQL = "coalesce(nullif(qty_requested, 0), nullif(qty, 0), 0)"
PRICE_SQL = "coalesce(nullif(est_unit_price, 0), nullif(estimated_unit_price, 0), 0)"


def old_requests(spark, d):
    P = F.col("pr_id")
    text = lambda c: c.cast("string")
    return t.requests(spark, d).where("is_deleted = 0").select(
        P, F.when(P % 5 != 0, F.concat(F.lit("PR/"), text(P))).alias("pr_number"), F.when(P % 7 != 0, F.concat(F.lit("user "), text(F.col("requester_id")))).alias("requested_by"), F.when(P % 3 == 0, "mine").when(P % 3 == 1, "").alias("department"),
        F.when(P % 11 != 0, F.col("pr_date")).alias("requested_on"), F.when(P % 4 != 0, F.col("status")).otherwise("").alias("status"), F.lit(None).cast("string").alias("notes"),
    )


def old_lines(spark, d):
    I, P, L = (F.col(c) for c in ("item_id", "pr_id", "line_no"))
    qty, price = F.col("requested_qty"), F.col("price")
    return current_lines(spark, d).select(
        P, L, F.when(I % 13 != 0, I).alias("item_id"), F.when(L % 3 == 0, 0).when(L % 3 == 1, qty).alias("qty_requested"), F.when(I % 6 != 0, qty).otherwise(0).alias("qty"), F.nullif("approved_qty", F.lit(0).cast("decimal(18,4)")).alias("qty_approved"),
        F.when(I % 3 == 0, 0).otherwise(price).alias("est_unit_price"), F.when(I % 2 == 0, price + 1).alias("estimated_unit_price"), F.when(I % 3 == 1, "box").when(I % 3 == 0, "").alias("uom"), F.when(L == 1, "mine").alias("department"), "status",
    )


def old_orders(spark, d):
    O = F.col("po_id")
    rows = t.order_lines(spark, d).where("po_id % 13 != 5").groupBy("po_id").agg(F.min("pr_id").alias("pr_id"), F.min("vendor_id").alias("_v"), F.sum("unit_price").cast("decimal(18,2)").alias("_sum"))
    return rows.select(
        O, F.when(O % 5 != 0, F.concat(F.lit("PO/"), O.cast("string"))).alias("po_number"), "pr_id", F.when(O % 3 != 0, F.col("_v")).alias("vendor_id"), F.when(O % 4 != 0, F.concat(F.lit("Vendor "), F.col("_v").cast("string"))).otherwise("").alias("vendor_name"),
        F.when(O % 2 == 0, F.col("_sum")).alias("total_amount"), F.when(O % 3 == 0, "sent").when(O % 3 == 1, "").alias("status"), F.lit(None).cast("date").alias("created_on"),
    )


@query("m16_vendors", f"{WITH} SELECT vendor_id, vendor_id AS vendor_code, vendor_name, '' AS category, CASE WHEN vendor_id % 2 = 0 THEN 'City ' || nation_id ELSE '' END AS city, '' AS tax_no, 'active' AS status, 'ID' AS country, 'IDR' AS currency, lower(vendor_name || ' ' || vendor_id || CASE WHEN vendor_id % 2 = 0 THEN ' City ' || nation_id ELSE '' END) AS search_text FROM ve")
def m16_vendors(spark, d):
    none = F.lit(None).cast("string")
    city = F.when(F.col("vendor_id") % 2 == 0, F.concat(F.lit("City "), F.col("nation_id").cast("string")))
    return snapshot.vendors(t.vendors(spark, d).select("vendor_id", F.col("vendor_name").alias("name"), none.alias("category"), city.alias("city"), none.alias("tax_no")))


@query("m16_items", f"{WITH}, f AS (SELECT item_id, {FIELDS_SQL} FROM it) SELECT item_id, CASE WHEN item_id % 4 = 0 THEN CAST(item_id // 4 AS VARCHAR) ELSE '' END AS base_item_id, coalesce(name_en, '') AS name_en, name_cn, coalesce(category, '') AS category, spec, coalesce(nullif(uom, ''), 'pcs') AS uom, 'expense' AS item_type, 'active' AS status, lower(concat_ws(' ', name_en, nullif(name_cn, ''), spec, CAST(item_id AS VARCHAR))) AS search_text FROM f")
def m16_items(spark, d):
    I = F.col("item_id")
    return snapshot.items(item_fields(spark, d).withColumn("base_item_id", F.when(I % 4 == 0, F.floor(I / 4).cast("long"))))


@query("m16_requests", f"{OLD_SQL} SELECT request_key, pr_id, coalesce(pr_number, '') AS doc_no, coalesce(requested_by, '') AS requested_by, strftime(coalesce(requested_on, DATE '{TODAY}'), '%Y-%m-%d') AS pr_date, 'normal' AS priority, coalesce(nullif(status, ''), 'pending') AS status, 0.0::DOUBLE AS total_estimate, '' AS notes, lower(concat_ws(' ', pr_number, requested_by, nullif(department, ''))) AS search_text FROM xr JOIN rk USING (pr_id)")
def m16_requests(spark, d):
    return _num(snapshot.requests(old_requests(spark, d), TODAY).withColumn("pr_date", F.date_format("pr_date", "yyyy-MM-dd")))


@query("m16_request_lines", f"{OLD_SQL} SELECT coalesce(request_key, '') AS request_key, pr_id, line_no, coalesce(CAST(item_id AS VARCHAR), '') AS item_id, CAST({QTY_SQL} AS DOUBLE) AS requested_qty, CAST(coalesce(qty_approved, 0) AS DOUBLE) AS approved_qty, coalesce(nullif(uom, ''), 'pcs') AS uom, CAST({PRICE_SQL} AS DOUBLE) AS estimated_unit_price, CAST({QTY_SQL} * {PRICE_SQL} AS DOUBLE) AS estimated_total, coalesce(department, '') AS department, status FROM xl LEFT JOIN rk USING (pr_id)")
def m16_lines(spark, d):
    return _num(snapshot.request_lines(old_lines(spark, d), old_requests(spark, d)))


@query("m16_actions", f"{OLD_SQL} SELECT approval_id, 'purchase_request' AS document_type, coalesce(request_key, '') AS request_key, 1 AS step_no, coalesce(approved_by, '') AS actor, coalesce(nullif(action, ''), 'approve') AS action, coalesce(CASE WHEN approval_id % 3 = 0 THEN \"at\" END, '{NOW}') AS action_at, action AS to_status, notes FROM xa LEFT JOIN rk USING (pr_id)")
def m16_actions(spark, d):
    E = F.col("event_id")
    rows = t.commands(spark, d).select(
        E.alias("approval_id"), F.col("document_id").alias("pr_id"), F.when(E % 9 != 0, "chief").alias("approved_by"), F.when(E % 5 != 0, F.col("action")).otherwise("").alias("action"),
        F.when(E % 3 == 0, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).when(E % 3 == 1, "yesterday").alias("at"), F.lit("").alias("notes"),
    )
    return snapshot.actions(rows, old_requests(spark, d), NOW).withColumn("action_at", F.date_format("action_at", "yyyy-MM-dd HH:mm:ss"))


@query("m16_orders", f"{OLD_SQL} SELECT order_key, po_id, coalesce(po_number, '') AS doc_no, coalesce(request_key, '') AS primary_request, coalesce(CAST(vendor_id AS VARCHAR), '') AS vendor_id, vendor_name, '{TODAY}' AS po_date, coalesce(nullif(status, ''), 'draft') AS status, CAST(coalesce(total_amount, 0) AS DOUBLE) AS subtotal, CAST(coalesce(total_amount, 0) AS DOUBLE) AS total, lower(concat_ws(' ', po_number, nullif(vendor_name, ''))) AS search_text FROM xo JOIN ok USING (po_id) LEFT JOIN rk USING (pr_id)")
def m16_orders(spark, d):
    return _num(snapshot.orders(old_orders(spark, d), old_requests(spark, d), TODAY).withColumn("po_date", F.date_format("po_date", "yyyy-MM-dd")))


@query("m16_order_lines", f"{OLD_SQL} SELECT coalesce(order_key, '') AS order_key, po_id, CASE WHEN ln.pr_id IS NULL THEN '' ELSE sha1('line_no:' || ln.pr_id || ':' || ln.line_no) END AS request_line_key, CAST(ol.item_id AS VARCHAR) AS item_id, CAST(ordered_qty AS DOUBLE) AS ordered_qty, CASE WHEN ol.item_id % 3 = 1 THEN 'box' ELSE 'pcs' END AS uom, CAST(unit_price AS DOUBLE) AS unit_price, CAST(CASE WHEN ol.item_id % 2 = 0 THEN unit_price ELSE unit_price * ordered_qty END AS DOUBLE) AS total_price, '' AS vendor_name, 'open' AS status FROM ol LEFT JOIN ok USING (po_id) LEFT JOIN ln ON ln.pr_id = ol.pr_id AND ln.line_no = ol.line_no AND ol.item_id % 10 <> 7")
def m16_order_lines(spark, d):
    I, P, L, O = (F.col(c) for c in ("item_id", "pr_id", "line_no", "po_id"))
    old = t.order_lines(spark, d).select(
        O, F.when(I % 10 != 7, P).alias("pr_id"), L, I, F.col("ordered_qty").alias("qty"), "unit_price", F.when(I % 2 == 0, F.col("unit_price")).when(I % 3 == 0, 0).alias("total_price"), F.when(I % 3 == 1, "box").alias("uom"), F.lit(None).cast("string").alias("vendor_name"),
    )
    return _num(snapshot.order_lines(old, old_orders(spark, d), old_lines(spark, d)))


@query("m16_exports", f"{OLD_SQL} SELECT event_id AS log_id, 'purchase_order' AS document_type, coalesce(order_key, '') AS order_key, strftime(CASE WHEN event_id % 4 <> 0 THEN CAST(\"at\" AS DATE) ELSE DATE '{TODAY}' END, '%Y-%m-%d') AS exported_on, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'GL_' || document_id || '.csv' END AS filename, 'generated' AS status FROM cm LEFT JOIN ok ON ok.po_id = document_id")
def m16_exports(spark, d):
    E = F.col("event_id")
    rows = t.commands(spark, d).select(E.alias("log_id"), F.col("document_id").alias("po_id"), F.when(E % 4 != 0, F.to_date("at")).alias("exported_on"), F.when(E % 3 != 0, F.concat(F.lit("GL_"), F.col("document_id").cast("string"), F.lit(".csv"))).alias("filename"))
    return snapshot.exports(rows, old_orders(spark, d), TODAY).withColumn("exported_on", F.date_format("exported_on", "yyyy-MM-dd"))
