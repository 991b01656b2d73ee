"""Registered queries: state and joins over bucketed tables, matching of documents, budgets, conversion by a schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from purchaseflow.operators import keywords, ledger, validate
from purchaseflow.operators import purchasing as p
from purchaseflow.operators import versioned as v
from purchaseflow.sources import bucketed
from purchaseflow.sources import tables as t

from .registry import query
from .reports import LINE, LINE_SQL, ORDERED, WITH, _num

def buckets(spark, d) -> int:
    """Buckets of all tables that are joined with line versions, the largest one."""
    return bucketed.buckets_for(t.scan(spark, d, "lineitem"))


def bucketed_lines(spark, d, by=("pr_id",)):
    """Line versions by document, or by line; the last year's are appended to what was there."""
    rows, n = t.request_line_versions(spark, d), buckets(spark, d)
    year = F.year("version") >= 1998
    sort = [*t.LINE_KEYS, "version"]
    name = bucketed.create(rows.where(~year), by, sort, n)
    bucketed.append(name, rows.where(year), by, sort, n)
    return bucketed.read(spark, name)


def bucketed_current(spark, d, by=("pr_id",)):
    return v.current_state(bucketed_lines(spark, d, by), t.LINE_KEYS, t.LINE_ORDER)


def _stored(rows, n, *by):
    return bucketed.read(rows.sparkSession, bucketed.create(rows, by, by, n))


@query("v1_bucketed_state", f"{WITH} SELECT {LINE_SQL} FROM ln")
def v1_bucketed(spark, d):
    return _num(bucketed_current(spark, d).select(*LINE))


@query("v5_bucketed_lookup", f"{WITH} SELECT pr_id, line_no, item_id FROM ln WHERE is_deleted = 0 AND pr_id IN (SELECT pr_id FROM rq WHERE requester_id % 10 = 3)")
def v5_bucketed(spark, d):
    wanted = _stored(t.requests(spark, d).where("requester_id % 10 = 3").select("pr_id"), buckets(spark, d), "pr_id")
    return v.lookup(bucketed_lines(spark, d), wanted, t.LINE_KEYS, t.LINE_ORDER).select("pr_id", "line_no", "item_id")


@query("j1_bucketed_headers", f"{WITH} SELECT rq.pr_id, count(line_no) AS n_lines FROM rq LEFT JOIN (SELECT * FROM ln WHERE is_deleted = 0) USING (pr_id) GROUP BY rq.pr_id")
def j1_bucketed(spark, d):
    lines = bucketed_current(spark, d).where("is_deleted = 0").select("pr_id", "line_no")
    headers = _stored(t.requests(spark, d).select("pr_id"), buckets(spark, d), "pr_id")
    return headers.join(lines, "pr_id", "left").groupBy("pr_id").agg(F.count("line_no").alias("n_lines"))


@query("j2_bucketed_ordered", f"{WITH}, {ORDERED} SELECT ln.pr_id, ln.line_no, CAST(coalesce(od.ordered_qty, 0) AS DOUBLE) AS ordered_qty FROM ln LEFT JOIN od USING (pr_id, line_no)")
def j2_bucketed(spark, d):
    """Both tables lie in buckets of the line, so sums, state and join are made bucket by bucket."""
    lines = bucketed_current(spark, d, t.LINE_KEYS)
    return _num(p.with_ordered(lines, _stored(t.order_lines(spark, d), buckets(spark, d), *t.LINE_KEYS)).select("pr_id", "line_no", "ordered_qty"))


# --- order, receipt, invoice; budget and actual --------------------------------------------------------------------

SIDES_SQL = """e AS (
    SELECT po_id, item_id, side, pr_id * 10 + line_no AS doc, CAST(q AS DECIMAL(18,4)) AS q FROM (
        SELECT po_id, item_id, pr_id, line_no, 'o' AS side, ordered_qty AS q FROM ol WHERE is_deleted = 0
        UNION ALL SELECT po_id, item_id, pr_id, line_no, 'r', ordered_qty - line_no % 3 FROM ol WHERE is_deleted = 0 AND line_no % 4 <> 0
        UNION ALL SELECT po_id, item_id, pr_id, line_no, 'i', ordered_qty + line_no % 2 FROM ol WHERE is_deleted = 0 AND line_no % 3 <> 0) WHERE q > 0),
s AS (SELECT *, sum(q) OVER (PARTITION BY po_id, item_id, side ORDER BY doc, q ROWS UNBOUNDED PRECEDING) AS z FROM e),
b AS (SELECT po_id, item_id, z, max(doc) FILTER (side = 'o') AS o, max(doc) FILTER (side = 'r') AS r, max(doc) FILTER (side = 'i') AS i FROM s GROUP BY ALL),
m AS (SELECT po_id, item_id, CAST(coalesce(lag(z) OVER w, 0) AS DOUBLE) AS "begin", CAST(z - coalesce(lag(z) OVER w, 0) AS DOUBLE) AS qty, first_value(o IGNORE NULLS) OVER n AS order_doc,
      first_value(r IGNORE NULLS) OVER n AS receipt_doc, first_value(i IGNORE NULLS) OVER n AS invoice_doc
      FROM b WINDOW w AS (PARTITION BY po_id, item_id ORDER BY z), n AS (PARTITION BY po_id, item_id ORDER BY z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT *, CASE WHEN order_doc IS NOT NULL AND receipt_doc IS NULL THEN qty ELSE 0 END AS unreceived, CASE WHEN receipt_doc IS NOT NULL AND invoice_doc IS NULL THEN qty ELSE 0 END AS uninvoiced,
       CASE WHEN order_doc IS NULL THEN qty ELSE 0 END AS unordered,
       CASE WHEN order_doc IS NULL THEN 'beyond order' WHEN receipt_doc IS NOT NULL AND invoice_doc IS NOT NULL THEN 'matched' WHEN receipt_doc IS NOT NULL THEN 'to be invoiced' WHEN invoice_doc IS NOT NULL THEN 'to be received' ELSE 'open' END AS state
FROM m"""


@query("d5_three_way_match", f"{WITH}, {SIDES_SQL}")
def d5(spark, d):
    """By order and item: every fourth line isn't received and others partly, every third isn't invoiced and others in excess."""
    lines = v.live(t.order_lines(spark, d)).withColumn("doc", F.col("pr_id") * 10 + F.col("line_no"))
    side = lambda rows, qty: rows.select("po_id", "item_id", "doc", qty.cast("decimal(18,4)").alias("qty"))
    received = side(lines.where("line_no % 4 <> 0"), F.col("ordered_qty") - F.col("line_no") % 3)
    invoiced = side(lines.where("line_no % 3 <> 0"), F.col("ordered_qty") + F.col("line_no") % 2)
    return _num(ledger.three_way_match(side(lines, F.col("ordered_qty")), received, invoiced, ["po_id", "item_id"], "doc", [], "qty"))


MOVED_SQL = """mv AS (
    SELECT category AS department, brand AS account, month(lv.version) AS period, 'budget' AS kind, CAST(price * 2 AS DECIMAL(18,2)) AS amount FROM lv JOIN it USING (item_id) WHERE line_no % 2 = 0
    UNION ALL SELECT category, brand, po_id % 100, 'actual', unit_price FROM ol JOIN it USING (item_id) WHERE ol.is_deleted = 0
    UNION ALL SELECT category, brand, month(ln.version), 'committed', price FROM ln JOIN it USING (item_id) WHERE status = 'approved' AND ln.is_deleted = 0 AND (pr_id, line_no) NOT IN (SELECT (pr_id, line_no) FROM ol)),
g AS (SELECT department, account, period, coalesce(sum(amount) FILTER (kind = 'budget'), 0) AS budget, coalesce(sum(amount) FILTER (kind = 'actual'), 0) AS actual, coalesce(sum(amount) FILTER (kind = 'committed'), 0) AS committed FROM mv GROUP BY ALL),
r AS (SELECT *, sum(budget - actual - committed) OVER (PARTITION BY department, account ORDER BY period) AS run FROM g)
SELECT CAST(GROUPING(department, account, period) AS INT) AS level, department, account, CAST(period AS BIGINT) AS period, CAST(sum(budget) AS DOUBLE) AS budget, CAST(sum(actual) AS DOUBLE) AS actual, CAST(sum(committed) AS DOUBLE) AS committed,
       CAST(sum(budget) - sum(actual) - sum(committed) AS DOUBLE) AS left_over, CASE WHEN GROUPING(department, account, period) = 0 THEN CAST(max(run) AS DOUBLE) END AS left_to_date
FROM r GROUP BY GROUPING SETS ((department, account, period), (department, account), (department, period), (department), ())"""


@query("d4_budget_report", f"{WITH}, {MOVED_SQL}")
def d4(spark, d):
    """Every second requested line is twice budgeted, ordered ones are actual, approved ones without an order committed."""
    items = t.items(spark, d).select("item_id", F.col("category").alias("department"), F.col("brand").alias("account"))
    versions, orders = t.request_line_versions(spark, d), t.order_lines(spark, d)
    lines = v.live(v.current_state(versions, t.LINE_KEYS, t.LINE_ORDER)).where("status = 'approved'").join(orders.select("pr_id", "line_no"), ["pr_id", "line_no"], "left_anti")
    part = lambda rows, period, kind, amount: rows.select("item_id", period.cast("long").alias("period"), F.lit(kind).alias("kind"), amount.cast("decimal(18,2)").alias("amount"))
    moved = part(versions.where("line_no % 2 = 0"), F.month("version"), "budget", F.col("price") * 2)
    moved = moved.union(part(v.live(orders), F.col("po_id") % 100, "actual", F.col("unit_price"))).union(part(lines, F.month("version"), "committed", F.col("price")))
    return _num(ledger.budget_report(moved.join(items, "item_id"), "department", "account", "period", "kind", "amount"))


# --- conversion by a schema ----------------------------------------------------------------------------------------

TEXTS = {
    "uid": ("CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN '6F9619FF-8B86-D011-B42D-00C04FC964FF' WHEN 2 THEN '6F9619FF' END", "uuid"),
    "day": ("CASE item_id % 5 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2023-02-29' WHEN 2 THEN '2024-2-9' WHEN 3 THEN '' END", "date"),
    "moment": ("CASE item_id % 4 WHEN 0 THEN '2024-02-29 10:11:12.5' WHEN 1 THEN '2024-02-29T10:11:12' WHEN 2 THEN '2024-02-29 25:00:00' END", "timestamp"),
    "small": ("CASE item_id % 4 WHEN 0 THEN '-32768' WHEN 1 THEN '32768' WHEN 2 THEN '1.0' END", "short"),
    "whole": ("CASE item_id % 3 WHEN 0 THEN '2147483647' WHEN 1 THEN '-2147483649' ELSE CAST(item_id AS VARCHAR) END", "integer"),
    "large": ("CASE item_id % 3 WHEN 0 THEN '-9223372036854775808' WHEN 1 THEN '9223372036854775808' ELSE '+1' END", "long"),
    "money": ("CASE item_id % 4 WHEN 0 THEN '-12.50' WHEN 1 THEN '123456789.00' WHEN 2 THEN '1e3' END", "decimal(8,2)"),
    "label": ("CASE item_id % 4 WHEN 0 THEN 'a' || chr(0) || 'b' WHEN 1 THEN '' WHEN 2 THEN name_en END", "string"),
}
#: Columns that may not be null.
NEEDED = ("moment", "label")
TYPED_SQL = f"""{WITH}, x AS (SELECT item_id, {", ".join(f"{sql} AS {c}" for c, (sql, _) in TEXTS.items())} FROM it),
e AS (
    SELECT item_id, 'uid' AS column_name, 'invalid uuid ' || uid AS error FROM x WHERE uid <> '' AND length(uid) < 36
    UNION ALL SELECT item_id, 'day', 'invalid date ' || "day" FROM x WHERE "day" IS NOT NULL AND "day" <> '2024-02-29'
    UNION ALL SELECT item_id, 'moment', CASE WHEN moment IS NULL THEN 'NULL for NOT NULL column' ELSE 'invalid timestamp ' || moment END FROM x WHERE moment IS NULL OR moment <> '2024-02-29 10:11:12.5'
    UNION ALL SELECT item_id, 'small', CASE small WHEN '32768' THEN 'smallint out of range 32768' ELSE 'invalid smallint 1.0' END FROM x WHERE small IN ('32768', '1.0')
    UNION ALL SELECT item_id, 'whole', 'integer out of range ' || whole FROM x WHERE whole = '-2147483649'
    UNION ALL SELECT item_id, 'large', CASE "large" WHEN '+1' THEN 'invalid bigint +1' ELSE 'bigint out of range ' || "large" END FROM x WHERE "large" IN ('+1', '9223372036854775808')
    UNION ALL SELECT item_id, 'money', CASE money WHEN '1e3' THEN 'invalid numeric 1e3' ELSE 'numeric out of range ' || money END FROM x WHERE money IN ('1e3', '123456789.00')
    UNION ALL SELECT item_id, 'label', CASE WHEN label IS NULL THEN 'NULL for NOT NULL column' ELSE 'contains NUL byte' END FROM x WHERE label IS NULL OR item_id % 4 = 0)
"""


def converted_items(spark, d):
    spark_sql = lambda sql: sql.replace("AS VARCHAR", "AS STRING")
    texts = t.items(spark, d).selectExpr("item_id", *(f"{spark_sql(sql)} AS {c}" for c, (sql, _) in TEXTS.items()))
    target = StructType()
    for c, (_, kind) in TEXTS.items():
        target = target.add(c, "string" if kind == "uuid" else kind, c not in NEEDED, {"kind": "uuid", "empty": "null"} if kind == "uuid" else None)
    return validate.convert_to(texts, target)


@query("c1_schema_errors", f"{TYPED_SQL} SELECT * FROM e")
def c1_errors(spark, d):
    """Every kind of column with good and bad texts; one row for each text that the target can't take."""
    return converted_items(spark, d).select("item_id", F.explode("errors").alias("e")).select("item_id", "e.column_name", "e.error")


@query("c1_schema_rows", f"""{TYPED_SQL} SELECT item_id, CASE WHEN length(uid) = 36 THEN lower(uid) END AS uid, CASE "day" WHEN '2024-02-29' THEN "day" END AS "day", CASE moment WHEN '2024-02-29 10:11:12.5' THEN '2024-02-29 10:11:12' END AS moment,
    CASE small WHEN '-32768' THEN -32768 END AS small, CASE WHEN whole <> '-2147483649' THEN CAST(whole AS INT) END AS whole, CASE "large" WHEN '-9223372036854775808' THEN CAST("large" AS BIGINT) END AS "large",
    CAST(CASE money WHEN '-12.50' THEN -12.5 END AS DOUBLE) AS money, CASE WHEN item_id % 4 <> 0 THEN label END AS label, CAST((SELECT count(*) FROM e WHERE e.item_id = x.item_id) AS INT) AS n_errors FROM x""")
def c1_rows(spark, d):
    out = converted_items(spark, d)
    return _num(out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "moment": F.date_format("moment", "yyyy-MM-dd HH:mm:ss"), "small": F.col("small").cast("int"), "n_errors": F.size("errors")}).drop("errors"))


# --- keyword rules -------------------------------------------------------------------------------------------------

RULE_SETS_SQL = f"""{WITH}, x AS (SELECT item_id, brand, lower(name_en || ' ' || category) AS x, name_en, category FROM it),
k AS (SELECT 'by_head' AS s, item_id AS no, brand AS c, substr(name_en, 1, 7) AS w FROM it WHERE item_id % 2 = 0
      UNION ALL SELECT 'by_middle', 1000000000 - item_id, brand, substr(name_en, 4, 5) FROM it
      UNION ALL SELECT 'by_type', item_id, brand, substr(category, 1 + item_id % 9, 8) FROM it WHERE item_id % 3 = 0),
l AS (SELECT s, lower(w) AS w, min(no) AS no FROM k GROUP BY ALL),
h AS (SELECT item_id, s, min(no) AS no FROM x JOIN l ON contains(x, w) GROUP BY ALL),
n AS (SELECT s, no, min(c) AS c FROM k GROUP BY ALL),
r AS (SELECT item_id, s, c FROM h JOIN n USING (s, no))
SELECT item_id, coalesce(max(c) FILTER (s = 'by_head'), 'Uncategorized') AS by_head, coalesce(max(c) FILTER (s = 'by_middle'), 'Uncategorized') AS by_middle, coalesce(max(c) FILTER (s = 'by_type'), 'Uncategorized') AS by_type
FROM it LEFT JOIN r USING (item_id) GROUP BY item_id"""


@query("f13_rule_sets", RULE_SETS_SQL)
def f13_sets(spark, d):
    """Three rule sets that disagree, with keywords cut from all names and types, many within words."""
    items = t.items(spark, d)
    rule = lambda rows, no, word: rows.select(no.alias("rule_no"), F.col("brand").alias("category"), word.alias("keyword"))
    rules = keywords.by_rule_table({
        "by_head": rule(items.where("item_id % 2 = 0"), F.col("item_id"), F.substring("name_en", 1, 7)),
        "by_middle": rule(items, 1_000_000_000 - F.col("item_id"), F.substring("name_en", 4, 5)),
        "by_type": rule(items.where("item_id % 3 = 0"), F.col("item_id"), F.col("category").substr(F.col("item_id").cast("int") % 9 + 1, F.lit(8))),
    })
    texts = items.select("item_id", F.concat_ws(" ", "name_en", "category").alias("text"))
    return keywords.classify(texts, "text", rules, ["by_head", "by_middle", "by_type"]).drop("text")
