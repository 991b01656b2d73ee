"""Registered queries: sync, reconciliation, validation, numbering, naming, matching, corrections, files and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purchaseflow.functions import naming as n
from purchaseflow.operators import corrections, match, numbering, purchasing, reconcile, sync, validate
from purchaseflow.operators import versioned as v
from purchaseflow.sources import cells as cell
from purchaseflow.sources import files
from purchaseflow.sources import tables as t
from purchaseflow.streaming import jobs as streams

from .registry import query
from .reports import LINE, LINE_SQL, ORDER_STATUS_SQL, WITH, _num, current_lines, order_commands

# --- replication -------------------------------------------------------------------------------------------------

SINCE = "1997-01-01 00:00:00"
EPOCH_MS = "CAST(epoch_ms(version) AS BIGINT)"


@query("r1_incremental_changes", f"{WITH} SELECT pr_id, line_no, {EPOCH_MS} AS sync_version FROM lv WHERE version > TIMESTAMP '{SINCE}'")
def r1(spark, d):
    return sync.changes(t.request_line_versions(spark, d), "version", SINCE).select("pr_id", "line_no", "sync_version")


@query("r2_version_floor", f"{WITH} SELECT pr_id, line_no, greatest({EPOCH_MS}, 800000000000) AS sync_version FROM lv")
def r2(spark, d):
    return t.request_line_versions(spark, d).select("pr_id", "line_no", sync.version_of(F.col("version"), 800_000_000_000).alias("sync_version"))


@query("r3_watermark", f"{WITH} SELECT strftime(max(version) - INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S') AS since FROM lv")
def r3(spark, d):
    state = t.request_line_versions(spark, d).select(F.col("version").alias("synced_through"))
    return spark.createDataFrame([(sync.watermark(state),)], "since string")


def synced(spark, d, runs: int) -> DataFrame:
    """Old versions are in the target; runs of the sync, each overlapping the one before, bring the rest."""
    base, rows = files.work_folder(spark), t.request_line_versions(spark, d)
    old = rows.where(F.col("version") <= F.lit("1997-06-01 00:00:00").cast("timestamp_ntz"))
    old.withColumn("sync_version", sync.version_of(F.col("version"))).write.parquet(f"{base}/target")
    sync.advance(spark, f"{base}/state", "1997-06-01 00:00:00", "full")
    for k in range(runs):
        # every run starts when the first one did, so the watermark stays and all that is newer comes again
        sync.run({"lines": (rows, "version", f"{base}/target")}, f"{base}/state", "1997-06-01 00:00:00")
    return spark.read.parquet(f"{base}/target")


@query("r4_sync_applied", f"{WITH} SELECT {LINE_SQL} FROM ln")
def r4(spark, d):
    rows = synced(spark, d, 1)
    return _num(sync.apply_changes(rows.limit(0), rows, t.LINE_KEYS, t.LINE_ORDER).select(*LINE))


RUNS = ("1993-06-01 00:00:00", "1995-01-01 00:00:00", "1996-06-01 00:00:00")
RUNS_SQL = " UNION ALL ".join(
    f"SELECT {k} AS run, '{'incremental' if k else 'full'}' AS mode, '{since}' AS since, (SELECT count(*) FROM lv WHERE version > TIMESTAMP '{since}' AND version <= TIMESTAMP '{now}') AS n_copied"
    for k, (since, now) in enumerate(zip(("1970-01-01 00:00:00", "1993-05-31 23:45:00", "1994-12-31 23:45:00"), RUNS))
)


@query("r4_moving_watermark", f"{WITH} {RUNS_SQL}")
def r4_runs(spark, d):
    """Three runs of the sync from nothing, each over what the source had when it started: the first copies all, the others what
    is new since the start of the one before, less the overlap."""
    base, rows = files.work_folder(spark), t.request_line_versions(spark, d)
    found, before = [], 0
    for k, now in enumerate(RUNS):
        there = rows.where(F.col("version") <= F.lit(now).cast("timestamp_ntz"))
        since = sync.run({"lines": (there, "version", f"{base}/target")}, f"{base}/state", now)
        total = spark.read.parquet(f"{base}/target").count()
        found.append((k, since, total - before))
        before = total
    modes = spark.read.parquet(f"{base}/state").select(F.date_format("synced_through", "yyyy-MM-dd HH:mm:ss").alias("now"), "mode")
    runs = spark.createDataFrame([(*f, now) for f, now in zip(found, RUNS)], "run int, since string, n_copied long, now string")
    return runs.join(modes, "now").select("run", "mode", "since", "n_copied")


@query("r5_append_only", f"{WITH} SELECT event_id FROM cm WHERE event_id NOT IN (SELECT event_id FROM cm WHERE event_id % 3 = 0)")
def r5(spark, d):
    log = t.commands(spark, d)
    return sync.append_only(log, log.where("event_id % 3 = 0"), "event_id").select("event_id")


@query("r6_full_and_bump", f"{WITH} SELECT pr_id, line_no, CAST(4000000000000 AS BIGINT) AS sync_version FROM lv")
def r6(spark, d):
    return sync.changes(t.request_line_versions(spark, d), "version", sync.EPOCH, floor=4_000_000_000_000).select("pr_id", "line_no", "sync_version")


@query("r7_type_conversion", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc_text, coalesce(CAST(user_id AS VARCHAR), '') AS document, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS amount FROM events WHERE value IS NOT NULL")
def r7(spark, d):
    e = t.scan(spark, d, "events").where("value IS NOT NULL")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("utc_text"), F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("document"), F.col("value").cast("decimal(18,2)").cast("double").alias("amount"))


@query("r8_presence", f"{WITH} SELECT 'lines' AS table_name, count(*) AS source_rows, (SELECT count(DISTINCT pr_id) FROM rq) AS target_ids, count(*) FILTER (pr_id NOT IN (SELECT pr_id FROM rq)) AS missing, 'OK' AS state FROM lv UNION ALL SELECT 'items', (SELECT count(*) FROM it), (SELECT count(DISTINCT item_id) FROM ol), (SELECT count(*) FROM it WHERE item_id NOT IN (SELECT item_id FROM ol)), CASE WHEN (SELECT count(*) FROM it WHERE item_id NOT IN (SELECT item_id FROM ol)) > 0 THEN 'MISSING' ELSE 'OK' END")
def r8(spark, d):
    return reconcile.stacked([
        reconcile.presence("lines", t.request_line_versions(spark, d), t.requests(spark, d), "pr_id"),
        reconcile.presence("items", t.items(spark, d), t.order_lines(spark, d), "item_id"),
    ])


@query("r9_two_sides", f"{WITH}, a AS (SELECT * FROM rq), b AS (SELECT * FROM rq WHERE pr_id % 100 <> 7) SELECT 'requests' AS table_name, (SELECT count(*) FROM a) AS ids_a, (SELECT count(*) FROM b) AS ids_b, (SELECT count(*) FROM a WHERE is_deleted = 0) AS live_a, (SELECT count(*) FROM b WHERE is_deleted = 0) AS live_b, (SELECT count(*) FROM a WHERE pr_id NOT IN (SELECT pr_id FROM b)) AS missing, CAST(0 AS BIGINT) AS extra, (SELECT CAST(sum(total) AS DOUBLE) FROM a WHERE is_deleted = 0) AS sum_a_total, (SELECT CAST(sum(total) AS DOUBLE) FROM b WHERE is_deleted = 0) AS sum_b_total, CASE WHEN (SELECT count(*) FROM a WHERE pr_id NOT IN (SELECT pr_id FROM b)) > 0 THEN 'MISMATCH' ELSE 'MATCH' END AS state")
def r9(spark, d):
    a = t.requests(spark, d)
    return _num(reconcile.two_sides("requests", a, a.where("pr_id % 100 != 7"), "pr_id", ["total"]))


@query("r10_exact_sum", f"{WITH} SELECT CAST(sum(CAST(price AS DECIMAL(38,4))) AS VARCHAR) AS total FROM lv")
def r10(spark, d):
    return t.request_line_versions(spark, d).agg(F.sum(F.col("price").cast("decimal(28,4)")).cast("decimal(38,4)").cast("string").alias("total"))


def _row_text(table: str, columns: str) -> str:
    text = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns.split())
    return f"SELECT '{table[0]}' AS table_name, count(*) AS n_rows, CAST(sum(CAST(('0x' || substr(md5({text}), 1, 15))::BIGINT AS HUGEINT)) AS VARCHAR) AS checksum FROM {table[1]}"


R11_SQL = " UNION ALL ".join((
    _row_text(("requests", "rq"), "pr_id requester_id status pr_date priority total is_deleted"), _row_text(("items", "it"), "item_id name_en category brand size is_deleted"),
    _row_text(("order_lines", "ol"), "po_id vendor_id pr_id line_no item_id ordered_qty unit_price is_deleted"),
))


@query("r11_checksum", f"{WITH} {R11_SQL}")
def r11(spark, d):
    return reconcile.stacked([reconcile.checksum(name, f(spark, d)) for name, f in (("requests", t.requests), ("items", t.items), ("order_lines", t.order_lines))])


@query("r12_side_counts", f"{WITH} SELECT 'lines' AS table_name, (SELECT count(*) FROM ln) AS n_current, (SELECT count(*) FROM lv) AS n_stored UNION ALL SELECT 'events', (SELECT count(*) FROM cm), (SELECT count(*) FROM cm)")
def r12(spark, d):
    rows, log = t.request_line_versions(spark, d), t.commands(spark, d)
    current = rows.select(*t.LINE_KEYS).distinct()
    return reconcile.in_one_row("lines", n_current=current, n_stored=rows).union(reconcile.in_one_row("events", n_current=log, n_stored=log))


@query("r13_sync_twice", f"{WITH} SELECT {LINE_SQL} FROM ln")
def r13(spark, d):
    rows = synced(spark, d, 2)
    return _num(sync.apply_changes(rows.limit(0), rows, t.LINE_KEYS, t.LINE_ORDER).select(*LINE))


@query("a17_distinct_exact", f"{WITH} SELECT count(DISTINCT item_id) AS n_distinct FROM lv")
def a17(spark, d):
    return reconcile.distinct_exact(t.request_line_versions(spark, d), "item_id")


@query("a23_probes", f"{WITH} SELECT 'requests' AS table_name, count(*) AS n_rows, count(priority) AS n_known, CAST(sum(total) AS DOUBLE) AS total, strftime(max(pr_date), '%Y-%m-%d') AS latest FROM rq UNION ALL SELECT 'lines', count(*), count(status), CAST(sum(price) AS DOUBLE), strftime(max(version), '%Y-%m-%d') FROM lv")
def a23(spark, d):
    lines = t.request_line_versions(spark, d).withColumn("day", F.to_date("version"))
    return reconcile.probe("requests", t.requests(spark, d), "priority", "total", "pr_date").union(reconcile.probe("lines", lines, "status", "price", "day"))


@query("s12_catalog", "SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def s12(spark, d):
    return reconcile.stacked([t.scan(spark, d, x).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(x).alias("table_name"), "n_rows") for x in ("orders", "part", "lineitem")])


# --- validation --------------------------------------------------------------------------------------------------


@query("c1_typed_errors", f"{WITH}, x AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN CAST(size AS VARCHAR) WHEN 1 THEN CAST(size AS VARCHAR) || 'mm' WHEN 2 THEN '' END AS size_text FROM it) SELECT item_id, 'size_text' AS column_name, size_text AS value, 'not long: ' || size_text AS error FROM x WHERE size_text LIKE '%mm'")
def c1(spark, d):
    size = F.col("size").cast("string")
    text = F.when(F.col("item_id") % 4 == 0, size).when(F.col("item_id") % 4 == 1, F.concat(size, F.lit("mm"))).when(F.col("item_id") % 4 == 2, "")
    return validate.convert_all(t.items(spark, d).select("item_id", text.alias("size_text")), "item_id", {"size_text": "long"})[1]


@query("c2_empty_to_null", f"{WITH} SELECT item_id, nullif(CASE WHEN item_id % 3 = 0 THEN '' ELSE brand END, '') AS brand FROM it")
def c2(spark, d):
    rows = t.items(spark, d).select("item_id", F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("brand")).alias("brand"))
    return validate.empty_to_null(rows, ["brand"])


@query("c3_stripped", f"{WITH} SELECT count(*) AS brand FROM it WHERE item_id % 5 = 0")
def c3(spark, d):
    rows = t.items(spark, d).select(F.when(F.col("item_id") % 5 == 0, F.concat("brand", F.lit("\0\0"))).otherwise(F.col("brand")).alias("brand"))
    return validate.strip_nul(rows, ["brand"])[1]


@query("c4_bad_keys", f"{WITH} SELECT size FROM it WHERE item_id % 7 = 0")
def c4(spark, d):
    rows = t.items(spark, d).select("size", F.when(F.col("item_id") % 14 == 0, "").when(F.col("item_id") % 7 == 0, None).otherwise(F.col("item_id").cast("string")).alias("k"))
    return validate.bad_keys(rows, "k").select("size")


@query("c5_duplicates", f"{WITH} SELECT name_en, count(*) AS n, min(item_id) AS first_label, max(item_id) AS last_label FROM it GROUP BY name_en HAVING count(*) > 1")
def c5(spark, d):
    return validate.duplicates(t.items(spark, d), ["name_en"], "item_id")


@query("a11_duplicate_groups", f"{WITH} SELECT pr_id, vendor_id, count(*) AS n, min(line_no) AS first_label, max(line_no) AS last_label FROM lv GROUP BY ALL HAVING count(*) > 1")
def a11(spark, d):
    return validate.duplicates(t.request_line_versions(spark, d), ["pr_id", "vendor_id"], "line_no")


@query("c6_live_unique", f"{WITH} SELECT name_en, brand, count(*) AS n, min(item_id) AS first_label, max(item_id) AS last_label FROM it WHERE is_deleted = 0 GROUP BY ALL HAVING count(*) > 1")
def c6(spark, d):
    return validate.duplicates(v.live(t.items(spark, d)), ["name_en", "brand"], "item_id")


@query("a11_group_members", f"{WITH} SELECT pr_id, vendor_id, line_no, n FROM (SELECT *, count(*) OVER (PARTITION BY pr_id, vendor_id) AS n FROM lv) WHERE n > 1")
def a11_members(spark, d):
    return validate.members(t.request_line_versions(spark, d), ["pr_id", "vendor_id"]).select("pr_id", "vendor_id", "line_no", "n")


@query("c6_live_members", f"{WITH} SELECT name_en, item_id, n FROM (SELECT *, count(*) OVER (PARTITION BY name_en) AS n FROM it WHERE is_deleted = 0) WHERE n > 1")
def c6_members(spark, d):
    return validate.members(v.live(t.items(spark, d)), ["name_en"]).select("name_en", "item_id", "n")


@query("j7_orphans", f"{WITH} SELECT pr_id, line_no FROM lv WHERE pr_id NOT IN (SELECT pr_id FROM rq WHERE status <> 'rejected')")
def j7(spark, d):
    return validate.orphans(t.request_line_versions(spark, d), "pr_id", t.requests(spark, d).where("status != 'rejected'"), "pr_id").select("pr_id", "line_no")


C7_SQL = f"""{WITH}, po AS (SELECT po_id, CASE WHEN po_id % 9 = 0 THEN '' ELSE CAST(min(pr_id) AS VARCHAR) END AS primary_pr FROM ol WHERE po_id % 13 <> 5 GROUP BY po_id),
ch AS (SELECT DISTINCT po_id FROM ol WHERE po_id % 2 = 0), tp AS (SELECT DISTINCT category FROM it WHERE length(category) % 2 = 0)
SELECT 'line_request' AS rule, count(*) AS n FROM lv WHERE pr_id NOT IN (SELECT pr_id FROM rq WHERE is_deleted = 0)
UNION ALL SELECT 'line_item', count(*) FROM lv WHERE item_id NOT IN (SELECT item_id FROM it WHERE is_deleted = 0)
UNION ALL SELECT 'order_line_order', count(*) FROM ol WHERE po_id NOT IN (SELECT po_id FROM po)
UNION ALL SELECT 'order_line_request_line', count(*) FROM ol WHERE pr_id * 10 + line_no NOT IN (SELECT pr_id * 10 + line_no FROM ln WHERE is_deleted = 0)
UNION ALL SELECT 'order_line_item', count(*) FROM ol WHERE item_id NOT IN (SELECT item_id FROM it WHERE is_deleted = 0)
UNION ALL SELECT 'order_primary_request', count(*) FROM po WHERE primary_pr <> '' AND primary_pr NOT IN (SELECT CAST(pr_id AS VARCHAR) FROM rq WHERE is_deleted = 0)
UNION ALL SELECT 'charge_order', count(*) FROM ch WHERE po_id NOT IN (SELECT po_id FROM po)
UNION ALL SELECT 'template_item_template', count(*) FROM it WHERE category NOT IN (SELECT category FROM tp)
UNION ALL SELECT 'order_vendor', count(*) FROM ol WHERE vendor_id NOT IN (SELECT vendor_id FROM ve)"""


@query("c7_referential_checks", C7_SQL)
def c7(spark, d):
    """Nine rules over five tables of children, one shuffle for each of six parents."""
    lines, ordered, items = t.request_line_versions(spark, d), t.order_lines(spark, d), t.items(spark, d)
    line_id = (F.col("pr_id") * 10 + F.col("line_no")).alias("line_id")
    orders = ordered.where("po_id % 13 != 5").groupBy("po_id").agg(F.min("pr_id").cast("string").alias("pr")).select("po_id", F.when(F.col("po_id") % 9 == 0, "").otherwise(F.col("pr")).alias("primary_pr"))
    children = [
        (lines, {"line_request": ("pr_id", "request"), "line_item": ("item_id", "item")}),
        (ordered.withColumn("line_id", line_id), {"order_line_order": ("po_id", "order"), "order_line_request_line": ("line_id", "line"), "order_line_item": ("item_id", "item"), "order_vendor": ("vendor_id", "vendor")}),
        (orders, {"order_primary_request": ("primary_pr", "request")}), (ordered.where("po_id % 2 = 0").select("po_id").distinct(), {"charge_order": ("po_id", "order")}), (items, {"template_item_template": ("category", "template")}),
    ]
    parents = {
        "request": (v.live(t.requests(spark, d)), "pr_id"), "item": (v.live(items), "item_id"), "order": (orders, "po_id"), "line": (v.live(current_lines(spark, d)).select(line_id), "line_id"),
        "template": (items.where("length(category) % 2 = 0"), "category"), "vendor": (t.vendors(spark, d), "vendor_id"),
    }
    return validate.referential_counts(children, parents)


@query("c8_domain", f"{WITH} SELECT pr_id, priority FROM rq WHERE priority NOT IN ('1-URGENT', '2-HIGH')")
def c8(spark, d):
    return validate.outside(t.requests(spark, d), "priority", ["1-URGENT", "2-HIGH"]).select("pr_id", "priority")


@query("c9_deleted_notes", f"{WITH} SELECT item_id FROM it WHERE is_deleted = 1")
def c9(spark, d):
    return t.items(spark, d).where("is_deleted = 1").select("item_id")


@query("o9_capped_listing", f"{WITH}, f AS (SELECT vendor_id, pr_id, line_no, row_number() OVER (PARTITION BY vendor_id ORDER BY pr_id, line_no) AS r, count(*) OVER (PARTITION BY vendor_id) AS n FROM ln) SELECT vendor_id, pr_id, line_no, greatest(n - 50, 0) AS n_more FROM f WHERE r <= 50")
def o9(spark, d):
    return validate.capped(current_lines(spark, d).select("vendor_id", "pr_id", "line_no"), "vendor_id", ["pr_id", "line_no"])


@query("c10_publish", f"{WITH} SELECT 'clean' AS job, (SELECT count(*) FROM it) AS n_written UNION ALL SELECT 'dirty', 0")
def c10(spark, d):
    """A job whose checks are empty is published, one with findings writes nothing; what is there then is counted."""
    items, out = t.items(spark, d), []
    for name, findings in (("clean", items.where("item_id IS NULL")), ("dirty", items.where("is_deleted = 1"))):
        path = files.work_folder(spark)
        wrote = not any(files.publish(items, path, {"check": findings}).values())
        table = spark.read.parquet(path) if wrote else items.limit(0)
        out.append(table.agg(F.count(F.lit(1)).alias("n_written")).select(F.lit(name).alias("job"), "n_written"))
    return reduce(DataFrame.union, out)


@query("c10_outcomes", f"{WITH} SELECT 0 AS job, 0 AS outcome, (SELECT count(*) FROM it) AS n_stored UNION ALL SELECT 1, 1, (SELECT count(*) FROM it) UNION ALL SELECT 2, 2, (SELECT count(*) FROM it WHERE item_id % 2 = 0)")
def c10_outcomes(spark, d):
    """Three loads into one table: a good one, one that a check refuses, one that stores half of what was meant."""
    items, path, out = t.items(spark, d), files.work_folder(spark), []
    half = items.where("item_id % 2 = 0")
    for job, (rows, findings) in enumerate(((items, items.where("item_id IS NULL")), (half, items.where("is_deleted = 1")), (half, items.where("item_id IS NULL")))):
        outcome, _ = files.load(rows, path, {"check": findings}, lambda stored: items.join(stored, "item_id", "left_anti"))
        counted = files.read_version(spark, path, items.schema).agg(F.count(F.lit(1)).alias("n_stored"))
        out.append(counted.select(F.lit(job).alias("job"), F.lit(outcome).alias("outcome"), "n_stored"))
    return reduce(DataFrame.union, out)


@query("c13_first_error", f"{WITH}, e AS (SELECT pr_id, line_no, CASE WHEN requested_qty > 49 THEN 'quantity too large' WHEN status = 'rejected' THEN 'line is rejected' END AS error FROM ln), f AS (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY line_no) AS r FROM e WHERE error IS NOT NULL) SELECT pr_id, error FROM f WHERE r = 1")
def c13(spark, d):
    return validate.first_error(current_lines(spark, d), "pr_id", "line_no", [(F.col("requested_qty") > 49, "quantity too large"), (F.col("status") == "rejected", "line is rejected")])


@query("c14_bad_charges", f"{WITH} SELECT pr_id FROM rq WHERE priority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR total < 1000")
def c14(spark, d):
    known = F.broadcast(spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "priority string"))  # a fixed list
    rows = t.requests(spark, d)
    bad_kind = rows.join(known, "priority", "left_anti").select("pr_id")
    return bad_kind.union(rows.join(known, "priority", "left_semi").where("total < 1000").select("pr_id"))


@query("a18_failed_casts", f"{WITH} SELECT count(*) FILTER (NOT regexp_matches(name_en || size, '^[0-9]+$')) AS n_failed FROM it")
def a18(spark, d):
    return t.items(spark, d).agg(F.count_if(F.concat("name_en", F.col("size").cast("string")).try_cast("long").isNull()).alias("n_failed"))


# --- numbering ---------------------------------------------------------------------------------------------------


@query("w1_line_numbers", f"{WITH} SELECT document_id, event_id, row_number() OVER (PARTITION BY document_id ORDER BY event_id) AS line_no FROM cm")
def w1(spark, d):
    return numbering.line_numbers(t.commands(spark, d), "document_id", "event_id").select("document_id", "event_id", F.col("line_no").cast("long"))


@query("w2_first_occurrence", f"{WITH} SELECT name_en, min(item_id) AS item_id FROM it GROUP BY name_en")
def w2(spark, d):
    return match.first_per_key(t.items(spark, d), ["name_en"], ["item_id"]).select("name_en", "item_id")


LEGACY_SQL = "lg AS (SELECT item_id, item_id % 500 AS legacy_id, is_deleted, size FROM it)"


def legacy(spark, d):
    return t.items(spark, d).select("item_id", (F.col("item_id") % 500).alias("legacy_id"), "is_deleted", "size")


@query("w3_repair_live", f"{WITH}, {LEGACY_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY legacy_id ORDER BY item_id) AS r FROM lg) SELECT item_id, CASE WHEN r = 1 THEN legacy_id ELSE (SELECT max(legacy_id) FROM lg) + count(*) FILTER (r > 1) OVER (ORDER BY legacy_id, item_id) END AS new_id FROM k")
def w3(spark, d):
    return numbering.repair_live(legacy(spark, d), "legacy_id", ["item_id"]).select("item_id", "new_id")


@query("w4_repair_all", f"{WITH}, {LEGACY_SQL}, k AS (SELECT *, sum(1 - is_deleted) OVER (PARTITION BY legacy_id) AS alive, row_number() OVER (PARTITION BY legacy_id ORDER BY is_deleted, size, item_id) AS r FROM lg) SELECT item_id, CASE WHEN alive > 1 OR r = 1 THEN legacy_id END AS fixed_id, alive > 1 AS conflict FROM k")
def w4(spark, d):
    return numbering.repair_all(legacy(spark, d), "legacy_id", ["size", "item_id"]).select("item_id", "fixed_id", "conflict")


def greatest_item(spark, d) -> int:
    """The greatest item number, 0 without items."""
    return t.items(spark, d).agg(F.coalesce(F.max("item_id"), F.lit(0))).first()[0]


@query("w5_deferred_ids", f"{WITH} SELECT pr_id, (SELECT max(item_id) FROM it) + row_number() OVER (ORDER BY pr_id) AS new_id FROM rq WHERE status = 'pending'")
def w5(spark, d):
    return numbering.dense_numbers(t.requests(spark, d).where("status = 'pending'").select("pr_id"), ["pr_id"], greatest_item(spark, d), "new_id")


@query("w6_document_numbers", f"{WITH}, c AS (SELECT CAST(year(pr_date) AS INT) AS y, count(*) % 7 AS last_no FROM rq GROUP BY 1), k AS (SELECT pr_id, y, last_no + row_number() OVER (PARTITION BY y ORDER BY pr_id) AS no FROM rq JOIN c ON year(pr_date) = y) SELECT pr_id, 'PR-' || y || '-' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS doc_no FROM k")
def w6(spark, d):
    rows = t.requests(spark, d).withColumn("y", F.year("pr_date"))
    counters = rows.groupBy(F.col("y").alias("year")).agg((F.count(F.lit(1)) % 7).alias("last_no"))
    return numbering.document_numbers(rows, counters, "y", ["pr_id"], "PR").select("pr_id", "doc_no")


@query("a12_counter_seed", f"{WITH} SELECT CAST(year(pr_date) AS VARCHAR) AS year, max(pr_id) AS last_no FROM rq WHERE pr_id % 10 <> 3 GROUP BY 1")
def a12(spark, d):
    number = F.when(F.col("pr_id") % 10 == 3, "OLD/1").otherwise(F.concat_ws("-", F.lit("PR"), F.year("pr_date").cast("string"), F.col("pr_id").cast("string")))
    return numbering.counter_seed(t.requests(spark, d).select(number.alias("doc_no")), "doc_no", r"^PR-(\d{4})-(\d+)$")


@query("f29_next_number", f"{WITH} SELECT max(item_id) + 1 AS next_no FROM it")
def f29(spark, d):
    return numbering.next_number(t.items(spark, d).select(numbering.padded("ITEM", F.col("item_id"), 4).alias("code")), "code", "ITEM")


@query("j16_surrogate_keys", f"{WITH} SELECT pr_id, line_no, CASE WHEN pr_id IN (SELECT pr_id FROM rq WHERE is_deleted = 0) THEN sha1('pr_id:' || pr_id) ELSE '' END AS parent_key FROM ln")
def j16(spark, d):
    return numbering.surrogate_keys(v.live(t.requests(spark, d)), current_lines(spark, d), "pr_id").select("pr_id", "line_no", "parent_key")


@query("m18_rereview", f"{WITH} SELECT DISTINCT ln.pr_id FROM ln WHERE status <> 'pending' AND pr_id IN (SELECT pr_id FROM lv GROUP BY pr_id, line_no HAVING count(*) > 1)")
def m18(spark, d):
    repaired = v.collapse_report(t.request_line_versions(spark, d), t.LINE_KEYS, "version").select("pr_id")
    return current_lines(spark, d).where("status != 'pending'").join(repaired, "pr_id", "left_semi").select("pr_id").distinct()


M12_SQL = f"""{WITH}, h AS (SELECT document_id, year(min("at")) AS y, CASE WHEN document_id % 2 = 0 THEN 'D' || document_id % 7 ELSE '' END AS own, arg_min(action, event_id) AS first_department FROM cm GROUP BY document_id),
nn AS (SELECT *, 10 + row_number() OVER (PARTITION BY y ORDER BY document_id) AS no FROM h),
hd AS (SELECT document_id, 'PR-' || y || '-' || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END AS doc_no, CASE WHEN own = '' THEN first_department ELSE own END AS department FROM nn),
li AS (SELECT document_id, event_id, row_number() OVER (PARTITION BY document_id ORDER BY event_id) AS line_no, CAST(coalesce(CAST(value AS DECIMAL(18,2)), 0) AS DECIMAL(18,4)) AS qty,
       CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 50 END AS unit_price, CASE WHEN event_id % 3 = 0 THEN 'box' ELSE 'pcs' END AS uom, event_id % 200 AS item_id FROM cm)
SELECT document_id, doc_no, line_no, item_id, CAST(qty AS DOUBLE) AS qty, uom, CAST(unit_price AS DOUBLE) AS unit_price, CAST(qty * CAST(unit_price AS DECIMAL(18,4)) AS DOUBLE) AS estimate, department, 'pending' AS status
FROM li JOIN hd USING (document_id)"""


@query("m12_create_requests", M12_SQL)
def m12(spark, d):
    rows = t.commands(spark, d)
    asked = rows.groupBy(F.col("document_id").alias("submission_id")).agg(F.year(F.min("at")).alias("year"))
    asked = asked.withColumns({"department": F.when(F.col("submission_id") % 2 == 0, F.concat(F.lit("D"), (F.col("submission_id") % 7).cast("string"))).otherwise(""), "requested_by": F.lit("someone"), "notes": F.lit("")})
    decimal = lambda c: c.cast("decimal(18,2)").cast("decimal(18,4)")
    lines = rows.select(
        F.col("document_id").alias("submission_id"), F.col("event_id").alias("position"), (F.col("event_id") % 200).alias("item_id"), decimal(F.col("value")).alias("qty"),
        F.when(F.col("event_id") % 3 == 0, "box").when(F.col("event_id") % 3 == 1, "").alias("uom"), F.when(F.col("event_id") % 5 != 0, decimal(F.col("event_id") % 50)).alias("unit_price"), F.col("action").alias("department"),
    )
    counters = asked.select("year").distinct().withColumn("last_no", F.lit(10))
    made = purchasing.create_requests(asked, lines, counters)[1]
    return _num(made.select(F.col("submission_id").alias("document_id"), "doc_no", F.col("line_no").cast("long"), "item_id", "qty", "uom", "unit_price", "estimate", "department", "status"))


@query("m13_create_orders", f"{WITH}, k AS (SELECT vendor_id, pr_id, line_no, item_id, row_number() OVER (PARTITION BY vendor_id ORDER BY pr_id, line_no) AS po_line FROM ln WHERE status = 'approved' AND is_deleted = 0) SELECT vendor_id, po_line, item_id, first_value(pr_id) OVER (PARTITION BY vendor_id ORDER BY po_line) AS primary_pr FROM k")
def m13(spark, d):
    rows = v.live(current_lines(spark, d)).where("status = 'approved'").withColumn("pos", F.struct("pr_id", "line_no"))
    numbered = numbering.line_numbers(rows.drop("line_no"), "vendor_id", "pos").withColumnRenamed("line_no", "po_line")
    first = numbered.groupBy("vendor_id").agg(F.min_by("pr_id", "po_line").alias("primary_pr"))
    return numbered.join(first, "vendor_id").select("vendor_id", F.col("po_line").cast("long"), "item_id", "primary_pr")


@query("m14_item_requests", f"{WITH}, top AS (SELECT max(item_id) AS m FROM it) SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, CASE WHEN event_id % 2 = 0 THEN m + count(*) FILTER (event_id % 2 = 0) OVER (ORDER BY event_id) END AS item_no FROM cm, top WHERE action = 'click'")
def m14(spark, d):
    asked = t.commands(spark, d).where("action = 'click'").select("event_id", F.when(F.col("event_id") % 2 == 0, "approved").otherwise("rejected").alias("status"))
    made = numbering.dense_numbers(asked.where("status = 'approved'"), ["event_id"], greatest_item(spark, d), "item_no")
    return made.unionByName(asked.where("status = 'rejected'").withColumn("item_no", F.lit(None).cast("long")))


@query("m15_create_vendors", f"{WITH} SELECT vendor_id, 'V-' || CASE WHEN vendor_id < 10000 THEN lpad(CAST(vendor_id AS VARCHAR), 4, '0') ELSE CAST(vendor_id AS VARCHAR) END AS code, 'active' AS status, 'IDR' AS currency FROM ve")
def m15(spark, d):
    return t.vendors(spark, d).select("vendor_id", numbering.padded("V", F.col("vendor_id"), 4).alias("code"), F.lit("active").alias("status"), F.lit("IDR").alias("currency"))


@query("m16_legacy_snapshot", f"{WITH} SELECT pr_id, line_no, CAST(CASE WHEN approved_qty <> 0 THEN approved_qty WHEN requested_qty <> 0 THEN requested_qty ELSE 0 END AS DOUBLE) AS qty, lower(concat_ws(' ', nullif(status, ''), CAST(item_id AS VARCHAR))) AS search_text FROM ln")
def m16(spark, d):
    return _num(current_lines(spark, d).select("pr_id", "line_no", purchasing.wanted().alias("qty"), n.search_text(F.col("status"), F.col("item_id").cast("string")).alias("search_text")))


# --- names -------------------------------------------------------------------------------------------------------

BILINGUAL = "name_en || CASE WHEN item_id % 3 = 0 THEN ' 轴承' WHEN item_id % 3 = 1 THEN '' ELSE ' 水泵 M16*50' END"


def bilingual_name():
    return F.concat("name_en", F.when(F.col("item_id") % 3 == 0, " 轴承").when(F.col("item_id") % 3 == 1, "").otherwise(" 水泵 M16*50"))


def bilingual(spark, d):
    return t.items(spark, d).select("item_id", bilingual_name().alias("name"))


@query("f1_tidy", f"{WITH} SELECT item_id, trim(regexp_replace('  ' || name_en || '  x ', '\\s+', ' ', 'g')) AS name FROM it")
def f1(spark, d):
    return t.items(spark, d).select("item_id", n.tidy(F.concat(F.lit("  "), "name_en", F.lit("  x "))).alias("name"))


@query("f2_squeeze_key", f"{WITH} SELECT item_id, regexp_replace(lower(name_en || ' (x)'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') || '|' || regexp_replace(lower(brand), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS key FROM it")
def f2(spark, d):
    return t.items(spark, d).select("item_id", n.match_key(F.concat("name_en", F.lit(" (x)")), F.col("brand")).alias("key"))


@query("f3_split_bilingual", f"{WITH} SELECT item_id, CASE item_id % 3 WHEN 0 THEN '轴承' WHEN 1 THEN '' ELSE '水泵' END AS cn, name_en AS en FROM it")
def f3(spark, d):
    cn, en = n.split_bilingual(F.col("name"))
    return bilingual(spark, d).select("item_id", cn.alias("cn"), en.alias("en"))


@query("f4_split_keep_spec", f"{WITH} SELECT item_id, CASE item_id % 3 WHEN 0 THEN '轴承' WHEN 1 THEN '' ELSE '水泵' END AS cn, CASE item_id % 3 WHEN 2 THEN name_en || ' M16*50' ELSE name_en END AS en FROM it")
def f4(spark, d):
    cn, en = n.split_keep_spec(F.col("name"))
    return bilingual(spark, d).select("item_id", cn.alias("cn"), en.alias("en"))


@query("f5_split_prefix", f"{WITH} SELECT item_id, '轴承' AS cn, name_en AS en FROM it")
def f5(spark, d):
    cn, en = n.split_prefix(F.concat(F.lit("轴承 "), "name_en"))
    return t.items(spark, d).select("item_id", cn.alias("cn"), en.alias("en"))


@query("f6_probes", f"{WITH} SELECT item_id, CASE item_id % 3 WHEN 0 THEN name_en || ' 轴承|' || name_en || '|轴承' WHEN 1 THEN name_en ELSE name_en || ' 水泵 M16*50|' || name_en || ' M16*50|水泵' END AS probes FROM it")
def f6(spark, d):
    return bilingual(spark, d).select("item_id", F.array_join(n.probes(F.col("name")), "|").alias("probes"))


@query("f7_department", f"{WITH} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN category ELSE '仓库' END AS department FROM it")
def f7(spark, d):
    name = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("仓库 "), "category")).otherwise("仓库")
    return t.items(spark, d).select("item_id", n.department(name).alias("department"))


#: Endings of names, with what is extracted from them, by kind in order; then one without any.
ENDINGS = (
    (" φ26*10mm end", "φ26*10mm end", "diameter"), (" M16*50 8.8级", "M16*50 8.8级", "thread"), (" SCH 40", "SCH 40", "sch_size"), (" DN 100 - brass", "DN 100 brass", "dn_size"),
    (" - 10mm x 20mm", "10mm x 20mm", "dimension"), (' 2" valve', '2" valve', "inch_size"), (" - 30mm - end", "30mm end", "mm_size"), (" VRLA-12/100", "VRLA-12/100", "model"), (" (8.8)", "(8.8)", "grade"), ("", None, None),
)
_ENDINGS_SQL = ", ".join(f"({k}, '{e}', {'NULL' if x is None else repr(x)}, {'NULL' if kind is None else repr(kind)})" for k, (e, x, kind) in enumerate(ENDINGS))


@query("f8_spec_extract", f"{WITH}, e(k, ending, spec, kind) AS (VALUES {_ENDINGS_SQL}) SELECT item_id, CASE WHEN item_id % 12 < 10 THEN name_en WHEN item_id % 12 = 11 THEN name_en || ' 30mm' END AS base, spec, CASE WHEN item_id % 12 = 10 THEN 'manual' ELSE kind END AS kind FROM it LEFT JOIN e ON item_id % 12 = k")
def f8(spark, d):
    """Every kind; a name that is nothing but a specification (10) needs a look, one that has one already (11) stays."""
    k = F.col("item_id") % 12
    name = F.when(k == 10, "30mm").otherwise(F.concat("name_en", F.lit(" 30mm")))
    for i, (ending, _, _) in enumerate(ENDINGS):
        name = F.when(k == i, F.concat("name_en", F.lit(ending))).otherwise(name)
    rows = t.items(spark, d).select("item_id", name.alias("n"), F.when(k == 11, "30mm").alias("has"))
    return rows.select("item_id", n.extract_spec(F.col("n"), F.col("has")).alias("s")).select("item_id", "s.base", "s.spec", "s.kind")


@query("p6_spec_like", f"{WITH} SELECT item_id FROM it WHERE item_id % 2 = 0")
def p6(spark, d):
    text = F.when(F.col("item_id") % 2 == 0, F.concat(F.col("size").cast("string"), F.lit("mm"))).otherwise("plain words")
    return t.items(spark, d).where(text.rlike(n.SPEC_TOKEN)).select("item_id")


UOM_CASE = "CASE item_id % 6 WHEN 0 THEN '个' WHEN 1 THEN 'PCS' WHEN 2 THEN 'unit' WHEN 3 THEN '盒' WHEN 4 THEN 'xyz' ELSE 'kg' END"


def uoms(spark, d):
    k = F.col("item_id") % 6
    return t.items(spark, d).select("item_id", F.when(k == 0, "个").when(k == 1, "PCS").when(k == 2, "unit").when(k == 3, "盒").when(k == 4, "xyz").otherwise("kg").alias("uom"))


def spellings(mapping: dict[str, str]) -> list[str]:
    """All spellings of a map, with spaces around every third and every other one in upper case, and two unknown ones."""
    found = [f" {w} " if k % 3 == 0 else w.upper() if k % 2 else w for k, w in enumerate(mapping)]
    return [*found, *mapping, "xyz", "  "]


def spelt(spark, d, mapping: dict[str, str]) -> DataFrame:
    words = spellings(mapping)
    return t.items(spark, d).select("item_id", F.element_at(F.array(*map(F.lit, words)), (F.col("item_id") % len(words) + 1).cast("int")).alias("uom"))


def spelt_sql(mapping: dict[str, str], fold: bool) -> str:
    words = spellings(mapping)
    text = lambda w: "'" + w + "'"
    pairs = ", ".join(f"({text(k)}, {text(v)})" for k, v in mapping.items())
    return f"""{WITH}, m(k, v) AS (VALUES {pairs}), x AS (SELECT item_id, trim([{", ".join(map(text, words))}][item_id % {len(words)} + 1]) AS u FROM it)
SELECT item_id, coalesce(a.v, {"b.v, " if fold else ""}u) AS uom FROM x LEFT JOIN m a ON u = a.k LEFT JOIN m b ON lower(u) = b.k"""


@query("f10_uom_ingest", spelt_sql(n.UOM_INGEST, True))
def f10(spark, d):
    return spelt(spark, d, n.UOM_INGEST).select("item_id", n.normalise_uom(F.col("uom"), n.UOM_INGEST).alias("uom"))


@query("f11_uom_enrich", spelt_sql(n.UOM_ENRICH, False))
def f11(spark, d):
    return spelt(spark, d, n.UOM_ENRICH).select("item_id", n.normalise_uom(F.col("uom"), n.UOM_ENRICH, fold_case=False).alias("uom"))


@query("f12_uom_canonical", spelt_sql(n.UOM_CANONICAL, False))
def f12(spark, d):
    return spelt(spark, d, n.UOM_CANONICAL).select("item_id", n.normalise_uom(F.col("uom"), n.UOM_CANONICAL, fold_case=False).alias("uom"))


@query("a13_uom_histogram", f"{WITH}, u AS (SELECT {UOM_CASE} AS uom FROM it) SELECT uom, CASE uom WHEN 'PCS' THEN 'pcs' WHEN 'unit' THEN 'pcs' WHEN '盒' THEN 'drum' ELSE uom END AS unit, CASE WHEN uom IN ('个', 'xyz') THEN 'unmapped' WHEN uom = 'kg' THEN 'unchanged' ELSE 'mapped' END AS state, count(*) AS n FROM u GROUP BY ALL")
def a13(spark, d):
    return n.uom_report(uoms(spark, d), "uom", n.UOM_CANONICAL)


#: Example rules over the words of item types; real rule sets are a parameter.
RULES = (("Metal", ("steel", "copper", "brass")), ("Coated", ("plated", "anodized", "burnished")), ("Small", ("small",)))
CLASSIFY_SQL = "CASE WHEN regexp_matches(lower(x), 'steel|copper|brass') THEN 'Metal' WHEN regexp_matches(lower(x), 'plated|anodized|burnished') THEN 'Coated' WHEN regexp_matches(lower(x), 'small') THEN 'Small' ELSE 'Uncategorized' END"


@query("f13_classify", f"{WITH} SELECT item_id, {CLASSIFY_SQL} AS class FROM (SELECT item_id, name_en || ' ' || category AS x FROM it)")
def f13(spark, d):
    return t.items(spark, d).select("item_id", n.classify(F.concat_ws(" ", "name_en", "category"), RULES).alias("class"))


@query("f14_recategorise", f"{WITH} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN category ELSE {CLASSIFY_SQL} END AS class FROM (SELECT item_id, category, name_en || ' ' || category AS x FROM it)")
def f14(spark, d):
    now = F.when(F.col("item_id") % 2 == 0, F.col("category")).otherwise("Uncategorized")
    return t.items(spark, d).select("item_id", F.when(now == "Uncategorized", n.classify(F.concat_ws(" ", "name_en", "category"), RULES)).otherwise(now).alias("class"))


@query("a14_category_counts", f"{WITH} SELECT category, count(*) AS n FROM it GROUP BY category")
def a14(spark, d):
    return t.items(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("f15_reparse", f"{WITH} SELECT item_id, name_en AS en FROM it WHERE item_id % 3 <> 1")
def f15(spark, d):
    cn, en = n.split_bilingual(F.col("name"))
    return bilingual(spark, d).select("item_id", en.alias("en"), (en != F.col("name")).alias("changed"), cn.alias("cn")).where("changed").select("item_id", "en")


@query("f16_garbled", f"{WITH} SELECT item_id, name_en AS name FROM it")
def f16(spark, d):
    return t.items(spark, d).select("item_id", n.without_garbage(F.concat(F.lit(" "), "name_en", F.lit(" （ ） ()"))).alias("name"))


@query("p7_garbled_filter", f"{WITH} SELECT item_id FROM it WHERE item_id % 9 = 0")
def p7(spark, d):
    name = F.when(F.col("item_id") % 9 == 0, F.concat("name_en", F.lit("（）"))).otherwise(F.col("name_en"))
    return t.items(spark, d).where(F.contains(name, F.lit("（）"))).select("item_id")


@query("p9_junk", f"{WITH} SELECT item_id FROM it WHERE item_id % 4 = 0")
def p9(spark, d):
    rows = t.items(spark, d).select("item_id", F.when(F.col("item_id") % 8 == 0, "").when(F.col("item_id") % 4 == 0, "test").otherwise(F.col("name_en")).alias("en"), F.lit("件").alias("cn"))
    return corrections.junk(rows, "en", "cn", ("test",)).select("item_id")


@query("f18_base_name", f"{WITH} SELECT item_id, lower(name_en) AS base FROM it")
def f18(spark, d):
    return t.items(spark, d).select("item_id", n.base_name(F.concat("name_en", F.lit(" "), F.col("size").cast("string"), F.lit(" mm"))).alias("base"))


@query("w7_variants", f"{WITH}, g AS (SELECT lower(name_en) AS base_name, min(item_id) AS base_item_id, count(*) AS n FROM it GROUP BY 1 HAVING count(*) > 1) SELECT item_id, base_name, base_item_id, n FROM it JOIN g ON lower(name_en) = base_name WHERE item_id <> base_item_id")
def w7(spark, d):
    return n.variants(t.items(spark, d).select("item_id", F.concat("name_en", F.lit(" "), F.col("size").cast("string"), F.lit("mm")).alias("name_en")))


@query("a20_group_sizes", f"{WITH} SELECT name_en, min(item_id) AS base_item_id, count(*) AS n FROM it GROUP BY 1 HAVING count(*) >= 2")
def a20(spark, d):
    return t.items(spark, d).groupBy("name_en").agg(F.min("item_id").alias("base_item_id"), F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("j14_salvage_specs", f"{WITH} SELECT item_id, size || 'mm' AS spec FROM it WHERE item_id % 5 = 0")
def j14(spark, d):
    old = t.items(spark, d).select("item_id", F.when(F.col("item_id") % 5 == 0, F.concat(F.col("size").cast("string"), F.lit("mm"))).otherwise(F.col("name_en")).alias("old_name"))
    now = t.items(spark, d).select("item_id", "name_en")
    found = now.join(old, "item_id").where(F.col("old_name").rlike(n.SPEC_TOKEN) & (F.col("old_name") != F.col("name_en")))
    return found.where(F.col("old_name").endswith("mm")).select("item_id", F.col("old_name").alias("spec"))


@query("f19_overrides", f"{WITH} SELECT item_id, CASE WHEN item_id = 5 THEN 'Wire Rope' ELSE name_en END AS name_en, CASE WHEN item_id = 5 THEN '30mm' WHEN item_id % 5 = 0 THEN size || 'mm' END AS spec FROM it")
def f19(spark, d):
    fixed = spark.createDataFrame([(5, "Wire Rope", "30mm")], "item_id long, new_name string, new_spec string")
    found = j14(spark, d)
    rows = t.items(spark, d).select("item_id", "name_en").join(found, "item_id", "left").join(F.broadcast(fixed), "item_id", "left")
    return rows.select("item_id", F.coalesce("new_name", "name_en").alias("name_en"), F.coalesce("new_spec", "spec").alias("spec"))


@query("f20_search_text", f"{WITH} SELECT item_id, lower(concat_ws(' ', nullif(name_en, ''), nullif(brand, ''))) AS search_text FROM it")
def f20(spark, d):
    return t.items(spark, d).select("item_id", n.search_text(F.col("name_en"), F.col("brand"), F.lit("")).alias("search_text"))


@query("f21_placeholders", f"{WITH} SELECT vendor_id, vendor_id % 6 < 4 AS flagged FROM ve")
def f21(spark, d):
    k = F.col("vendor_id") % 6
    name = F.when(k == 0, "PT. Barang").when(k == 1, "barang").when(k == 2, "VENDOR").when(k == 3, "Test").when(k == 4, "Testing").otherwise(F.col("vendor_name"))
    return t.vendors(spark, d).select("vendor_id", n.is_placeholder(name).alias("flagged"))


@query("a19_vendor_names", f"{WITH} SELECT DISTINCT vendor_name AS name FROM ve WHERE vendor_id IN (SELECT vendor_id FROM lv) OR vendor_id IN (SELECT vendor_id FROM ol)")
def a19(spark, d):
    names = t.vendors(spark, d).select("vendor_id", F.concat(F.lit(" "), "vendor_name", F.lit("  ")).alias("raw"))
    used = t.request_line_versions(spark, d).select("vendor_id").union(t.order_lines(spark, d).select("vendor_id")).distinct()
    return names.join(used, "vendor_id").select(n.tidy(F.col("raw")).alias("name")).distinct()


@query("j9_vendor_backfill", f"{WITH} SELECT po_id, ol.vendor_id FROM ol JOIN ve USING (vendor_id) GROUP BY ALL")
def j9(spark, d):
    named = t.order_lines(spark, d).join(t.vendors(spark, d), "vendor_id").select("po_id", F.concat(F.upper("vendor_name"), F.lit(" ")).alias("raw")).distinct()
    index = match.first_per_key(t.vendors(spark, d).select("vendor_id", F.lower(n.tidy(F.col("vendor_name"))).alias("key")), ["key"], ["vendor_id"])
    return named.withColumn("key", F.lower(n.tidy(F.col("raw")))).join(index, "key", "left").select("po_id", "vendor_id")


@query("f22_local_date", "SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%Y-%m-%d') AS day FROM events")
def f22(spark, d):
    return t.commands(spark, d).select("event_id", F.date_format(n.local_date(F.col("at").cast("timestamp")), "yyyy-MM-dd").alias("day"))


@query("f23_local_text", "SELECT event_id, strftime(date_trunc('second', ts + INTERVAL 7 HOUR), '%Y-%m-%d %H:%M:%S') AS text FROM events")
def f23(spark, d):
    return t.commands(spark, d).select("event_id", F.substring(n.local_text(F.col("at").cast("timestamp")), 1, 19).alias("text"))


@query("f24_timestamp_shift", "SELECT event_id, strftime(date_trunc('second', CASE WHEN count(*) OVER (PARTITION BY date_trunc('minute', ts)) >= 3 THEN ts ELSE ts + INTERVAL 7 HOUR END), '%Y-%m-%d %H:%M:%S') AS shifted FROM events")
def f24(spark, d):
    return corrections.shift(t.commands(spark, d), "at", 7, 3).select("event_id", F.date_format("shifted", "yyyy-MM-dd HH:mm:ss").alias("shifted"))


@query("a15_bulk_minutes", "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 3")
def a15(spark, d):
    return corrections.bulk_minutes(t.commands(spark, d), "at", 3).select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "n")


@query("a16_hour_histogram", "SELECT string_agg(h || ':' || c, ' ' ORDER BY h) AS histogram FROM (SELECT hour(ts) AS h, count(*) AS c FROM events GROUP BY 1)")
def a16(spark, d):
    return corrections.hour_histogram(t.commands(spark, d), "at")


@query("f25_date_consistency", "SELECT count(*) FILTER (CAST(ts + INTERVAL 7 HOUR AS DATE) <> CAST(ts AS DATE)) AS n_differ FROM events")
def f25(spark, d):
    return t.commands(spark, d).agg(F.count_if(n.local_date(F.col("at").cast("timestamp")) != F.to_date("at")).alias("n_differ"))


@query("f26_lenient_time", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') ELSE '2000-01-01 00:00:00' END AS at FROM events")
def f26(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).otherwise("yesterday")
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return t.commands(spark, d).select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("f27_legacy_key", f"{WITH} SELECT item_id, CASE item_id % 3 WHEN 2 THEN 'u-' || item_id ELSE CAST(item_id AS VARCHAR) END AS k FROM it")
def f27(spark, d):
    number = F.col("item_id").cast("string")
    raw = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("00"), number)).when(F.col("item_id") % 3 == 1, F.concat(F.lit(" "), number)).otherwise(F.concat(F.lit("u-"), number))
    return t.items(spark, d).select("item_id", n.legacy_key(raw).alias("k"))


@query("f28_number_or", f"{WITH} SELECT item_id, CASE item_id % 3 WHEN 0 THEN CAST(size AS DOUBLE) ELSE 1.0 END AS value FROM it")
def f28(spark, d):
    raw = F.when(F.col("item_id") % 3 == 0, F.col("size").cast("string")).when(F.col("item_id") % 3 == 1, "0").otherwise("n/a")
    return t.items(spark, d).select("item_id", n.number_or(raw, F.lit(1.0)).alias("value"))


@query("f31_uom_label", f"{WITH} SELECT item_id, CASE item_id % 2 WHEN 0 THEN '件 pcs' ELSE 'kg' END AS label FROM it")
def f31(spark, d):
    labels = F.create_map(F.lit("pcs"), F.lit("件"), F.lit("box"), F.lit("箱"))
    unit = F.when(F.col("item_id") % 2 == 0, "pcs").otherwise("kg")
    return t.items(spark, d).select("item_id", F.concat_ws(" ", F.try_element_at(labels, unit), unit).alias("label"))


@query("f32_full_name", f"{WITH} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN name_en ELSE name_en || ' ' || size || 'mm' END AS name FROM it")
def f32(spark, d):
    spec = F.when(F.col("item_id") % 2 == 0, F.col("name_en")).otherwise(F.concat(F.col("size").cast("string"), F.lit("mm")))
    return t.items(spark, d).select("item_id", n.full_name(F.col("name_en"), spec).alias("name"))


@query("f33_blank_cleaning", f"{WITH} SELECT item_id, CASE item_id % 6 WHEN 4 THEN brand WHEN 5 THEN 'none such' ELSE '' END AS brand FROM it")
def f33(spark, d):
    k = F.col("item_id") % 6
    raw = F.when(k == 0, " None ").when(k == 1, "NONE").when(k == 2, "  ").when(k == 4, F.concat(F.lit(" "), "brand", F.lit(" "))).when(k == 5, "none such")
    return t.items(spark, d).select("item_id", n.cleaned(raw).alias("brand"))


# --- matching ----------------------------------------------------------------------------------------------------


@query("j8_prioritised_lookup", f"{WITH}, e AS (SELECT lower(name_en) AS k, lower(name_en) || '|' || brand AS kb, item_id FROM it WHERE item_id % 2 = 0), i AS (SELECT k, min(item_id) AS item_id FROM e GROUP BY k), b AS (SELECT kb, min(item_id) AS item_id FROM e GROUP BY kb) SELECT a.item_id AS asked_id, coalesce(b.item_id, i.item_id) AS item_id FROM it a LEFT JOIN b ON lower(a.name_en) || '|' || a.brand = kb LEFT JOIN i ON lower(a.name_en) = k")
def j8(spark, d):
    """Name and brand are tried first, then the name alone, against an index that has both keys of each item."""
    asked = t.items(spark, d).select(F.col("item_id").alias("asked_id"), F.lower("name_en").alias("k"), "brand")
    index = t.items(spark, d).where("item_id % 2 = 0").select("item_id", F.explode(F.array(F.lower("name_en"), F.concat_ws("|", F.lower("name_en"), "brand"))).alias("name_key"))
    return match.prioritised_lookup(asked, "asked_id", [F.concat_ws("|", "k", "brand"), F.col("k")], index, "name_key", "item_id", ["item_id"])


@query("a21_match_rate", f"{WITH}, i AS (SELECT DISTINCT name_en FROM it WHERE item_id % 40 = 0) SELECT category, count(*) AS n_items, count(*) FILTER (name_en IN (SELECT name_en FROM i)) AS n_matched FROM it GROUP BY category")
def a21(spark, d):
    known = t.items(spark, d).where("item_id % 40 = 0").select("name_en").distinct().withColumn("hit", F.lit(1))
    return t.items(spark, d).join(known, "name_en", "left").groupBy("category").agg(F.count(F.lit(1)).alias("n_items"), F.count("hit").alias("n_matched"))


@query("j10_not_yet_known", f"{WITH} SELECT item_id FROM it WHERE name_en NOT IN (SELECT name_en FROM it WHERE item_id % 40 = 0) AND brand NOT IN (SELECT brand FROM it WHERE item_id % 400 = 0)")
def j10(spark, d):
    rows = t.items(spark, d)
    return rows.join(rows.where("item_id % 40 = 0").select("name_en").distinct(), "name_en", "left_anti").join(rows.where("item_id % 400 = 0").select("brand").distinct(), "brand", "left_anti").select("item_id")


def fuzzy_names(spark, d):
    """Distinct item names with a typing error in every third: the variant and the true one of each."""
    names = t.items(spark, d).groupBy(n.squeeze(F.concat_ws(" ", "name_en", "brand")).alias("key")).agg(F.min("item_id").alias("id"))
    typed = F.when(F.col("id") % 3 == 0, F.concat(F.substring("key", 1, 4), F.lit("q"), F.col("key").substr(F.lit(5), F.lit(1000)))).otherwise(F.col("key"))
    return names.select("id", typed.alias("key")), names


@query("j11_fuzzy_join")
def j11(spark, d):
    typed, names = fuzzy_names(spark, d)
    return match.best_match(typed, names)


@query("f30_similar_pairs")
def f30(spark, d):
    typed, names = fuzzy_names(spark, d)
    return match.similar_pairs(typed, names).select("id", "match_id", "ratio")


@query("w8_greedy_new")
def w8(spark, d):
    """Typed names against a master of every second true name: new is what neither the master nor an earlier new one has."""
    typed, names = fuzzy_names(spark, d)

    def cut(df: DataFrame) -> DataFrame:
        path = files.work_folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return match.new_items(typed, names.where("id % 2 = 1"), cut)


#: Fields of the item search and their weights.
SEARCHED = {"name_en": 3, "name_cn": 3, "spec": 2, "item_id": 1}


def searched(spark, d) -> DataFrame:
    """All items with the fields that are searched; the Chinese name is the bilingual one, as the data has no other."""
    return t.items(spark, d).select("item_id", "name_en", F.concat(F.col("size").cast("string"), F.lit("mm")).alias("spec"), bilingual_name().alias("name_cn"))


def _grams(text: str) -> str:
    return f"CASE WHEN length({text}) > 1 THEN list_distinct([substr({text}, i, 2) for i in range(1, length({text}))]) ELSE [] END"


FIELDS_SQL = f"f AS (SELECT item_id, {_grams('lower(name_en)')} AS g1, {_grams('lower(name_cn)')} AS g2, {_grams('spec')} AS g3, {_grams('CAST(item_id AS VARCHAR)')} AS g4 FROM (SELECT item_id, name_en, {BILINGUAL} AS name_cn, size || 'mm' AS spec FROM it))"
SCORE_SQL = "1 - CAST(3 * len(list_intersect(g, g1)) + 3 * len(list_intersect(g, g2)) + 2 * len(list_intersect(g, g3)) + len(list_intersect(g, g4)) AS DOUBLE) / (len(g) * 9)"
J12_SQL = f"""{WITH}, {FIELDS_SQL}, q AS (SELECT item_id AS query_id, {_grams('lower(name_en)')} AS g FROM it WHERE item_id % 50 = 0),
s AS (SELECT query_id, item_id, {SCORE_SQL} AS score FROM q CROSS JOIN f), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS place FROM s WHERE score <= 0.4)
SELECT query_id, item_id, score, place FROM r WHERE place <= 5"""
PROBES_SQL = "CASE item_id % 3 WHEN 0 THEN [name_en || ' 轴承', name_en, '轴承'] WHEN 1 THEN [name_en] ELSE [name_en || ' 水泵 M16*50', name_en || ' M16*50', '水泵'] END"
J13_SQL = f"""{WITH}, {FIELDS_SQL}, p AS (SELECT item_id AS query_id, unnest({PROBES_SQL}) AS text FROM it WHERE item_id % 50 = 0), q AS (SELECT query_id, text, {_grams('lower(text)')} AS g FROM p),
s AS (SELECT query_id, text, item_id, {SCORE_SQL} AS score FROM q CROSS JOIN f), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY score, item_id) AS k FROM s WHERE score <= 0.4),
b AS (SELECT query_id, item_id, min(score) AS score FROM r WHERE k <= 4 GROUP BY ALL) SELECT query_id, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS place FROM b) WHERE place <= 4"""


@query("j12_search_top_k", J12_SQL)
def j12(spark, d):
    asked = t.items(spark, d).where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("name_en").alias("text"))
    return match.search_top_k(asked, searched(spark, d), SEARCHED, 5, 0.4)


@query("j13_multi_probe", J13_SQL)
def j13(spark, d):
    asked = bilingual(spark, d).where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.posexplode(n.probes(F.col("name"))).alias("probe", "text"))
    spread = asked.select(F.struct("query_id", "probe").alias("query_id"), "text")
    found = match.search_top_k(spread, searched(spark, d), SEARCHED, 4, 0.4)
    best = found.groupBy(F.col("query_id.query_id").alias("query_id"), "item_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "item_id"))
    return best.withColumn("place", rank).where("place <= 4").drop("place")


@query("o6_stacked_reports", f"{WITH} SELECT 'items' AS table_name, count(*) AS n FROM it UNION ALL SELECT 'vendors', count(*) FROM ve")
def o6(spark, d):
    return reconcile.stacked([f(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, f in (("items", t.items), ("vendors", t.vendors))])


# --- files, cells, streams ---------------------------------------------------------------------------------------


@query("s2_ndjson", f"{WITH} SELECT item_id, name_en, size FROM it")
def s2(spark, d):
    rows, path = t.items(spark, d).select("item_id", "name_en", "size"), files.work_folder(spark)
    files.write_ndjson(rows, path)
    return files.read_ndjson(spark, path, rows.schema)


@query("s3_csv", f"{WITH} SELECT CAST(item_id AS VARCHAR) AS item_id, name_en, category FROM it")
def s3(spark, d):
    path = files.work_folder(spark)
    files.write_csv(t.items(spark, d), path, ["item_id", "name_en", "category"])
    return files.read_csv(spark, path, ["item_id", "name_en", "category"]).drop("_corrupt_record")


@query("s5_audit_log", f"{WITH} SELECT 'part' AS source_file, count(*) AS items_parsed, CAST(3 AS BIGINT) AS matched, CAST(2 AS BIGINT) AS new_added, 'a b' AS new_item_ids, CAST(9 AS BIGINT) AS total_after FROM it")
def s5(spark, d):
    path = files.work_folder(spark)
    files.append_log(spark, path, "part", t.items(spark, d).count(), 3, ["a", "b"], 9)
    return spark.read.parquet(path).drop("timestamp")


@query("s6_replace", f"{WITH} SELECT vendor_id, vendor_name FROM ve")
def s6(spark, d):
    path = files.work_folder(spark)
    files.replace_table(t.items(spark, d), path)
    files.replace_table(t.vendors(spark, d).select("vendor_id", "vendor_name"), path)
    return spark.read.parquet(path)


@query("s13_conform", f"{WITH} SELECT vendor_id, vendor_name, CAST(NULL AS VARCHAR) AS phone FROM ve")
def s13(spark, d):
    target = spark.createDataFrame([], "vendor_id long, vendor_name string, phone string").schema
    return files.conform(t.vendors(spark, d), target)[0]


def item_cells(spark, d) -> DataFrame:
    """Items laid out as cells: a sheet for each brand, a title row, a header row, the items below and a total."""
    rows = t.items(spark, d).select(F.col("brand").alias("sheet"), F.col("item_id").alias("row"), F.array(F.col("name_en"), F.col("size").cast("string"), F.lit("")).alias("v"))
    head = rows.groupBy("sheet").agg(F.lit(1).alias("n")).select("sheet", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("row"), F.array(F.lit("Stock"), F.lit(None), F.lit(None)).alias("v")), F.struct(F.lit(-1).cast("long").alias("row"), F.array(F.lit("Item Name"), F.lit("Spec (mm)"), F.lit("Dept")).alias("v")), F.struct(F.lit(10**9).cast("long").alias("row"), F.array(F.lit("Total"), F.lit("1"), F.lit("")).alias("v")))).alias("h")).select("sheet", "h.row", "h.v")
    return rows.union(head).select(F.lit("book").alias("file"), "sheet", "row", F.posexplode("v").alias("col", "value")).where("value IS NOT NULL")


@query("s7_cells_to_records", f"{WITH} SELECT brand AS sheet, item_id AS row, name_en AS name, CAST(size AS VARCHAR) AS spec, brand AS department FROM it WHERE name_en <> ''")
def s7(spark, d):
    found = cell.records(item_cells(spark, d), {"name": ("item name",), "spec": ("spec",), "department": ("dept",)}, ("item name",))
    return found.select("sheet", "row", "name", "spec", "department")


@query("s8_layout", f"{WITH} SELECT brand AS sheet, CASE CAST(substr(brand, 7) AS INT) % 3 WHEN 0 THEN 'vessel' WHEN 1 THEN 'stock' ELSE 'generic' END AS layout FROM it GROUP BY brand")
def s8(spark, d):
    """Titles say what a sheet is: every third one is a vessel's list (which mentions stock, too), every third one stock."""
    k = F.regexp_extract("sheet", "([0-9]+)$", 1).cast("int") % 3
    title = F.when(k == 0, "Stock of the Vessel").when(k == 1, "STOCK").otherwise("Parts")
    rows = item_cells(spark, d).withColumn("value", F.when(F.col("value") == "Stock", title).otherwise(F.col("value")))
    return cell.layouts(rows, (("vessel", "vessel"), ("stock", "stock"))).select("sheet", "layout")


@query("s10_enrichment", f"{WITH}, l AS (SELECT lower(name_en) AS k, max(item_id) AS last_id FROM it GROUP BY 1) SELECT item_id, CAST(last_id AS VARCHAR) AS name_cn FROM it JOIN l ON lower(name_en) = k")
def s10(spark, d):
    rows = t.items(spark, d)
    last = rows.groupBy(F.lower("name_en").alias("k")).agg(F.max_by(F.col("item_id").cast("string"), "item_id").alias("cn"))
    return rows.join(last, F.lower("name_en") == F.col("k"), "left").select("item_id", F.coalesce("cn", F.lit("")).alias("name_cn"))


@query("m17_template_import", f"{WITH}, e AS (SELECT item_id, name_en, CASE WHEN item_id % 4 = 0 THEN 'set' ELSE '' END AS uom, lower(name_en) AS k, lower(name_en) || '|' || brand AS kb FROM it WHERE item_id % 2 = 0 AND is_deleted = 0), i AS (SELECT k, min(item_id) AS m FROM e GROUP BY k), b AS (SELECT kb, min(item_id) AS m FROM e GROUP BY kb), x AS (SELECT category, item_id AS pos, lower(name_en) || CASE WHEN item_id % 5 = 0 THEN ' zz' ELSE '' END AS name, brand, CASE WHEN item_id % 3 = 0 THEN 'box' ELSE '' END AS uom FROM it), y AS (SELECT x.*, coalesce(b.m, i.m) AS m FROM x LEFT JOIN b ON name || '|' || brand = kb LEFT JOIN i ON name = k) SELECT y.category AS template, m AS item_id, coalesce(e.name_en, name) AS name, coalesce(nullif(e.uom, ''), y.uom) AS uom, row_number() OVER (PARTITION BY y.category ORDER BY pos) - 1 AS sort_order FROM y LEFT JOIN e ON m = e.item_id")
def m17(spark, d):
    """Sheets are categories; their lines name live items, by name and brand or by name alone, or nothing known."""
    items = t.items(spark, d)
    rows = items.select(F.col("category").alias("template"), F.col("item_id").alias("position"), F.concat(F.lower("name_en"), F.when(F.col("item_id") % 5 == 0, " zz").otherwise("")).alias("name"), "brand", F.when(F.col("item_id") % 3 == 0, "box").otherwise("").alias("uom"))
    known = v.live(items).where("item_id % 2 = 0").select("item_id", F.col("name_en").alias("item_name"), F.when(F.col("item_id") % 4 == 0, "set").otherwise("").alias("item_uom"), F.explode(F.array(F.lower("name_en"), F.concat_ws("|", F.lower("name_en"), "brand"))).alias("name_key"))
    return purchasing.import_templates(rows, known, [F.concat_ws("|", "name", "brand"), F.col("name")], "name_key")


def _arrive(rows: DataFrame, path: str, batches: int, *by: str) -> int:
    """Writes the rows as ``batches`` arrivals, dealt by the columns ``by``, without a shuffle and with all tasks; returns
    how many files an arrival has, at most."""
    for k in range(batches):
        rows.where(F.pmod(F.xxhash64(*by), F.lit(batches)) == k).write.mode("append").parquet(path)
    return -(-len(files.folders(rows.sparkSession, path, "part-*")) // batches)


def _streamed(spark, d, name: str) -> tuple[DataFrame, str]:
    """The table as a stream over files, and a folder for what the stream leaves."""
    base = files.work_folder(spark)
    table = t.scan(spark, d, name)
    table.repartition(4).write.parquet(f"{base}/in")
    return streams.source(spark, f"{base}/in", table.schema, 1), base


@query("t1_sync_stream", f"{WITH} SELECT {LINE_SQL} FROM ln")
def t1(spark, d):
    """Versions of request lines stream into two versioned tables, of which one fails once after a write of its own."""
    base, rows = files.work_folder(spark), t.request_line_versions(spark, d)
    per_batch = _arrive(rows, f"{base}/in", 4, *t.LINE_KEYS, "version")
    sinks, failed = [f"{base}/out", f"{base}/copy"], []

    def fails_once(target: str, batch: str) -> None:
        if target == sinks[1] and batch.endswith("-1") and not failed:
            failed.append(batch)
            raise RuntimeError("the sink is gone after its write")

    for _ in range(2):  # the second run takes up the batch that failed
        try:
            streams.sync_stream({"lines": streams.source(spark, f"{base}/in", rows.schema, per_batch)}, "version", {"lines": sinks}, f"{base}/state", written=fails_once)
        except StreamingQueryException:
            continue
    given = rows.withColumn("sync_version", sync.version_of(F.col("version")))
    first, copy = (streams.read_batches(spark, s, given.schema) for s in sinks)
    # what is stored twice or in one sink only is left as a row by the comparison
    counted = reconcile.copies([first, copy, given], t.LINE_KEYS)
    stored = counted.where("n_0 > 0").select(*given.columns)
    current = sync.apply_changes(first.limit(0), stored, t.LINE_KEYS, t.LINE_ORDER)
    odd = counted.withColumn("_odd", F.abs(F.col("n_0") - F.col("n_1")) + F.greatest(F.col("n_0") - F.col("n_2"), F.lit(0))).where("_odd > 0").withColumn("_odd", F.explode(F.sequence(F.lit(1).cast("long"), "_odd")))
    return _num(current.select(*LINE).unionByName(odd.select(*LINE)))


@query("t2_append_once_stream", "SELECT event_id FROM events")
def t2(spark, d):
    """All rows come a second time, when the stream has long passed them; none is kept twice."""
    rows, base = _streamed(spark, d, "events")
    timed = rows.selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS at")
    for run in range(2):
        streams.append_once_stream(timed, "event_id", "at", f"{base}/out", f"{base}/state-{run}")
    return spark.read.parquet(f"{base}/out").select("event_id")


@query("t3_order_status_stream", ORDER_STATUS_SQL)
def t3(spark, d):
    """Commands are dealt over the triggers without regard to document or time, as long as the watermark's delay bears it.
    All stay open that long, so groups are as many as hold 20,000 each."""
    base = files.work_folder(spark)
    commands = order_commands(spark, d).withColumn("at", F.col("at").cast("timestamp"))
    per_batch = _arrive(commands, f"{base}/in", 3, "seq")
    groups = max(64, -(-commands.count() // 20_000))
    streams.order_status_stream(streams.source(spark, f"{base}/in", commands.schema, per_batch), f"{base}/out", f"{base}/state", "3650 days", groups)
    return streams.current_status(spark, f"{base}/out")


# --- the remaining scans, sinks, sorts and guards ------------------------------------------------------------------


@query("s1_source_scan", "SELECT o_orderkey AS pr_id, o_orderstatus AS status FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 4000")
def s1(spark, d):
    """A key range of a source table, as a partitioned relational scan reads it: the predicate is on the stored column."""
    return t.scan(spark, d, "orders").where("o_orderkey >= 100 AND o_orderkey < 4000").select(F.col("o_orderkey").alias("pr_id"), F.col("o_orderstatus").alias("status"))


@query("s4_csv_sink", f"{WITH} SELECT CAST(vendor_id AS VARCHAR) AS vendor_id, vendor_name FROM ve")
def s4(spark, d):
    path = files.work_folder(spark)
    files.write_csv(t.vendors(spark, d), path, ["vendor_id", "vendor_name"])
    return spark.read.option("header", True).schema("vendor_id string, vendor_name string").csv(path)


@query("s9_many_files", f"{WITH} SELECT category AS file, count(*) AS n_good, count(*) FILTER (item_id % 50 = 0) AS n_bad FROM it GROUP BY category")
def s9(spark, d):
    """Files of one folder read together: broken lines are reported by file and the rest is used."""
    path = files.work_folder(spark)
    line = F.to_json(F.struct("item_id", "name_en"))
    rows = t.items(spark, d).select("category", F.explode(F.when(F.col("item_id") % 50 == 0, F.array(line, F.lit("{broken"))).otherwise(F.array(line))).alias("value"))
    rows.write.partitionBy("category").text(path)
    read = spark.read.schema("item_id long, name_en string, _corrupt_record string, category string").option("mode", "PERMISSIVE").json(path)
    return read.groupBy(F.col("category").alias("file")).agg(F.count_if(F.col("item_id").isNotNull()).alias("n_good"), F.count_if(F.col("item_id").isNull() & F.col("_corrupt_record").isNotNull()).alias("n_bad"))


@query("s11_batched_write", f"{WITH} SELECT count(*) AS n_rows, CAST(ceil(count(*) / 500.0) AS BIGINT) <= count(*) AS batched FROM it")
def s11(spark, d):
    """Rows written in files of 500 at most, as a sink with a limit on a statement's rows takes them."""
    path = files.work_folder(spark)
    t.items(spark, d).write.option("maxRecordsPerFile", 500).parquet(path)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 500).alias("batched"))


@query("o2_multi_key_sort", f"{WITH} SELECT pr_id, line_no, item_id FROM ln ORDER BY line_no, pr_id")
def o2(spark, d):
    return current_lines(spark, d).select("pr_id", "line_no", "item_id").orderBy("line_no", "pr_id")


@query("o3_newest_first", f"{WITH} SELECT pr_id, strftime(pr_date, '%Y-%m-%d') AS day FROM rq ORDER BY pr_date DESC, pr_id DESC")
def o3(spark, d):
    return t.requests(spark, d).orderBy(F.desc("pr_date"), F.desc("pr_id")).select("pr_id", F.date_format("pr_date", "yyyy-MM-dd").alias("day"))


@query("f9_manual_review", f"{WITH} SELECT item_id, item_id % 10 = 0 AS manual FROM it")
def f9(spark, d):
    """Listed rows are set aside, the others go on; the list is itself a table."""
    rows = t.items(spark, d).select("item_id")
    listed = rows.where("item_id % 10 = 0").withColumn("manual", F.lit(True))
    return rows.join(listed, "item_id", "left").select("item_id", F.coalesce("manual", F.lit(False)).alias("manual"))


@query("f17_blank_counts", f"{WITH} SELECT column_name, count(*) FILTER (item_id % k = 0) AS n_blank, count(*) FILTER (item_id % k = 0) AS n_null_after FROM it CROSS JOIN (VALUES ('brand', 3), ('category', 4)) x(column_name, k) GROUP BY column_name")
def f17(spark, d):
    """Empty texts of a list of columns become null; how many there were, and how many nulls there are then."""
    rows = t.items(spark, d).select(F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("brand")).alias("brand"), F.when(F.col("item_id") % 4 == 0, "").otherwise(F.col("category")).alias("category"))
    nulled, counts = files.blank_to_null(rows, ["brand", "category"])
    after = nulled.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in nulled.columns))
    tall = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias(name)) for c in df.columns))).alias("e")).select("e.*")
    return tall(counts, "n_blank").join(tall(after, "n_null_after"), "column_name")


@query("c11_dry_run", f"{WITH} SELECT 'duplicate_name' AS report, count(*) AS n FROM (SELECT name_en FROM it GROUP BY name_en HAVING count(*) > 1) UNION ALL SELECT 'dead_item_lines', count(*) FROM lv WHERE item_id NOT IN (SELECT item_id FROM it WHERE is_deleted = 0)")
def c11(spark, d):
    """All reports of a job, and no write."""
    items = t.items(spark, d)
    reports = {"duplicate_name": validate.duplicates(items, ["name_en"], "item_id"), "dead_item_lines": validate.orphans(t.request_line_versions(spark, d), "item_id", v.live(items), "item_id")}
    return reconcile.stacked([r.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("report"), "n") for name, r in reports.items()])


@query("c12_optional_table", f"{WITH} SELECT po_id, CASE WHEN po_id % 3 = 0 THEN 1 ELSE 0 END AS n_charges, CAST(0 AS BIGINT) AS n_refunds FROM ol GROUP BY po_id")
def c12(spark, d):
    """Of two optional sources one is there; the other counts as an empty table of its type."""
    base, orders = files.work_folder(spark), t.order_lines(spark, d).select("po_id").distinct()
    orders.where("po_id % 3 = 0").write.parquet(f"{base}/charges")
    for name in ("charges", "refunds"):
        found = files.read_or_empty(spark, f"{base}/{name}", orders.schema).groupBy("po_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        orders = orders.join(found, "po_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)).cast("long"))
    return orders


@query("c15_apply_once", f"{WITH} SELECT count(*) AS n_rows FROM it")
def c15(spark, d):
    """A job that is applied already does nothing: two jobs, each applied twice, are there once."""
    path, items = f"{files.work_folder(spark)}/table", t.items(spark, d)
    for _ in range(2):
        files.apply_once(items.where("item_id % 2 = 0"), path, "even")
        files.apply_once(items.where("item_id % 2 <> 0"), path, "odd")
    return files.read_applied(spark, path, items.schema).agg(F.count(F.lit(1)).alias("n_rows"))
