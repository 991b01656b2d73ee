"""A snapshot of the older system as rows of the warehouse: one table each, with fallbacks, defaults, search texts and keys.

A field counts as not given where it is null, empty or 0. Parents' numbers become their derived keys
(``numbering.surrogate_keys``); a parent that isn't in the snapshot gives an empty key, and no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchaseflow.functions.naming import search_text
from purchaseflow.operators.documents import or_else

MONEY = "decimal(18,2)"
QUANTITY = "decimal(18,4)"


def number(*columns: str, kind: str = QUANTITY) -> Column:
    """The first of the columns that is neither null nor 0, else 0."""
    nothing = F.lit(0).cast(kind)
    return F.coalesce(*(F.nullif(F.col(c).cast(kind), nothing) for c in columns), nothing)


def text(column: str, default: str = "") -> Column:
    return or_else(F.col(column), default)


def derived(key: str) -> Column:
    """The derived key of a row, as ``numbering.surrogate_keys`` gives it to its children."""
    return F.sha1(F.concat(F.lit(f"{key}:"), F.col(key).cast("string")))


def _of(children: DataFrame, parents: DataFrame, key: str | list[str], made: str) -> DataFrame:
    """Children with the key of their parent as ``made``; empty where there is none."""
    keys = [key] if isinstance(key, str) else key
    known = parents.select(*keys).dropDuplicates().withColumn(made, F.sha1(F.concat_ws(":", F.lit(keys[-1]), *(F.col(k).cast("string") for k in keys))))
    return children.join(known, keys, "left").withColumn(made, F.coalesce(made, F.lit("")))


def vendors(old: DataFrame) -> DataFrame:
    """vendor_id, name, category, city, tax_no."""
    return old.select(
        "vendor_id", F.col("vendor_id").alias("vendor_code"), text("name").alias("vendor_name"), text("category").alias("category"), text("city").alias("city"), text("tax_no").alias("tax_no"),
        F.lit("active").alias("status"), F.lit("ID").alias("country"), F.lit("IDR").alias("currency"), search_text(F.col("name"), F.col("vendor_id").cast("string"), F.col("city"), F.col("tax_no")).alias("search_text"),
    )


def items(old: DataFrame) -> DataFrame:
    """item_id, base_item_id, name_en, name_cn, category, spec, uom."""
    return old.select(
        "item_id", F.coalesce(F.col("base_item_id").cast("string"), F.lit("")).alias("base_item_id"), text("name_en").alias("name_en"), text("name_cn").alias("name_cn"), text("category").alias("category"), text("spec").alias("spec"),
        text("uom", "pcs").alias("uom"), F.lit("expense").alias("item_type"), F.lit("active").alias("status"), search_text(F.col("name_en"), F.col("name_cn"), F.col("spec"), F.col("item_id").cast("string")).alias("search_text"),
    )


def requests(old: DataFrame, today: str) -> DataFrame:
    """pr_id, pr_number, requested_by, department, requested_on (a date), status, notes."""
    return old.select(
        derived("pr_id").alias("request_key"), "pr_id", text("pr_number").alias("doc_no"), text("requested_by").alias("requested_by"), F.coalesce("requested_on", F.lit(today).cast("date")).alias("pr_date"),
        F.lit("normal").alias("priority"), text("status", "pending").alias("status"), F.lit(0).cast(MONEY).alias("total_estimate"), text("notes").alias("notes"),
        search_text(F.col("pr_number"), F.col("requested_by"), F.col("department")).alias("search_text"),
    )


def request_lines(old: DataFrame, old_requests: DataFrame) -> DataFrame:
    """pr_id, line_no, item_id, qty_requested, qty, qty_approved, est_unit_price, estimated_unit_price, uom, department, status."""
    qty, price = number("qty_requested", "qty"), number("est_unit_price", "estimated_unit_price")
    return _of(old, old_requests, "pr_id", "request_key").select(
        "request_key", "pr_id", "line_no", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), qty.alias("requested_qty"), number("qty_approved").alias("approved_qty"), text("uom", "pcs").alias("uom"),
        price.alias("estimated_unit_price"), (qty * price).cast("decimal(28,6)").alias("estimated_total"), text("department").alias("department"), text("status", "pending").alias("status"),
    )


def actions(old: DataFrame, old_requests: DataFrame, now: str) -> DataFrame:
    """approval_id, pr_id, approved_by, action, at (a time as text), notes. A time that can't be read is ``now``."""
    at = F.coalesce(F.try_to_timestamp("at"), F.lit(now).cast("timestamp"))
    return _of(old, old_requests, "pr_id", "request_key").select(
        "approval_id", F.lit("purchase_request").alias("document_type"), "request_key", F.lit(1).alias("step_no"), text("approved_by").alias("actor"), text("action", "approve").alias("action"),
        at.alias("action_at"), text("action").alias("to_status"), text("notes").alias("notes"),
    )


def orders(old: DataFrame, old_requests: DataFrame, today: str) -> DataFrame:
    """po_id, po_number, pr_id, vendor_id, vendor_name, created_on (a date), status, total_amount."""
    total = number("total_amount", kind=MONEY)
    return _of(old, old_requests, "pr_id", "primary_request").select(
        derived("po_id").alias("order_key"), "po_id", text("po_number").alias("doc_no"), "primary_request", F.coalesce(F.col("vendor_id").cast("string"), F.lit("")).alias("vendor_id"), text("vendor_name").alias("vendor_name"),
        F.coalesce("created_on", F.lit(today).cast("date")).alias("po_date"), text("status", "draft").alias("status"), total.alias("subtotal"), total.alias("total"), search_text(F.col("po_number"), F.col("vendor_name")).alias("search_text"),
    )


def order_lines(old: DataFrame, old_orders: DataFrame, old_request_lines: DataFrame) -> DataFrame:
    """po_id, pr_id, line_no, item_id, qty, unit_price, total_price, uom, vendor_name."""
    qty, price = number("qty"), number("unit_price")
    rows = _of(_of(old, old_orders, "po_id", "order_key"), old_request_lines, ["pr_id", "line_no"], "request_line_key")
    whole = F.coalesce(F.nullif(F.col("total_price").cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)")), (qty * price).cast("decimal(28,6)"))
    return rows.select(
        "order_key", "po_id", "request_line_key", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), qty.alias("ordered_qty"), text("uom", "pcs").alias("uom"), price.alias("unit_price"),
        whole.alias("total_price"), text("vendor_name").alias("vendor_name"), F.lit("open").alias("status"),
    )


def exports(old: DataFrame, old_orders: DataFrame, today: str) -> DataFrame:
    """log_id, po_id, exported_on (a date), filename."""
    return _of(old, old_orders, "po_id", "order_key").select("log_id", F.lit("purchase_order").alias("document_type"), "order_key", F.coalesce("exported_on", F.lit(today).cast("date")).alias("exported_on"), text("filename").alias("filename"), F.lit("generated").alias("status"))
