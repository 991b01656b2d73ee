"""Requests, orders and decisions: the reporting and calculation layer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purchaseflow.operators import match, numbering
from purchaseflow.operators.prefix import places

# Rates of withholding by kind of tax, value added tax, and accounts of charges.
WITHHOLDING = {"pph23": "0.02", "pph15": "0.012", "pph22_solar": "0.003", "pph22_impor": "0.025"}
VAT = "0.11"
CHARGE_ACCOUNTS = {"freight": "5100", "packing": "5110", "insurance": "5120", "handling": "5130", "other": "5190"}


def zero() -> Column:
    return F.lit(0).cast("decimal(18,4)")


def ordered_quantity(order_lines: DataFrame) -> DataFrame:
    """(pr_id, line_no, ordered_qty) over live order lines, whatever their order's state."""
    return order_lines.where("is_deleted = 0").groupBy("pr_id", "line_no").agg(F.sum("ordered_qty").cast("decimal(18,4)").alias("ordered_qty"))


def with_ordered(lines: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Lines with their ordered quantity, 0 if none; summed before the join, so lines don't multiply."""
    return lines.join(ordered_quantity(order_lines), ["pr_id", "line_no"], "left").withColumn("ordered_qty", F.coalesce("ordered_qty", zero()))


def request_list(requests: DataFrame, lines: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Live requests with counts of their live lines and the list rule's fulfilment; requests without lines stay."""
    approved = F.col("l_status") == "approved"
    side = with_ordered(lines.where("is_deleted = 0"), order_lines).select("pr_id", F.col("status").alias("l_status"), "approved_qty", "ordered_qty")
    counts = side.groupBy("pr_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.count(F.when(approved, 1)).alias("approved_count"),
        F.count(F.when(approved & (F.col("ordered_qty") >= F.col("approved_qty")), 1)).alias("fulfilled_count"),
    )
    out = requests.where("is_deleted = 0").join(counts, "pr_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("item_count", "approved_count", "fulfilled_count")})
    return out.withColumn("fulfilment", list_fulfilment()).withColumn("approval", F.concat(F.col("approved_count").cast("string"), F.lit("/"), F.col("item_count").cast("string"), F.lit(" approved")))


def list_fulfilment() -> Column:
    """Only approved requests have one: by the number of approved lines that are fully ordered."""
    done, asked = F.col("fulfilled_count"), F.col("approved_count")
    return F.when(F.col("status") == "approved", F.when(asked == 0, "unfulfilled").when(done >= asked, "fulfilled").when(done > 0, "partial").otherwise("unfulfilled"))


def wanted() -> Column:
    """Approved quantity, else requested quantity, else 0; a stored 0 counts as not given."""
    return F.coalesce(F.nullif(F.col("approved_qty"), zero()), F.nullif(F.col("requested_qty"), zero()), zero())


def line_fulfilment() -> Column:
    return F.when(F.col("ordered_qty") == 0, "unfulfilled").when(F.col("ordered_qty") >= wanted(), "fulfilled").otherwise("partial")


def open_lines(requests: DataFrame, lines: DataFrame, items: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Approved live lines of live requests, with live items, that aren't fully ordered."""
    rows = lines.where("is_deleted = 0 AND status = 'approved'")
    rows = rows.join(items.where("is_deleted = 0").select("item_id", "name_en"), "item_id").join(requests.where("is_deleted = 0").select("pr_id", "pr_date"), "pr_id")
    return with_ordered(rows, order_lines).where(F.col("ordered_qty") < wanted())


def order_totals(order_lines: DataFrame, terms: DataFrame) -> DataFrame:
    """Totals of each order. ``terms``: po_id, discount_pct, charges, withholding (a kind or none), include_vat (null: no).
    Value added tax is on net and charges, and only where the order includes it. Decimals, half up."""
    sub = order_lines.where("is_deleted = 0").groupBy("po_id").agg(F.sum(F.col("unit_price") * F.col("ordered_qty")).cast("decimal(28,6)").alias("sub"))
    return with_totals(sub.join(terms, "po_id"))


def with_totals(rows: DataFrame) -> DataFrame:
    """The totals of ``order_totals`` for rows with the terms of an order and ``sub``, the sum of its lines, which is replaced."""
    money = lambda c: F.round(c, 2).cast("decimal(18,2)")
    rate = F.lit("0").cast("decimal(5,4)")
    for kind, r in WITHHOLDING.items():
        rate = F.when(F.col("withholding") == kind, F.lit(r).cast("decimal(5,4)")).otherwise(rate)
    rows = rows.withColumn("pct", F.least(F.greatest(F.col("discount_pct").cast("decimal(5,2)"), F.lit(0).cast("decimal(5,2)")), F.lit(100).cast("decimal(5,2)")))
    rows = rows.withColumn("subtotal", money(F.col("sub"))).withColumn("discount", money(F.col("subtotal") * F.col("pct") / 100))
    rows = rows.withColumn("net", (F.col("subtotal") - F.col("discount")).cast("decimal(18,2)"))
    vat = money((F.col("net") + F.col("charges")) * F.lit(VAT).cast("decimal(5,4)"))
    rows = rows.withColumn("vat", F.when(F.col("include_vat"), vat).otherwise(F.lit(0).cast("decimal(18,2)"))).withColumn("withheld", money(F.col("net") * rate))
    return rows.withColumn("total", (F.col("net") + F.col("charges") + F.col("vat") - F.col("withheld")).cast("decimal(18,2)")).drop("sub", "pct")


def roll_up(lines: DataFrame) -> DataFrame:
    """(pr_id, new_status): once nothing is pending, rejected if all lines are, else approved; null if still pending."""
    return lines.groupBy("pr_id").agg(F.when(F.bool_or(F.col("status").isin("", "pending")), None).when(F.bool_and(F.col("status") == "rejected"), "rejected").otherwise("approved").alias("new_status"))


def decide(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Lines after decisions (pr_id, line_no, decision, given_qty): approved takes the given or the requested quantity,
    which must be over 0; rejected takes 0. ``rejected_because`` says why a decision doesn't count."""
    rows = lines.join(decisions, ["pr_id", "line_no"])
    qty = F.when(F.col("decision") == "approved", F.coalesce("given_qty", "requested_qty")).otherwise(zero())
    bad = F.when((F.col("decision") == "approved") & (qty <= 0), "quantity must be over 0")
    return rows.withColumns({"new_qty": qty, "rejected_because": bad, "from_status": F.col("status"), "to_status": F.when(bad.isNull(), F.col("decision")).otherwise(F.col("status"))})


#: (state, action) → state of an order; a rejection needs a note. Anything else is refused.
MOVES = {("pending_approval", "approve"): "approved", ("pending_approval", "reject"): "rejected", ("rejected", "resubmit"): "pending_approval"}


def next_state(state: str, action: str, note: str | None) -> str | None:
    """The state after a command; null if it is refused."""
    then = MOVES.get((state, action))
    return None if action == "reject" and not note else then


def fold_status(commands: DataFrame) -> DataFrame:
    """The state of each document after its commands (document_id, at, seq, action, note) in order, and how many were refused.

    Commands are sorted by Spark and stream past: a document with a third of all commands takes no memory.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state, refused, seen = None, "", 0, 0
        for b in it:
            for document, action, note in zip(*(c.to_pylist() for c in b.columns)):
                if seen == 0 or document != now:
                    if seen:
                        out.append((now, state, refused, seen))
                    now, state, refused, seen = document, "pending_approval", 0, 0
                then = next_state(state, action, note)
                state, refused, seen = then or state, refused + (then is None), seen + 1
            if len(out) > 10_000:
                yield _states(out)
                out = []
        if seen:
            out.append((now, state, refused, seen))
        yield _states(out)

    sorted_ = commands.repartition("document_id").sortWithinPartitions("document_id", "at", "seq").select("document_id", "action", "note")
    return sorted_.mapInArrow(run, f"document_id {commands.schema['document_id'].dataType.simpleString()}, state string, refused long, seen long")


def _states(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["document_id", "state", "refused", "seen"])


def create_requests(submissions: DataFrame, lines: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of new requests. ``submissions``: submission_id, year, requested_by, department, notes; ``lines``:
    submission_id, position, item_id, qty, uom, unit_price, department; ``counters``: year, last_no.

    A request is numbered on from its year's counter. Without a department of its own it takes its first line's. Lines
    are numbered by position; without unit they are pieces, without quantity or price these are 0; all is pending.
    """
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    first = lines.groupBy("submission_id").agg(F.min_by("department", "position").alias("first_department"))
    headers = submissions.join(first, "submission_id", "left").withColumn("department", F.coalesce(blank("department"), blank("first_department"), F.lit(""))).drop("first_department")
    headers = numbering.document_numbers(headers, counters, "year", ["submission_id"], "PR")
    headers = headers.withColumns({"status": F.lit("pending"), "search_text": F.lower(F.concat_ws(" ", "doc_no", "requested_by"))})
    qty, price = F.coalesce("qty", zero()), F.coalesce("unit_price", zero())
    made = numbering.line_numbers(lines.withColumnRenamed("department", "line_department"), "submission_id", "position").join(headers.select("submission_id", "doc_no", "department"), "submission_id")
    made = made.withColumns({
        "qty": qty, "uom": F.coalesce(blank("uom"), F.lit("pcs")), "unit_price": price, "estimate": (qty * price).cast("decimal(28,6)"),
        "department": F.coalesce(blank("department"), blank("line_department"), F.lit("")), "status": F.lit("pending"),
    })
    return headers, made.drop("line_department")


def request_detail(requests: DataFrame, lines: DataFrame, items: DataFrame, order_lines: DataFrame, actions: DataFrame) -> DataFrame:
    """The live requests as rows (pr_id, part, position, text, amount): a header with the estimate of its live lines, the
    lines with status and fulfilment, and the history of its actions (document_type, document_id, at, seq, action) in order, of
    type PR only, as orders have ids of their own. Rows, as a request's history has no bound."""
    live = requests.where("is_deleted = 0").select("pr_id", F.col("status").alias("header"))
    rows = lines.where("is_deleted = 0").join(items.where("is_deleted = 0").select("item_id"), "item_id").join(live, "pr_id", "left_semi")
    rows = with_ordered(rows, order_lines).withColumn("amount", (F.col("price") * F.col("requested_qty")).cast("decimal(28,6)"))
    estimate = rows.groupBy("pr_id").agg(F.sum("amount").cast("decimal(28,6)").alias("amount"))
    nothing = F.lit(0).cast("decimal(28,6)")
    head = live.join(estimate, "pr_id", "left").select("pr_id", F.lit("header").alias("part"), F.lit(0).cast("long").alias("position"), F.col("header").alias("text"), F.coalesce("amount", nothing).alias("amount"))
    body = rows.select("pr_id", F.lit("line"), F.col("line_no").cast("long"), F.concat_ws(" ", "status", line_fulfilment()), "amount")
    own = actions.where("document_type = 'PR'").withColumnRenamed("document_id", "pr_id").join(live, "pr_id", "left_semi")
    past = places(own.select("pr_id", "at", "seq", "action"), ["pr_id"], ["at", "seq"], "_place").select("pr_id", F.lit("action"), F.col("_place").cast("long"), "action", nothing)
    return head.union(body).union(past)


def order_detail(order_lines: DataFrame, terms: DataFrame, vendors: DataFrame, stored: DataFrame) -> DataFrame:
    """Each order with its vendor, number of live lines, charges and totals computed anew from the lines; ``matches`` says
    whether the stored total (po_id, stored_total) is that."""
    live = order_lines.where("is_deleted = 0")
    head = live.groupBy("po_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min("vendor_id").alias("vendor_id"))
    totals = order_totals(order_lines, terms).select("po_id", "subtotal", "charges", "vat", "withheld", "total")
    out = head.join(vendors.select("vendor_id", "vendor_name"), "vendor_id", "left").join(totals, "po_id").join(stored, "po_id", "left")
    return out.withColumn("matches", F.col("stored_total").eqNullSafe(F.col("total")))


def import_templates(rows: DataFrame, index: DataFrame, keys: Sequence[Column], index_key: str) -> DataFrame:
    """Template lines (template, position, name, uom) with item_id, name and uom; the matched item's values win where it
    has them. ``keys`` are tried in order against ``index`` (item_id, item_name, item_uom and its key). ``sort_order``
    counts from 0 within a template, in order of position, whether a line is matched or not; a template may have any number
    of lines."""
    found = match.prioritised_lookup(rows.withColumn("line_id", F.struct("template", "position")), "line_id", keys, index, index_key, "item_id", ["item_id"])
    out = rows.withColumn("line_id", F.struct("template", "position")).join(found, "line_id", "left").join(index.select("item_id", "item_name", "item_uom").dropDuplicates(["item_id"]), "item_id", "left")
    lines = out.select("template", "position", F.col("item_id"), F.coalesce(F.nullif("item_name", F.lit("")), "name").alias("name"), F.coalesce(F.nullif("item_uom", F.lit("")), "uom").alias("uom"))
    return places(lines, ["template"], ["position"], "_place").select("template", "item_id", "name", "uom", (F.col("_place") - 1).cast("long").alias("sort_order"))


def price_on(asked: DataFrame, prices: DataFrame) -> DataFrame:
    """``asked`` (item_id, vendor_id, day and what else it has) with ``price``: that of the newest entry of ``prices``
    (item_id, vendor_id, valid_from, price; one for each day) not after the day; null if there is none.

    Both are sorted together by day within item and vendor, so it is one pass and no join of ranges.
    """
    names = asked.columns
    entries = prices.select("item_id", "vendor_id", F.col("valid_from").alias("_at"), F.lit(0).alias("_asked"), "price", F.lit(None).cast(asked.select(F.struct(*names)).schema[0].dataType).alias("_row"))
    wishes = asked.select("item_id", "vendor_id", F.col("day").alias("_at"), F.lit(1).alias("_asked"), F.lit(None).cast(prices.schema["price"].dataType).alias("price"), F.struct(*names).alias("_row"))
    newest = Window.partitionBy("item_id", "vendor_id").orderBy("_at", "_asked")
    return entries.union(wishes).withColumn("price", F.last("price", ignorenulls=True).over(newest)).where("_asked = 1").select("_row.*", "price")
