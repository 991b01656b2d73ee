"""Documents made and decided: orders from request lines, decisions with their action rows, item requests, new items.

Each takes a batch of submissions and returns tables: what is made, what changed, and what was refused and why.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchaseflow.functions.naming import search_text
from purchaseflow.operators import numbering
from purchaseflow.operators.prefix import neighbours, places
from purchaseflow.operators.purchasing import CHARGE_ACCOUNTS, WITHHOLDING, roll_up, with_totals, zero

DESCRIPTION = 500
DECISIONS = ("approved", "rejected")


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def or_else(c: Column, value: str = "") -> Column:
    """The text, or ``value`` where it is null or empty."""
    return F.when(blank(c), F.lit(value)).otherwise(c)


def charge_rows(charges: DataFrame) -> DataFrame:
    """Charges (submission_id, position, kind, amount, description) with ``account`` and their description cut at 500
    characters; ``error`` says why one can't be taken. A submission may have any number of them."""
    accounts = F.create_map(*(F.lit(x) for pair in CHARGE_ACCOUNTS.items() for x in pair))
    account = F.try_element_at(accounts, or_else(F.col("kind")))
    error = F.when(account.isNull(), F.concat(F.lit("unknown charge: "), or_else(F.col("kind")))).when(F.coalesce(F.col("amount") < 0, F.lit(True)), "a charge needs an amount of 0 or more")
    return charges.withColumns({"account": account, "description": F.substring(or_else(F.col("description")), 1, DESCRIPTION), "error": error})


class NewOrders:
    """The tables that ``create_orders`` returns, each made only when it is asked for."""

    def __init__(self, submissions: DataFrame, lines: DataFrame, charges: DataFrame, request_lines: DataFrame, counters: DataFrame) -> None:
        self._counters = counters
        known = request_lines.where("is_deleted = 0").select("pr_id", "line_no", "item_id", "uom", F.col("status").alias("_status"))
        asked = lines.withColumnRenamed("line_no", "request_line").join(known.withColumnRenamed("line_no", "request_line"), ["pr_id", "request_line"], "left")
        which = F.concat_ws("/", F.col("pr_id").cast("string"), F.col("request_line").cast("string"))
        lacks = F.col("pr_id").isNull() | F.col("request_line").isNull() | F.col("unit_price").isNull() | F.col("qty").isNull()
        bad = F.when(lacks, "a line needs request line, price and quantity").when(F.col("_status").isNull(), F.concat(F.lit("not found: "), which)).when(F.col("_status") != "approved", F.concat(F.lit("not approved: "), which))
        self._asked = asked.withColumn("error", bad)
        first = F.when(F.col("error").isNotNull(), F.col("position"))
        # the amount of a refused submission may be beyond any type: it is null then and not used
        amount = F.try_sum(F.try_multiply(F.col("unit_price"), F.col("qty"))).alias("_sub")
        of_lines = self._asked.groupBy("submission_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min_by("pr_id", "position").alias("primary_pr"), F.min_by("error", first).alias("_line_error"), amount)
        self._costs = charge_rows(charges)
        of_charges = self._costs.groupBy("submission_id").agg(F.sum("amount").cast("decimal(18,2)").alias("charges"), F.min_by("error", first).alias("_charge_error"))

        head = submissions.join(of_lines, "submission_id", "left").join(of_charges, "submission_id", "left").withColumn("charges", F.coalesce("charges", F.lit(0).cast("decimal(18,2)")))
        own = F.when(blank(F.col("vendor_name")) | F.col("n_lines").isNull(), "vendor and lines are required").when(~blank(F.col("withholding")) & ~F.col("withholding").isin(*WITHHOLDING), F.concat(F.lit("unknown withholding: "), F.col("withholding")))
        self._head = head.withColumn("reason", F.coalesce(own, F.col("_charge_error"), F.col("_line_error"))).drop("_line_error", "_charge_error")

    @property
    def refused(self) -> DataFrame:
        return self._head.where("reason IS NOT NULL").select("submission_id", "reason")

    @cached_property
    def _taken(self) -> DataFrame:
        taken = numbering.document_numbers(self._head.where("reason IS NULL").drop("reason"), self._counters, "year", ["submission_id"], "PO")
        return taken.withColumn("include_vat", F.coalesce("include_vat", F.lit(False)))

    @property
    def headers(self) -> DataFrame:
        given = self._taken.withColumns({"sub": F.col("_sub").cast("decimal(28,6)"), "_given": F.col("discount_pct"), "discount_pct": F.coalesce("discount_pct", F.lit(0))}).drop("_sub")
        totals = with_totals(given).drop("discount_pct", "net").withColumnRenamed("_given", "discount_pct")
        return totals.withColumns({"status": F.lit("pending_approval"), "currency": F.lit("IDR"), "search_text": search_text(F.col("doc_no"), F.col("vendor_name"))})

    @cached_property
    def lines(self) -> DataFrame:
        made = places(self._asked.drop("error", "_status").join(self._taken.select("submission_id", "doc_no"), "submission_id"), ["submission_id"], ["position"], "po_line")
        return made.withColumns({"total_price": (F.col("qty") * F.col("unit_price")).cast("decimal(28,6)"), "purpose": or_else(F.col("purpose")), "received_qty": zero(), "invoiced_qty": zero(), "status": F.lit("open")})

    @cached_property
    def charges(self) -> DataFrame:
        # an order has all of its submission's charges, so they can be numbered after the refused ones are out
        return places(self._costs.drop("error").join(self._taken.select("submission_id", "doc_no"), "submission_id"), ["submission_id"], ["position"], "line_no")


def create_orders(submissions: DataFrame, lines: DataFrame, charges: DataFrame, request_lines: DataFrame, counters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(headers, lines, charges, refused) of new orders; who needs some of them only asks ``NewOrders`` for these.

    ``submissions``: submission_id, year, vendor_name, discount_pct, withholding (a kind or none), include_vat; ``lines``:
    submission_id, position, pr_id, line_no, qty, unit_price, purpose; ``charges`` as in ``charge_rows``; ``request_lines``:
    pr_id, line_no, item_id, uom, status, is_deleted, one row a line; ``counters``: year, last_no.

    A submission is refused whole, with its first error: of its header, then of its first bad charge, then of its first bad
    line in order of position (what it lacks, a request line that isn't there or is deleted, one that isn't approved). The
    others are numbered on from their year's counter. Lines are numbered by position and take item and unit from the request line;
    the primary request is that of the first line. Positions don't repeat within a submission, which may have any number of lines.
    """
    made = NewOrders(submissions, lines, charges, request_lines, counters)
    return made.headers, made.lines, made.charges, made.refused


def _from_status(valid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each decision's ``from_status``: what the decision before it on the same row made, else the stored status."""
    return neighbours(valid, keys, "seq", behind=["decision"]).withColumn("from_status", F.coalesce("last_decision", "status")).drop("last_decision")


class LineDecisions:
    """The tables that ``decide_lines`` returns, each made only when it is asked for."""

    def __init__(self, requests: DataFrame, lines: DataFrame, items: DataFrame, decisions: DataFrame) -> None:
        self._items = items
        self._live = lines.where("is_deleted = 0").select("pr_id", "line_no", "item_id", "requested_qty", "status")
        known = requests.where("is_deleted = 0").select("pr_id", F.lit(True).alias("_request"))
        rows = decisions.join(known, "pr_id", "left").join(self._live.withColumn("_line", F.lit(True)), ["pr_id", "line_no"], "left")
        qty = F.when(F.col("decision") == "approved", F.coalesce("given_qty", "requested_qty")).otherwise(zero()).cast("decimal(18,4)")
        wrong = (
            F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision").when(F.col("_request").isNull(), "request not found").when(F.col("_line").isNull(), "line not found")
            .when((F.col("decision") == "approved") & F.coalesce(qty <= 0, F.lit(True)), "quantity must be over 0")
        )
        self._rows = rows.withColumns({"approved_qty": qty, "reason": wrong}).drop("_request", "_line")
        self._valid = self._rows.where("reason IS NULL").drop("reason")

    @property
    def changed(self) -> DataFrame:
        return self._valid.groupBy("pr_id", "line_no").agg(F.max_by("decision", "seq").alias("status"), F.max_by("approved_qty", "seq").alias("approved_qty"))

    @cached_property
    def actions(self) -> DataFrame:
        names = self._items.groupBy("item_id").agg(F.max("name_en").alias("_name"))
        note = F.concat(F.lit("Item: "), F.coalesce(F.nullif("_name", F.lit("")), F.col("item_id").cast("string"), F.lit("")), F.when(blank(F.col("notes")), "").otherwise(F.concat(F.lit(" — "), F.col("notes"))))
        valid = _from_status(self._valid, ["pr_id", "line_no"])
        return valid.join(names, "item_id", "left").select("seq", F.lit("PR").alias("document_type"), "pr_id", "line_no", "actor", F.col("decision").alias("action"), "from_status", F.col("decision").alias("to_status"), "approved_qty", note.alias("notes"))

    @property
    def requests(self) -> DataFrame:
        last = self.changed.select("pr_id", "line_no", "status")
        now = self._live.select("pr_id", "line_no", F.coalesce("status", F.lit("")).alias("_was")).join(last, ["pr_id", "line_no"], "left")
        touched = last.select("pr_id").distinct()
        settled = roll_up(now.join(touched, "pr_id", "left_semi").select("pr_id", F.coalesce("status", "_was").alias("status")))
        return settled.where("new_status IS NOT NULL").withColumnRenamed("new_status", "status")

    @property
    def refused(self) -> DataFrame:
        return self._rows.where("reason IS NOT NULL").select("seq", "pr_id", "line_no", "reason")


def decide_lines(requests: DataFrame, lines: DataFrame, items: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(changed lines, action rows, changed requests, refused) of decisions on lines; who needs some of them only asks
    ``LineDecisions`` for these.

    ``decisions``: seq (unique), pr_id, line_no, decision, given_qty, actor, notes. An approved line gets the given or else the
    requested quantity, which must be over 0; a rejected one gets 0. Decisions need a known verb, a live request and a
    live line, in this order. Every valid one leaves an action row with the status before it; of several on one line the
    last one counts. Once no live line of a touched request is pending its status follows its lines (``roll_up``).
    """
    made = LineDecisions(requests, lines, items, decisions)
    return made.changed, made.actions, made.requests, made.refused


def decide_requests(requests: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changed requests, action rows, refused) of decisions on whole requests, which don't touch lines.

    ``decisions``: seq (unique), pr_id, decision, actor, notes. One needs an actor, a known verb and a live request.
    """
    known = requests.where("is_deleted = 0").select("pr_id", F.coalesce("status", F.lit("")).alias("status"))
    rows = decisions.join(known, "pr_id", "left")
    wrong = F.when(blank(F.col("actor")) | blank(F.col("decision")), "actor and decision are required").when(~F.col("decision").isin(*DECISIONS), "unknown decision").when(F.col("status").isNull(), "request not found")
    rows = rows.withColumn("reason", wrong)
    valid = _from_status(rows.where("reason IS NULL"), ["pr_id"])
    actions = valid.select("seq", F.lit("PR").alias("document_type"), "pr_id", "actor", F.col("decision").alias("action"), "from_status", F.col("decision").alias("to_status"), or_else(F.col("notes")).alias("notes"))
    changed = valid.groupBy("pr_id").agg(F.max_by("decision", "seq").alias("status"))
    return changed, actions, rows.where("reason IS NOT NULL").select("seq", "pr_id", "reason")


def create_items(submissions: DataFrame, order: Sequence[str], last_no: int | Column) -> tuple[DataFrame, DataFrame]:
    """(items, refused) from submissions (name_en, name_cn, category, spec, uom, department, item_type and their own key).

    Items need an English name and are numbered on from ``last_no`` in ``order``, which doesn't repeat. Without unit they are
    pieces, without a type an expense.
    """
    nameless = blank(F.col("name_en"))
    made = numbering.dense_numbers(submissions.where(~nameless), order, last_no, "item_no")
    texts = {c: or_else(F.col(c)) for c in ("name_cn", "category", "spec", "department")}
    made = made.withColumns(texts | {"uom": or_else(F.col("uom"), "pcs"), "item_type": or_else(F.col("item_type"), "expense"), "status": F.lit("active"), "item_code": numbering.padded("ITEM", F.col("item_no"), 4)})
    made = made.withColumn("search_text", F.lower(F.concat_ws(" ", "name_en", "name_cn", "category")))
    return made, submissions.where(nameless).select(*order, F.lit("name_en required").alias("reason"))


def create_vendors(submissions: DataFrame, number: Column) -> DataFrame:
    """Vendors (vendor_name and what else they have) with code, search text and the defaults of a new vendor."""
    made = submissions.withColumns({"code": numbering.padded("V", number, 4), "status": F.lit("active"), "currency": F.lit("IDR"), "country": F.lit("ID")})
    return made.withColumn("search_text", search_text(F.col("vendor_name"), F.col("code")))


def decide_item_requests(asked: DataFrame, decisions: DataFrame, last_no: int | Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new items, changed item requests, refused) of decisions on requests for items.

    ``asked``: request_id and the fields of an item, with is_deleted; ``decisions``: seq, request_id, decision, notes. The last
    decision on a request counts. An approved one becomes an item with the next number; a rejected one keeps the note only.
    """
    last = decisions.groupBy("request_id").agg(F.max_by("decision", "seq").alias("decision"), F.max_by(or_else(F.col("notes")), "seq").alias("admin_notes"))
    rows = last.join(asked.where("is_deleted = 0").withColumn("_there", F.lit(True)), "request_id", "left")
    wrong = F.when(F.col("_there").isNull(), "item request not found").when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision")
    rows = rows.withColumn("reason", wrong)
    valid = rows.where("reason IS NULL")
    fields = valid.where("decision = 'approved'").select("request_id", "name_en", "name_cn", "category", "spec", "uom", F.lit("").alias("department"), F.lit("expense").alias("item_type"))
    items, nameless = create_items(fields, ["request_id"], last_no)
    changed = valid.select("request_id", F.col("decision").alias("status"), "admin_notes").join(items.select("request_id", F.col("item_code").alias("approved_item")), "request_id", "left")
    changed = changed.join(nameless.select("request_id"), "request_id", "left_anti")
    return items, changed, rows.where("reason IS NOT NULL").select("request_id", "reason").unionByName(nameless)
