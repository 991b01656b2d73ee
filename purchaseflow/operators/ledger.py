"""Quantities and amounts of several documents set against each other: order, receipt and invoice; budget and actual."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchaseflow.sources.files import stored

from .prefix import neighbours, parts_for, running_sums, spread


def allocate(sides: dict[str, DataFrame], keys: Sequence[str], doc: str, order: Sequence[str], quantity: str) -> DataFrame:
    """First in, first out: which part of which document of one side stands against which of the others.

    Each side's quantities, in ``order``, are laid end to end on one axis a key, so a document is an interval. Where an
    interval of any side ends, a piece ends; a piece belongs, on each side, to the document whose interval is the first to end
    there or later. So one pass in order of these ends finds all pieces, without a join of ranges. Returns (keys, begin,
    quantity, a column for each side): the side's document, null where it has none left. Quantities that are null or not over 0 take
    nothing and are left out.
    """
    laid = []
    for name, rows in sides.items():
        side = rows.where(F.col(quantity) > 0).select(*keys, F.lit(name).alias("_side"), F.col(doc).alias("_doc"), *(F.col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.col(quantity).alias("_q"))
        laid.append(side)
    given = stored(reduce(DataFrame.unionByName, laid))
    parts = parts_for(given)
    placed = running_sums(given, [*keys, "_side"], [*(f"_o{k}" for k in range(len(order))), "_doc", "_q"], {"_end": "_q"}, parts)
    ends = spread(placed, parts, *keys, "_end").groupBy(*keys, "_end").agg(*(F.max(F.when(F.col("_side") == name, F.col("_doc"))).alias(name) for name in sides))
    pieces = neighbours(ends.withColumn("_at", F.col("_end")), keys, "_end", ahead=list(sides), behind=["_at"], parts=parts)
    begin = F.coalesce("last__at", F.lit(0)).cast(pieces.schema["_end"].dataType)
    return pieces.select(*keys, begin.alias("begin"), (F.col("_end") - begin).alias(quantity), *(F.col(f"next_{name}").alias(name) for name in sides))


def three_way_match(orders: DataFrame, receipts: DataFrame, invoices: DataFrame, keys: Sequence[str], doc: str, order: Sequence[str], quantity: str) -> DataFrame:
    """Pieces of orders, receipts and invoices with what is open on each: ordered and not received, received and not
    invoiced, invoiced and not received, and what came or was billed beyond the order."""
    pieces = allocate({"order_doc": orders, "receipt_doc": receipts, "invoice_doc": invoices}, keys, doc, order, quantity)
    has = {n: F.col(f"{n}_doc").isNotNull() for n in ("order", "receipt", "invoice")}
    rest = lambda when: F.when(when, F.col(quantity)).otherwise(F.lit(0)).cast(pieces.schema[quantity].dataType)
    state = F.when(~has["order"], "beyond order").when(has["receipt"] & has["invoice"], "matched").when(has["receipt"], "to be invoiced").when(has["invoice"], "to be received").otherwise("open")
    return pieces.withColumns({
        "unreceived": rest(has["order"] & ~has["receipt"]), "uninvoiced": rest(has["receipt"] & ~has["invoice"]),
        "unordered": rest(~has["order"]), "state": state,
    })


KINDS = ("budget", "actual", "committed")


def budget_report(movements: DataFrame, department: str, account: str, period: str, kind: str, amount: str) -> DataFrame:
    """Budget, actual and committed amounts and what is left, at every level: by department, account and period, by each pair
    of department with one of them, by department and in all. ``level`` is the bitmask of what is summed over.

    At the finest level ``left_to_date`` runs over the periods of a department and account. The movements are summed once,
    by their finest groups; levels and running totals are made from these.
    """
    each = movements.groupBy(department, account, period).agg(*(_sum_of(kind, k, amount).alias(k) for k in KINDS))
    left = F.col("budget") - F.col("actual") - F.col("committed")
    run = running_sums(each.withColumn("_left", left), [department, account], [period], {"left_to_date": "_left"}).drop("_left")
    sets = [[department, account, period], [department, account], [department, period], [department], []]
    cols = [F.col(c) for c in (department, account, period)]
    levels = run.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().cast("int").alias("level"), *(F.sum(k).alias(k) for k in KINDS), F.max("left_to_date").alias("left_to_date"))
    finest = F.col("level") == 0
    return levels.select("level", department, account, period, *KINDS, left.alias("left_over"), F.when(finest, F.col("left_to_date")).alias("left_to_date"))


def _sum_of(kind: str, wanted: str, amount: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(kind) == wanted, F.col(amount))), F.lit(0))
