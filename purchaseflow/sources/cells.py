"""Records from spreadsheet cells (file, sheet, row, col, value): the header row is found by its words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def headers(cells: DataFrame, keywords: tuple[str, ...], within: int = 10) -> DataFrame:
    """(file, sheet, header_row): the first of the leading rows with a cell that holds a keyword."""
    low = F.lower("value")
    hit = F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k)
    return cells.where((F.col("row") < within) & hit).groupBy("file", "sheet").agg(F.min("row").alias("header_row"))


def records(cells: DataFrame, fields: dict[str, tuple[str, ...]], keywords: tuple[str, ...], skip: tuple[str, ...] = ("total", "note")) -> DataFrame:
    """(file, sheet, row, one column for each field): each field is the first column whose header holds one of its words.

    Blank rows and rows whose first field begins with a word of ``skip`` are left out; the sheet's name stands in for an
    empty department.
    """
    head = cells.join(headers(cells, keywords), ["file", "sheet"])
    names = head.where(F.col("row") == F.col("header_row"))
    field = F.lit(None).cast("string")
    for name, words in reversed(fields.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.lower("value").contains(w)
        field = F.when(hit, name).otherwise(field)
    columns = names.select("file", "sheet", "col", field.alias("field")).where("field IS NOT NULL").groupBy("file", "sheet", "field").agg(F.min("col").alias("col"))
    rows = head.where(F.col("row") > F.col("header_row")).join(columns, ["file", "sheet", "col"])
    out = rows.groupBy("file", "sheet", "row").pivot("field", list(fields)).agg(F.first("value"))
    first = F.lower(F.trim(F.coalesce(F.col(next(iter(fields))), F.lit(""))))
    out = out.where((first != "") & ~first.rlike("^(" + "|".join(skip) + ")"))
    return out.withColumn("department", F.coalesce(F.nullif(F.trim("department"), F.lit("")), F.col("sheet"))) if "department" in fields else out


def layouts(cells: DataFrame, signs: tuple[tuple[str, str], ...], default: str = "generic") -> DataFrame:
    """(file, sheet, layout): the first layout of ``signs`` (word, layout) whose word is in any cell of the sheet."""
    found = F.lit(default)
    for word, layout in reversed(signs):
        found = F.when(F.bool_or(F.contains(F.lower("value"), F.lit(word))), layout).otherwise(found)
    return cells.groupBy("file", "sheet").agg(found.alias("layout"))
