"""The checks that run before anything is written, and typed conversion that collects its errors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

#: What texts of a kind look like, and the names and bounds of whole numbers.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: What a stored text must look like to become a value of a kind; the cast itself decides too.
SHAPES = {"long": r"^[+-]?\d{1,19}$", "decimal(18,2)": r"^[+-]?\d+(\.\d+)?$", "date": r"^\d{4}-\d{2}-\d{2}$", "uuid": UUID}


STAMP, NUMBER, WHOLE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,9})?$", r"^-?\d+(\.\d+)?$", r"^-?\d+$"
WHOLE_NAMES = {"smallint": "smallint", "int": "integer", "bigint": "bigint"}


def _value(text: Column, field: StructField) -> tuple[Column, Column]:
    """(value, error) of a text that is there, for the target's field; nothing is trimmed."""
    kind, bad = field.dataType.simpleString(), lambda what: F.concat(F.lit(f"{what} "), text)
    as_kind = text.try_cast(field.dataType)
    if field.metadata.get("kind") == "uuid":
        return F.lower(text), F.when(~text.rlike(UUID), bad("invalid uuid"))
    if kind == "string":
        return text, F.when(F.contains(text, F.lit("\0")), F.lit("contains NUL byte"))
    if kind in WHOLE_NAMES:
        name = WHOLE_NAMES[kind]
        return as_kind, F.when(~text.rlike(WHOLE), bad(f"invalid {name}")).when(as_kind.isNull(), bad(f"{name} out of range"))
    if isinstance(field.dataType, DecimalType):
        return as_kind, F.when(~text.rlike(NUMBER), bad("invalid numeric")).when(as_kind.isNull(), bad("numeric out of range"))
    shape = {"date": SHAPES["date"], "timestamp": STAMP}.get(kind)
    if shape is None:
        raise TypeError(f"texts can't be converted to {kind}")
    return as_kind, F.when(~text.rlike(shape) | as_kind.isNull(), bad(f"invalid {kind}"))


def convert_to(rows: DataFrame, target: StructType, counts: Observation | None = None) -> DataFrame:
    """Text columns as the target's fields have them, and ``errors``, an array of (column_name, value, error), in one pass.

    The field's type decides: whole numbers by shape and range, decimals by shape and what their precision holds, dates and
    time stamps by shape and calendar, texts without NUL bytes; metadata ``kind`` uuid means a uuid, ``empty`` null
    that the empty text is null. A null in a field that may not be null is an error; a value with an error is null.
    Columns that the target doesn't name are kept. ``counts`` gets the number of rows, of rows with errors, and of
    errors of each column while the result is computed, without another scan.
    """
    made, said = {}, []
    for field in target:
        text = F.col(field.name).cast("string")
        if field.metadata.get("empty") == "null":
            text = F.nullif(text, F.lit(""))
        value, error = _value(text, field)
        if not field.nullable:
            error = F.when(text.isNull(), F.lit("NULL for NOT NULL column")).otherwise(error)
        made[field.name] = F.when(error.isNull(), value)
        said.append(F.struct(F.lit(field.name).alias("column_name"), F.col(field.name).cast("string").alias("value"), error.alias("error")))
    out = rows.withColumns(made | {"errors": F.filter(F.array(*said), lambda e: e["error"].isNotNull())})
    if counts is None:
        return out
    of = [F.count_if(F.array_contains(F.transform("errors", lambda e: e["column_name"]), c)).alias(c) for c in target.names]
    return out.observe(counts, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("errors") > 0).alias("n_bad"), *of)


def convert(column: str, kind: str) -> tuple[Column, Column]:
    """(value, error): the error is null for a good or empty text, else says what the text is not."""
    text = F.trim(column)
    good = text.rlike(SHAPES[kind])
    value = F.lower(text) if kind == "uuid" else text.try_cast(kind)
    value = F.when(good, value)
    return value, F.when(F.col(column).isNotNull() & (text != "") & value.isNull(), F.concat(F.lit(f"not {kind}: "), text))


def convert_all(rows: DataFrame, key: str, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows converted, errors as (key, column_name, value, error))."""
    made = {c: convert(c, k) for c, k in kinds.items()}
    found = F.filter(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), e.alias("error")) for c, (_, e) in made.items())), lambda s: s["error"].isNotNull())
    errors = rows.select(key, F.explode(found).alias("e")).select(key, "e.column_name", "e.value", "e.error")
    return rows.withColumns({c: v for c, (v, _) in made.items()}), errors


def empty_to_null(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def strip_nul(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows without trailing NUL padding, one row with the number changed of each column)."""
    bare = {c: F.regexp_replace(c, r"\x00+$", "") for c in columns}
    return rows.withColumns(bare), rows.agg(*(F.count(F.when(F.col(c) != b, 1)).alias(c) for c, b in bare.items()))


def bad_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""))


def orphans(children: DataFrame, column: str, parents: DataFrame, parent_key: str, empty_is_none: bool = True, ignore_case: bool = False) -> DataFrame:
    """Child rows whose parent isn't there. Null, and where asked the empty text, mean "no parent"."""
    as_key = lambda c: F.lower(F.col(c).cast("string")) if ignore_case else F.col(c)
    asked = children.where(F.col(column).isNotNull())
    if empty_is_none:
        asked = asked.where(F.col(column).cast("string") != "")
    return asked.withColumn("_k", as_key(column)).join(parents.select(as_key(parent_key).alias("_k")), "_k", "left_anti").drop("_k")


def referential_counts(children: Sequence[tuple[DataFrame, dict[str, tuple[str, str]]]], parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(rule, n) for all rules: how many child rows have a parent that isn't there. Null and empty texts mean "no
    parent"; a rule without findings gives 0.

    ``children``: tables, each with its rules as ``rule: (column, parent)``; ``parents``: ``parent: (table, key)``. References to a
    parent are counted by key before the one shuffle in which they meet the parent's keys, so a frequent key sends a row a
    task and no parent has to fit into memory. Keys of different types are compared as texts.
    """
    found = []
    for parent, (table, key) in parents.items():
        asked = [(rows, rule, column) for rows, rules in children for rule, (column, of) in rules.items() if of == parent]
        if not asked:
            continue
        kinds = {table.schema[key].dataType.simpleString(), *(rows.schema[column].dataType.simpleString() for rows, _, column in asked)}
        kind = kinds.pop() if len(kinds) == 1 else "string"
        sides = [table.select(F.col(key).cast(kind).alias("key"), F.lit(-1).alias("rule")), *(rows.select(F.col(column).cast(kind).alias("key"), F.lit(k).alias("rule")) for k, (rows, _, column) in enumerate(asked))]
        known = reduce(DataFrame.unionAll, sides).where("key IS NOT NULL")
        met = (known.where("key != ''") if kind == "string" else known).groupBy("key").agg(F.min("rule").alias("_least"), *(F.count_if(F.col("rule") == k).alias(f"_{k}") for k in range(len(asked))))
        total = met.where("_least >= 0").agg(*(F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(f"_{k}") for k in range(len(asked))))
        found.append(total.select(F.inline(F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"_{k}").alias("n")) for k, (_, rule, _) in enumerate(asked))))))
    return reduce(DataFrame.unionAll, found)


def duplicates(rows: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Groups of more than one row, with the least and greatest label and the count: members are not gathered."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("first_label"), F.max(label).alias("last_label")).where("n > 1")


def members(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows that share their keys with another one, with the size ``n`` of their group; nulls are equal. Rows are joined
    to their group's size, so no group is gathered."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(keys)), "n")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(keys)))
    return rows.join(sizes, same).drop(*(f"_{k}" for k in range(len(keys))))


def outside(rows: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*allowed))


def capped(findings: DataFrame, group: str, order: Sequence[str], most: int = 50) -> DataFrame:
    """The first ``most`` findings of each group, each with how many more the group has (the listing's own limit)."""
    w = Window.partitionBy(group)
    total = findings.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    top = findings.withColumn("_r", F.row_number().over(w.orderBy(*order))).where(F.col("_r") <= most)
    return top.join(total, group).withColumn("n_more", F.greatest(F.col("_n") - most, F.lit(0))).drop("_r", "_n")


def first_error(lines: DataFrame, document: str, position: str, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    """(document, error): the message of the first line, in order, that fails a check."""
    said = F.coalesce(*(F.when(bad, message) for bad, message in checks))
    return lines.withColumn("error", said).where("error IS NOT NULL").groupBy(document).agg(F.min_by("error", position).alias("error"))
