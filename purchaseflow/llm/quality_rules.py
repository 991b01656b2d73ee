"""Quality rules as a bitmask ledger.

Every document is measured once and every rule evaluated once. The ledger keeps the measurements and one
``failed`` bit for each rule; policies (a version, and a mask of the rules that reject) are applied to the
ledger later without touching texts, and ablations count, from a group-by over the distinct bit patterns,
what each policy would keep without each of its rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DataType, LongType, StructType

from .common import column, free_name, utf8, words_of

#: Characters that count as symbols (fixed by the contract of op7).
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks")


def repeat_words(words: list[bytes]) -> int:
    """Words lying in 3-word windows that occur twice or more in the text, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = set(windows)
    if len(seen) == len(windows):
        return 0
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


_ALL = bytes(range(256))
_UPPER = bytes(c for c in range(256) if 65 <= c <= 90)
_LETTER = bytes(c for c in range(256) if 65 <= c <= 90 or 97 <= c <= 122)
_DIGIT = b"0123456789"
_MARK = b"!?"
_CONTINUES = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\x0b\x0c\r"


def _count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def measure_text(data: bytes) -> tuple[int, ...]:
    """All MEASURES of one text, in that order; code points, not bytes, in ``word_chars``."""
    words = words_of(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words), len(data) - _count(data, _CONTINUES + _SPACES), _count(data, SYMBOLS), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), _count(data, _UPPER), _count(data, _LETTER), _count(data, _DIGIT), _count(data, _MARK),
    )


def _with_measures(name: str, kind: DataType) -> StructType:
    out = StructType().add(name, kind)
    for m in MEASURES:
        out = out.add(m, LongType())
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and MEASURES (long). A null text has no words; rows repeat as they do in the input.
    Long texts are measured whole, other columns are left out, whatever their names, and an empty table gives no rows."""

    kind = docs.schema[id_col].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [measure_text(x.as_py()) for x in b.column(1)]
            cols = list(zip(*got)) if got else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["id", *MEASURES])

    out = docs.select(column(id_col).alias("id"), utf8(column(text_col)).alias("data")).mapInArrow(run, _with_measures("id", kind))
    return out.withColumnRenamed("id", id_col)


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` (SQL over MEASURES) is true. Its bit never changes once a ledger was stored."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any of ``rules``."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "many_symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 6 AND 10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "shouting", "n_letters >= 40 AND 10 * n_upper > 6 * n_letters"),
    Rule(5, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule(6, "many_digits", "n_words > 0 AND 10 * n_digits > 3 * word_chars"),
    Rule(7, "many_marks", "10 * n_marks > 3 * n_words"),
)
BASE = ("too_few_words", "repeated_windows")
POLICIES = (
    Policy("v1", BASE),
    Policy("v2", (*BASE, "many_symbols", "repeated_lines", "shouting")),
    Policy("v3", tuple(r.name for r in RULES)),
)


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """Sum of the bits of the rules that fail, over the columns of measure()."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Id, measurements and ``failed_bits`` of every row: one pass over the texts, no shuffle. Rows as in ``measure``."""
    return measure(docs, id_col, text_col).withColumn("failed_bits", failure_bits(rules))


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    by_name = {r.name: 1 << r.bit for r in rules}
    return sum(by_name[n] for n in set(names))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask(policy.rules, rules)).cast("long")) == 0


def apply_policies(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with a ``kept_<version>`` boolean for each policy. Texts aren't read again."""
    return book.withColumns({free_name(book, f"kept_{p.version}"): passes(p, rules) for p in policies})


def ablations(book: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents kept with the rule, kept without it, and rejected by it alone.

    The ledger is first counted by bit pattern (at most 2 ** rules groups); the rest works on those counts.
    """
    spark = book.sparkSession
    patterns = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    tried = [(p.version, n, mask(p.rules, rules), mask(tuple(x for x in p.rules if x != n), rules)) for p in policies for n in p.rules]
    if not tried:
        return spark.createDataFrame([], "version string, rule string, n_docs long, kept_with long, kept_without long, only_this long")
    one = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(a).cast("long").alias("all_mask"), F.lit(b).cast("long").alias("rest_mask")) for v, r, a, b in tried)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    with_it, without = F.col("failed_bits").bitwiseAND(F.col("t.all_mask")) == 0, F.col("failed_bits").bitwiseAND(F.col("t.rest_mask")) == 0
    return (
        patterns.select("failed_bits", "n", one.alias("t")).groupBy(F.col("t.version").alias("version"), F.col("t.rule").alias("rule"))
        .agg(F.sum("n").alias("n_docs"), total(with_it).alias("kept_with"), total(without).alias("kept_without"), total(without & ~with_it).alias("only_this"))
    )


def keep_good(docs: DataFrame, policy: Policy = POLICIES[-1], id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, all columns as they came.

    The measures ride along with the row, so nothing is joined or shuffled. Documents with null text have no
    words and fail ``too_few_words`` wherever a policy has that rule. Columns that clash with MEASURES are kept.
    """
    names = docs.columns
    packed = docs.select(F.struct(*(column(c).alias(c) for c in names)).alias("row"), utf8(column(text_col)).alias("data"))
    schema = packed.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [measure_text(x.as_py()) for x in b.column(1)]
            cols = list(zip(*got)) if got else [()] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["row", *MEASURES])

    book = packed.mapInArrow(run, _with_measures("row", schema["row"].dataType)).withColumn("failed_bits", failure_bits(rules))
    return book.where(passes(policy, rules)).select(*(F.col("row").getField(c).alias(c) for c in names))
