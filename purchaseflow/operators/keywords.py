"""Classification by tables of keyword rules: the first rule of a set that has a keyword anywhere in the text wins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Bytes of keywords that go to the tasks at once; more rules are taken in portions of about this size.
PORTION = 16 << 20


def classify(rows: DataFrame, text: str, rules: DataFrame, sets: Sequence[str], default: str = "Uncategorized") -> DataFrame:
    """``rows`` with a column for each of the ``sets``: the category of its first rule of which the keyword is in the text.

    ``rules`` has rule_set, rule_no, category and keyword; a rule may have several rows, and sets may disagree. Letters are
    compared in lower case, and a keyword counts within a word too. An automaton over the keywords of all sets finds the least
    rule numbers in one pass over a text, so the time does not grow with the number of rules. Of equal numbers in a set
    the least category counts. An empty keyword is in every text but a null one, which gets ``default`` like one without a hit.
    """
    low = rules.where(F.col("keyword").isNotNull()).select("rule_set", "rule_no", F.lower("keyword").alias("keyword"))
    least = low.groupBy("rule_set", "keyword").agg(F.min("rule_no").cast("long").alias("rule_no"))
    size = least.agg(F.sum(F.octet_length("keyword").cast("long"))).first()[0] or 0
    n = max(1, -(-size // PORTION))
    out = rows
    for k in range(n):
        part = least.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == k) if n > 1 else least
        out = _hits(out, text, [tuple(r) for r in part.select("keyword", "rule_set", "rule_no").collect()], sets, f"_hit{k}")
    named = rules.groupBy("rule_set", F.col("rule_no").cast("long").alias("rule_no")).agg(F.min("category").alias("category"))
    for s in sets:
        hits = [F.col(f"_hit{k}_{s}") for k in range(n)]
        out = out.withColumn(f"_no_{s}", F.least(*hits) if n > 1 else hits[0]).drop(*(f"_hit{k}_{s}" for k in range(n)))
        own = named.where(F.col("rule_set") == s).select(F.col("rule_no").alias(f"_no_{s}"), F.col("category").alias(f"_category_{s}"))
        out = out.join(own, f"_no_{s}", "left").withColumn(s, F.coalesce(f"_category_{s}", F.lit(default))).drop(f"_no_{s}", f"_category_{s}")
    return out.select(*rows.columns, *sets)


def _hits(rows: DataFrame, text: str, keywords: list[tuple[str, str, int]], sets: Sequence[str], prefix: str) -> DataFrame:
    """``rows`` with the least rule number of each set that these keywords give, null without one."""
    names = [f"{prefix}_{s}" for s in sets]
    place = {s: k for k, s in enumerate(sets)}
    at, whole = rows.columns.index(text), [*rows.columns, *names]
    everywhere = [min((no for word, s, no in keywords if not word and s == name), default=None) for name in sets]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        own: dict[str, list[tuple[int, int]]] = {}
        for word, s, no in keywords:
            if word and s in place:
                own.setdefault(word, []).append((place[s], no))
        for word, hits in own.items():
            found.add_word(word, hits)
        found.make_automaton()
        for b in it:
            columns: list[list] = [[] for _ in sets]
            for said in b.column(at).to_pylist():
                best = [None] * len(sets) if said is None else list(everywhere)
                for _, hits in found.iter(said.lower()) if said and own else ():
                    for k, no in hits:
                        if best[k] is None or no < best[k]:
                            best[k] = no
                for k, no in enumerate(best):
                    columns[k].append(no)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in columns)], names=whole)

    return rows.mapInArrow(run, StructType([*rows.schema, *(StructField(c, LongType()) for c in names)]))


def by_rule_table(rules: dict[str, DataFrame]) -> DataFrame:
    """One table of rules from a table (rule_no, category, keyword) for each set."""
    return reduce(DataFrame.unionByName, (r.select(F.lit(s).alias("rule_set"), "rule_no", "category", "keyword") for s, r in rules.items()))
