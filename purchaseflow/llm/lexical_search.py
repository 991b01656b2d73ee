"""Ranked lexical search by MaxScore with bounds of term pairs.

The index has a row for each block of documents: posting lists of the queries' terms with their impacts and each list's maximum,
and for pairs of terms that queries use the intersection's size and joint maximum impact. A query has its terms in order of
weight. The bound of its first i terms is the least over all ways to take each alone or with its neighbour:

    bound(i) = min(bound(i - 1) + most(i), bound(i - 2) + most(i - 1 and i together)),

where two terms together give no more than the joint maximum of their intersection or either's own maximum. Terms whose
bound is under the score to beat only complete documents that later terms found; a block whose bound is under it is skipped.
The score to beat starts with what a first search over every sixteenth block found, and rises in each task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import LOWER_ASCII, column, forget, integral, portions, utf8, written

#: Documents of a block, share of the blocks that are searched first (one of PRIME), bytes of queries that are searched at a time.
BLOCK, PRIME, QUERY_BYTES = 2048, 16, 16 << 20
#: Terms are what lies between these characters of ASCII.
_BREAKS = bytes(b for b in range(128) if not chr(b).isalnum())
_TERMS = bytes(32 if b in _BREAKS else b for b in LOWER_ASCII)
#: A null id, which comes after all others.
_NO_ID = (1 << 63) - 1


def terms_of(data: bytes) -> list[bytes]:
    """Terms of UTF-8 bytes, A-Z in lower case, repeats included."""
    return data.translate(_TERMS).split()


@dataclass(frozen=True)
class Queries:
    """``asked``: of each query its terms' numbers with how often each occurs; ``ids`` gives the numbers."""

    ids: dict[bytes, int]
    asked: list[Counter]

    @classmethod
    def of(cls, texts: list[bytes]) -> Queries:
        counted = [Counter(terms_of(t)) for t in texts]
        ids = {t: k for k, t in enumerate(sorted({t for c in counted for t in c}))}
        return cls(ids, [Counter({ids[t]: n for t, n in c.items()}) for c in counted])


_POSTINGS = "n_docs long, n_terms long, doc_ids binary, lengths binary, terms array<int>, sizes array<int>, docs binary, tfs binary"
_POSTINGS_ARROW = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("docs", pa.binary()), ("tfs", pa.binary())])


def postings(docs: DataFrame, ids: dict[bytes, int], id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """A row for each block of documents: how many have terms and how many terms these have, and lists of the wanted terms.

    Map-only: a block is what a task reads one after the other. ``docs`` are places in ``doc_ids``, list after list.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        doc_ids: list[int] = []
        lengths: list[int] = []
        own: dict[int, tuple[list[int], list[int]]] = {}

        def block_row() -> pa.RecordBatch:
            terms = sorted(own)
            lists = [np.array([x for t in terms for x in own[t][k]], np.int32).tobytes() for k in (0, 1)]
            row = (n_docs, n_terms, np.array(doc_ids, np.int64).tobytes(), np.array(lengths, np.int64).tobytes(), terms, [len(own[t][0]) for t in terms], *lists)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _POSTINGS_ARROW.types, strict=True)], schema=_POSTINGS_ARROW)

        for b in portions(it):
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = terms_of(data)
                if not words:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(words)
                found = Counter(map(ids.get, words))
                found.pop(None, None)
                if not found:
                    continue
                for t, tf in found.items():
                    at, tfs = own.setdefault(t, ([], []))
                    at.append(len(doc_ids))
                    tfs.append(tf)
                doc_ids.append(_NO_ID if doc_id is None else doc_id)
                lengths.append(len(words))
                if len(doc_ids) >= block:
                    yield block_row()
                    n_docs = n_terms = 0
                    doc_ids, lengths, own = [], [], {}
        if n_docs:
            yield block_row()

    return docs.select(column(id_col).cast("long").alias("_id"), utf8(column(text_col).cast("string")).alias("_data")).mapInArrow(run, _POSTINGS)


@dataclass(frozen=True)
class Statistics:
    """Of all documents: how many have terms, how many terms these have, and each wanted term's weight."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def impact(self, weight: int, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 75 + (25 * length * self.n_docs) // self.n_terms
        return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def statistics(lists: DataFrame, n_wanted: int) -> Statistics:
    """From the posting lists of all blocks; a number for each wanted term comes to the driver."""
    totals = lists.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    each = lists.select(F.explode(F.arrays_zip("terms", "sizes")).alias("e")).groupBy(F.col("e.terms").alias("term")).agg(F.sum(F.col("e.sizes").cast("long")).alias("df"))
    n = totals["d"] or 0
    weights = np.zeros(n_wanted, np.int64)
    for r in each.collect():
        weights[r["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    return Statistics(n, totals["t"] or 1, weights)


@dataclass(frozen=True)
class Plan:
    """Each query's (term, repeats) by ascending weight, and the pairs of neighbours among them, by number."""

    queries: list[list[tuple[int, int]]]
    pairs: dict[tuple[int, int, int, int], int]

    @classmethod
    def of(cls, asked: list[Counter], weights: np.ndarray) -> Plan:
        queries = [sorted(c.items(), key=lambda x: (weights[x[0]], x[0])) for c in asked]
        pairs = sorted({(*a, *b) for q in queries for a, b in zip(q, q[1:], strict=False)})
        return cls(queries, {p: k for k, p in enumerate(pairs)})


_IMPACTS = "part long, doc_ids binary, terms binary, sizes binary, docs binary, impacts binary, most binary, pairs binary, joint binary, shared binary"


def impacts(lists: DataFrame, known: Statistics, plan: Plan) -> DataFrame:
    """The index: of each block the lists with impacts and maxima (``most``), and of each pair of the plan whose lists meet
    there the size of their intersection (``shared``) and its joint maximum (``joint``)."""

    def row(r: dict) -> tuple:
        lengths = np.frombuffer(r["lengths"], np.int64)
        docs, tfs = np.frombuffer(r["docs"], np.int32), np.frombuffer(r["tfs"], np.int32).astype(np.int64)
        ends = np.cumsum(r["sizes"])
        begin = dict(zip(r["terms"], (ends - r["sizes"]).tolist(), strict=True))
        end = dict(zip(r["terms"], ends.tolist(), strict=True))
        weights = known.weights[np.repeat(np.array(r["terms"], np.int64), r["sizes"])] if r["terms"] else np.zeros(0, np.int64)
        values = known.impact(weights, tfs, lengths[docs])
        most = np.maximum.reduceat(values, ends - r["sizes"]) if len(ends) else np.zeros(0, np.int64)
        scratch, filled = np.zeros(len(lengths), np.int64), None
        pairs, joint, shared = [], [], []
        for (s, m, t, n), k in plan.pairs.items():  # sorted, so the pairs of one first term follow each other
            if s not in begin or t not in begin:
                continue
            if filled != (s, m):
                if filled:
                    scratch[docs[begin[filled[0]] : end[filled[0]]]] = 0
                scratch[docs[begin[s] : end[s]]] = m * values[begin[s] : end[s]] + 1  # 0: not in the list
                filled = (s, m)
            first = scratch[docs[begin[t] : end[t]]]
            both = first > 0
            if both.any():
                pairs.append(k)
                joint.append(int((first + n * values[begin[t] : end[t]])[both].max()) - 1)
                shared.append(int(both.sum()))
        return r["doc_ids"], np.array(r["terms"], np.int32), np.array(r["sizes"], np.int32), docs, values, most, np.array(pairs, np.int32), np.array(joint, np.int64), np.array(shared, np.int32)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it, 1):
            part, *rest = b.column(0).to_pylist()[0], *row(b.slice(0, 1).to_pylist()[0])
            cols = [pa.array([part], pa.int64()), *(pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in rest)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _IMPACTS.split(", ")])

    return lists.where("size(terms) > 0").select(F.monotonically_increasing_id().alias("part"), "doc_ids", "lengths", "terms", "sizes", "docs", "tfs").mapInArrow(run, _IMPACTS)


class Best:
    """The highest scores so far of one query, equal ones by ascending id; ``beat``: what a document must reach."""

    def __init__(self, k: int, beat: int):
        self.k, self.beat = k, max(1, beat)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.beat = max(self.beat, int(self.scores[-1]))


@dataclass
class Block:
    """A row of the index, ready for look-ups."""

    doc_ids: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray, int]]
    joint: dict[int, int]

    @classmethod
    def of(cls, r: dict) -> Block:
        terms, sizes = np.frombuffer(r["terms"], np.int32), np.frombuffer(r["sizes"], np.int32)
        docs, values, most = np.frombuffer(r["docs"], np.int32), np.frombuffer(r["impacts"], np.int64), np.frombuffer(r["most"], np.int64)
        ends = np.cumsum(sizes)
        lists = {t: (docs[e - n : e], values[e - n : e], m) for t, n, e, m in zip(terms.tolist(), sizes.tolist(), ends.tolist(), most.tolist(), strict=True)}
        return cls(np.frombuffer(r["doc_ids"], np.int64), lists, dict(zip(np.frombuffer(r["pairs"], np.int32).tolist(), np.frombuffer(r["joint"], np.int64).tolist(), strict=True)))


def bounds(block: Block, query: list[tuple[int, int]], pairs: dict) -> list[int]:
    """The most that the first i terms of a query can give a document of the block, for each i."""
    out, before, last = [0], 0, None
    for term, n in query:
        own = block.lists[term][2] * n if term in block.lists else 0
        bound = out[-1] + own
        if last is not None and own and before:
            together = max(own, before, block.joint.get(pairs[(*last, term, n)], 0))
            bound = min(bound, out[-2] + together)
        out.append(bound)
        before, last = own, (term, n)
    return out


def visit(block: Block, query: list[tuple[int, int]], pairs: dict, best: Best) -> int:
    """Adds the block's documents that reach the score to beat; returns how many were scored at all."""
    most = bounds(block, query, pairs)
    if most[-1] < best.beat:
        return 0
    cut = next(i for i in range(len(query), -1, -1) if most[i] < best.beat)
    scores, seen = np.zeros(len(block.doc_ids), np.int64), np.zeros(len(block.doc_ids), bool)
    for term, n in query[cut:]:
        if term in block.lists:
            docs, values, _ = block.lists[term]
            scores[docs] += n * values
            seen[docs] = True
    left = np.flatnonzero(seen & (scores + most[cut] >= best.beat))
    scored = len(left)
    for i in range(cut - 1, -1, -1):
        if not len(left):
            return scored
        if query[i][0] in block.lists:
            docs, values, _ = block.lists[query[i][0]]
            at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
            hit = docs[at] == left
            scores[left[hit]] += query[i][1] * values[at[hit]]
        left = left[scores[left] + most[i] >= best.beat]
    if len(left):
        best.add(scores[left], block.doc_ids[left])
    return scored


def _searched(index: DataFrame, plan: Plan, k: int, beat: list[int]) -> DataFrame:
    """(query, doc_id, score): each task's best ones, none under the score to beat."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, x) for x in beat]
        for b in portions(it, 1):
            block = Block.of(b.to_pylist()[0])
            for query, own in zip(plan.queries, best, strict=True):
                if query:
                    visit(block, query, plan.pairs, own)
        query = np.repeat(np.arange(len(best), dtype=np.int32), [len(x.ids) for x in best])
        ids, scores = (np.concatenate([getattr(x, name) for x in best] or [np.zeros(0, np.int64)]) for name in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids), pa.array(scores)], names=["query", "doc_id", "score"])

    found = index.drop("part", "shared").mapInArrow(run, "query int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` best documents of each query, equal scores by ascending id.

    Scores are whole numbers; only those over 0 count. Null and empty texts have no terms: as documents they are not counted
    among all, as queries they find nothing. Texts are read whole. Documents that repeat count and rank as often as they
    are there; those with a null id come after all of their score. Queries that repeat are answered each. Extra columns are
    left out. An empty table on either side gives an empty one. Ids of documents must be whole numbers.

    The queries' terms go to all tasks: queries are taken in portions of about 16 MB of text, each with an index of its own.
    """
    spark = docs.sparkSession
    integral(docs, id_col)
    asked = queries.select(column(query_id), utf8(column(query_text).cast("string")).alias("_data"))
    size = asked.agg(F.sum(F.length("_data").cast("long"))).first()[0] or 0
    n = -(-size // QUERY_BYTES) or 1
    found = [_answers(docs, asked.where(F.pmod(F.xxhash64("_data"), F.lit(n)) == part) if n > 1 else asked, k, id_col, text_col, query_id, block) for part in range(n)]
    return written(spark, reduce(DataFrame.union, found), "found") if n > 1 else found[0]


def _answers(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, query_id: str, block: int) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.collect()
    wanted = Queries.of([bytes(r[1]) for r in rows])
    lists = written(spark, postings(docs, wanted.ids, id_col, text_col, block), "postings")
    known = statistics(lists, len(wanted.ids))
    plan = Plan.of(wanted.asked, known.weights)
    index = written(spark, impacts(lists, known, plan), "impacts")
    forget(lists)
    beat = [0] * len(rows)
    first = _searched(index.where(F.pmod(F.xxhash64("part"), F.lit(PRIME)) == 0), plan, k, beat)
    for r in first.where(F.col("rank") == k).collect():
        beat[r["query"]] = r["score"]
    best = _searched(index, plan, k, beat)
    names = spark.createDataFrame([(q, r[0]) for q, r in enumerate(rows)], StructType([StructField("_query", IntegerType()), asked.schema[0]]))
    doc_id = F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).cast(docs.schema[id_col].dataType)
    out = best.join(F.broadcast(names), F.col("query") == F.col("_query"))
    return out.select(column(query_id), F.col("rank").cast("int").alias("rank"), doc_id.alias("doc_id"), F.col("score").cast(LongType()).alias("score"))
