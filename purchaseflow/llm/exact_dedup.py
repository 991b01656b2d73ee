"""Exact duplicates by Patricia tries.

Texts are dealt by length and content hash; each task puts the full byte strings of its share into a compressed
radix trie, whose terminal nodes hold the smallest identifier and the number of rows. Equal means equal bytes:
a hash only deals rows out. Map tasks put their own rows into a trie first, so that of a text with any number
of copies each map task sends one row, and no key is hot in the shuffle.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, batches, column, free_name, integral, partitions, utf8

#: Bytes of labels that a task's trie holds before it writes its largest subtree to a scratch file.
TRIE_BYTES = 96 << 20


class Node:
    __slots__ = ("label", "kids", "least", "count", "file")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.kids: dict[int, Node] = {}
        self.least: int | None = None
        self.count = 0
        self.file: tempfile._TemporaryFileWrapper | None = None  # what stands below, once spilled


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix, by halving, so that comparisons run in C."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """Compressed radix trie of byte strings; a terminal node has the least id (None if all are null) and the row count.

    Beyond ``limit`` bytes of labels the heaviest subtree goes to an unnamed scratch file of the task (as Spark's own
    sorts spill), and what later comes to its node is appended there. items() reads each file back into a trie of its
    own, so memory stays bounded by the limit, or by the longest string of each first byte, and each string comes out once.
    """

    def __init__(self, limit: int = TRIE_BYTES) -> None:
        self.root, self.limit, self.bytes = Node(b""), limit, 0

    def add(self, key: bytes, least: int | None, count: int) -> None:
        node, rest = self.root, key
        while rest:
            if node.file:
                break
            kid = node.kids.get(rest[0])
            if kid is None:
                kid = node.kids[rest[0]] = Node(rest)
                self.bytes += len(rest) + 100
                node, rest = kid, b""
            elif rest.startswith(kid.label):
                node, rest = kid, rest[len(kid.label) :]
            else:
                n = shared_prefix(rest, kid.label)
                fork = Node(kid.label[:n])
                kid.label = kid.label[n:]
                fork.kids[kid.label[0]] = kid
                node.kids[rest[0]] = fork
                self.bytes += 100
                node, rest = fork, rest[n:]
        if node.file:
            _append(node.file, rest, least, count)
            return
        node.count += count
        if least is not None and (node.least is None or least < node.least):
            node.least = least
        if self.bytes > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Moves what is below the lowest node that holds most of a branch of the root to that node's file. Branches of
        one string stay; where there are no others, the trie has at most 256 strings."""
        weight: dict[int, int] = {}
        todo = [(self.root, False)]
        while todo:
            node, seen = todo.pop()
            if seen:
                weight[id(node)] = len(node.label) + 100 + sum(weight[id(k)] for k in node.kids.values())
            else:
                todo.append((node, True))
                todo.extend((k, False) for k in node.kids.values())
        forked = [k for k in self.root.kids.values() if k.kids]
        if not forked:
            return
        node = max(forked, key=lambda k: weight[id(k)])
        while True:
            heavy = max(node.kids.values(), key=lambda k: weight[id(k)])
            if not heavy.kids or 2 * weight[id(heavy)] < weight[id(node)]:
                break
            node = heavy
        node.file = tempfile.TemporaryFile(dir=scratch_folder())  # noqa: SIM115
        for kid in node.kids.values():
            self.bytes -= weight[id(kid)]
            for item in walk(kid, b""):
                _append(node.file, *item)
        node.kids = {}
        if node.count:
            _append(node.file, b"", node.least, node.count)
            node.count, node.least = 0, None

    def items(self) -> Iterator[tuple[bytes, int | None, int]]:
        return walk(self.root, b"", self.limit)


def scratch_folder() -> str | None:
    """Where Spark's own sorts of this machine spill; a task's scratch file goes there and dies with the task."""
    found = os.environ.get("LOCAL_DIRS") or os.environ.get("SPARK_LOCAL_DIRS") or ""
    return next((d for d in found.split(",") if os.path.isdir(d)), None)


def _append(file, key: bytes, least: int | None, count: int) -> None:
    at = b"-" if least is None else str(least).encode()
    file.write(b"%s %d %d\n" % (at, count, len(key)) + key)


def walk(node: Node, prefix: bytes, limit: int = TRIE_BYTES) -> Iterator[tuple[bytes, int | None, int]]:
    """(string, least id, rows) of each terminal node below, spilled ones too."""
    todo = [(node, prefix)]
    while todo:
        node, prefix = todo.pop()
        key = prefix + node.label
        if node.count:
            yield key, node.least, node.count
        if node.file:
            node.file.seek(0)
            deeper = Trie(limit)
            while line := node.file.readline():
                at, count, size = line.split()
                deeper.add(node.file.read(int(size)), None if at == b"-" else int(at), int(count))
            node.file.close()
            node.file = None
            for rest, least, count in deeper.items():
                yield key + rest, least, count
        todo.extend((kid, key) for kid in node.kids.values())


_ENTRY = pa.schema([("data", pa.binary()), ("least", pa.int64()), ("n", pa.int64())])
_SQL = "data binary, least long, n long"


def _through_tries(it: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Puts the rows of a task into a trie and returns one row for each distinct string."""
    trie = Trie(limit)
    for b in it:
        for data, least, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            trie.add(data, least, n)
    yield from batches(trie.items(), _ENTRY, weight=lambda r: len(r[0]))


def normalised(text_col: str) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(column(text_col), F.lit("")), SPACE, " ")


def classes(docs: DataFrame, id_col: str, data: Column, limit: int = TRIE_BYTES, at_least: int = 1) -> DataFrame:
    """Distinct strings ``data`` (binary) with more rows than ``at_least - 1``: sha256, least id, rows."""
    spark = docs.sparkSession
    rows = docs.select(data.alias("data"), column(id_col).cast("long").alias("least"), F.lit(1).cast("long").alias("n"))
    local = rows.mapInArrow(lambda it: _through_tries(it, limit), _SQL)
    dealt = local.repartition(partitions(spark), F.length("data"), F.xxhash64("data"))
    whole = dealt.mapInArrow(lambda it: _through_tries(it, limit), _SQL)
    return whole.where(F.col("n") >= at_least).select(F.sha2("data", 256).alias("sha"), F.col("least").alias("keep"), F.col("n").alias("size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRIE_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space runs become one space. Null text counts as empty, all empty texts
    are one group. A null id is never chosen unless all ids of the group are null (keep_id is then null and kept true).
    Rows that repeat one id with one text all say ``kept`` (they are one document); an empty table gives no rows. Ids are
    whole numbers, others raise TypeError. Texts of any length are taken whole; other columns are left out.
    """
    integral(docs, id_col)
    rows = docs.select(column(id_col).alias("id"), utf8(normalised(text_col)).alias("data"))
    found = classes(rows, "id", F.col("data"), limit, at_least=2)
    shas = rows.select("id", F.sha2("data", 256).alias("text_sha256"))
    out = shas.join(found, shas.text_sha256 == found.sha, "left")
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``docs`` without those whose normalised text has a smaller id elsewhere; columns as they came.

    Of rows that repeat one id and one text, all stay or go together. Only ids and hashes of rows that go are joined.
    Nulls, empty texts and empty tables fare as in ``exact_dedup``.
    """
    seen = exact_dedup(docs, id_col, text_col, limit)
    one, other = free_name(docs, "gone"), free_name(docs, "sha")
    gone = seen.where(~F.col("kept")).select(column(id_col).alias(one), F.col("text_sha256").alias(other))
    at = F.sha2(utf8(normalised(text_col)), 256)
    return docs.join(gone, column(id_col).eqNullSafe(F.col(one)) & (at == F.col(other)), "left_anti")

