"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces go, longest first, to the open bin with the least room that still takes them. Where none does, a bin is opened
in the size that costs least for each word it is expected to hold, given all pieces still to come; at the end each
bin shrinks to the least permitted size that holds its contents. Pieces are dealt into shards of bounded size by
a hash of their document's id, and each shard is packed by one task; as shards hold thousands of pieces, little is lost by that.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from .common import batches, column, written

#: Permitted lengths, in words.
CAPACITIES = (512, 1024, 2048, 4096)
#: A sequence of c places costs c + OVERHEAD + c * c / ATTENTION: its places, itself, and each place looking at all.
OVERHEAD, ATTENTION = 16, 65536
#: Pieces of a shard, on average.
SHARD = 4096


class Remaining:
    """How many pieces of each length are still to come, with the largest that fits found by bisection."""

    def __init__(self, lengths: list[int]) -> None:
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.lengths = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n]
            del self.lengths[bisect_left(self.lengths, n)]

    def fill(self, room: int) -> int:
        """Words that would go into ``room`` if the largest fitting piece were taken again and again."""
        used, i = 0, bisect_right(self.lengths, room) - 1
        while i >= 0 and room > 0:
            n = self.lengths[i]
            times = min(self.count[n], room // n)
            used, room = used + times * n, room - times * n
            i = min(i - 1, bisect_right(self.lengths, room) - 1)
        return used


def cost(capacity: int) -> float:
    return capacity + OVERHEAD + capacity * capacity / ATTENTION


def opening_size(piece: int, left: Remaining, capacities: tuple[int, ...]) -> int:
    """The capacity with the least cost for each word expected in it; of equal ones the smallest."""
    best, size = None, 0
    for c in capacities:
        if c >= piece:
            held = piece + left.fill(c - piece)
            if best is None or cost(c) / held < best:
                best, size = cost(c) / held, c
    return size


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """(bin, capacity, place in it) for each of ``lengths``, which come in decreasing order, none over the largest capacity."""
    left, room, bins, out = Remaining(lengths), [], [], []
    for n in lengths:
        left.take(n)
        i = bisect_left(room, (n, -1))
        if i < len(room):
            free, b = room.pop(i)
        else:
            b, free = len(bins), opening_size(n, left, capacities)
            bins.append([free, 0])
        out.append((b, bins[b][1]))
        bins[b][1] += n
        if free > n:
            insort(room, (free - n, b))
    final = [min(c for c in capacities if c >= used) for _, used in bins]
    return [(b, final[b], place) for b, place in out]


def lengths(docs: DataFrame, id_col: str, length: Column) -> DataFrame:
    """(id, total, deal) of each document; ``deal`` is a hash of the id, or of the whole row where there is no id."""
    whole = [column(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    deal = F.when(column(id_col).isNotNull(), F.xxhash64(column(id_col))).otherwise(F.xxhash64(*whole)).alias("deal")
    return docs.select(column(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("total"), deal)


def pieces(rows: DataFrame, most: int) -> DataFrame:
    """(id, piece, begin, n, deal) of each row of ``lengths`` cut into pieces of ``most`` words, the last one shorter; of a
    document without words one piece of length 0."""
    cut = F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("total") - 1) / most), F.lit(0).cast("long"))), lambda k: k * most))
    rows = rows.select("id", "total", "deal", cut.alias("piece", "begin"))
    return rows.select("id", "piece", "begin", F.least(F.col("total") - F.col("begin"), F.lit(most).cast("long")).alias("n"), "deal")


def best_fit(docs: DataFrame, length: Column, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """One row per piece: id, piece, begin, n_words, bin, capacity, place.

    ``length`` is a column of ``docs``, null counts as 0. Pieces without words have no bin (null) and capacity 0.
    Null ids and rows that repeat an id are packed as documents of their own. An empty table gives no rows. Documents
    longer than the largest capacity are cut into pieces; other columns are left out, whatever their names. Words are
    counted once; shards hold ``shard`` pieces on average, so a few very long documents take many shards too.
    """
    kind = docs.schema[id_col].dataType
    sizes = tuple(sorted(set(capacities)))
    counted = written(docs.sparkSession, lengths(docs, id_col, length), "lengths")
    found = counted.agg(F.sum(F.ceil(F.col("total") / sizes[-1]))).first()[0] or 0
    shards = max(1, -(-found // shard))
    cut = pieces(counted, sizes[-1])
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("deal", "piece"), F.lit(shards)).cast("long")).where("n > 0")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def rows() -> Iterator[tuple]:
            nonlocal schema
            now, held = None, []
            for b in it:
                if schema is None:
                    schema = pa.schema([("id", b.column(0).type), ("piece", pa.int32()), *((c, pa.int64()) for c in ("begin", "n_words", "bin", "capacity", "place"))])
                for id_, piece, begin, n, part in zip(*(c.to_pylist() for c in b.columns)):
                    if part != now and held:
                        yield from packed(now, held)
                        held = []
                    now = part
                    held.append((id_, piece, begin, n))
            if held:
                yield from packed(now, held)

        def packed(part: int, held: list[tuple]) -> Iterator[tuple]:
            for row, (b, size, place) in zip(held, pack([r[3] for r in held], sizes)):
                yield *row, part << 32 | b, size, place

        source = rows()
        first = next(source, None)
        if first is not None:
            yield from batches((x for part in ((first,), source) for x in part), schema)

    dealt = dealt.select("id", "piece", "begin", "n", "shard").repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n"), "id", "piece")
    out = dealt.mapInArrow(run, StructType([*StructType().add("id", kind), *StructType.fromDDL("piece int, begin long, n_words long, bin long, capacity long, place long")]))
    none = cut.where("n = 0").select("id", "piece", "begin", F.col("n").alias("n_words"), F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("place"))
    return out.union(none).withColumnRenamed("id", id_col)


def word_count(text: str = "text") -> Column:
    """Words of a text: runs without white space; null has none."""
    return F.regexp_count(F.coalesce(column(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]++"))
