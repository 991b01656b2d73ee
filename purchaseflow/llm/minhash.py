"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has chunks of WIDTH symbols, each BITS bits of one minimum hash. Two signatures within
``2 * chunks - 1`` unequal symbols agree, by the pigeonhole principle, in some chunk but for one symbol at most; so
each chunk is indexed once for each symbol left out, and all such pairs share a key. That distance is the threshold
for a loose link, and there are as many chunks as it takes for a pair just at the wanted similarity to be beyond it
with a chance of MISS at most. The loose groups only say which documents must meet: each is then split by exact set
similarity, all its members compared as far as they aren't yet known to be connected, so no true link between members
is lost.

Sets that are equal are one node from the start, however many documents have them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, LOWER_ASCII, batches, column, free_name, integral, join_hot, partitions, utf8, written
from .components import components

#: Symbols of a chunk, and bits of a symbol: few unlike texts agree in four symbols, however many there are.
WIDTH, BITS = 5, 16
#: Chance at most that a pair just at the threshold of similarity is beyond the signatures' threshold.
MISS = 1e-6
#: Members of a bucket that one task compares; in larger buckets all are tied to the least member instead.
BUCKET = 20_000
#: Shingles that a task compares at once; larger loose groups are compared in parts.
BLOCK = 4_000_000
#: Members of a large loose group that all others are compared with first.
PIVOTS = 16
#: Parts that the rows of a large loose group are dealt into, so that no task gets all of them.
SPREAD = 64
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = out
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingles(data: bytes, hashes: WordHashes, width: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text; with fewer words, one for them all."""
    words = data.translate(LOWER_ASCII).split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _M1 + w[k : len(w) - n + 1 + k] + _M3)
    return np.unique(out)


def beyond(n: int, chance: float, most: int) -> float:
    """The chance of more than ``most`` of ``n`` independent symbols being unequal, each with ``chance``."""
    return sum(comb(n, k) * chance**k * (1 - chance) ** (n - k) for k in range(most + 1, n + 1))


def chunks_for(percent: int) -> int:
    """The fewest chunks that keep pairs of just this similarity within the signatures' threshold but for MISS."""
    return next(c for c in range(1, 150) if beyond(c * WIDTH, 1 - percent / 100, far_for(c)) <= MISS)


def far_for(chunks: int) -> int:
    """The signatures' threshold: unequal symbols that leave one chunk with one error at most."""
    return 2 * chunks - 1


def multipliers(count: int) -> np.ndarray:
    """Odd 64-bit factors from a fixed rule: the first bytes of SHA-256 of their number."""
    return np.array([int.from_bytes(hashlib.sha256(b"%d" % i).digest()[:8], "big") | 1 for i in range(count)], np.uint64)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A symbol (uint16) for each factor: bits of the least hash under it."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 4096):
        np.minimum(least, (found[k : k + 4096, None] * factors).min(axis=0), out=least)
    return (_mix(least) >> np.uint64(64 - BITS)).astype("<u2")


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The index keys of signatures (rows): for each chunk and each symbol left out, a hash of the rest."""
    chunks = signatures.shape[1] // WIDTH
    chunk = signatures.reshape(len(signatures), chunks, WIDTH).astype(np.uint64) + np.uint64(1)
    place = np.arange(chunks * WIDTH, dtype=np.uint64).reshape(1, chunks, WIDTH)
    out = np.broadcast_to(_mix(place * _M1 + _M3), (len(signatures), chunks, WIDTH))
    drop = np.eye(WIDTH, dtype=bool)
    for k in range(WIDTH):
        symbol = np.where(drop[k], np.uint64(0), chunk[:, :, k, None])
        out = _mix(out * _M1 + symbol)
    return out.reshape(len(signatures), -1)


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, n_shingles, set_hash, signature) of every row; set_hash is 128 bits of the whole sorted set."""
    factors = multipliers(chunks_for(percent) * WIDTH)
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("signature", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            rows = []
            for data in b.column(1):
                s = shingles(data.as_py(), hashes, width)
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s, factors).tobytes()) if len(s) else (0, None, None))
            n, h, sig = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.binary()), pa.array(sig, pa.binary())], schema=schema)

    return docs.select(column(id_col).cast("long").alias("id"), utf8(column(text_col)).alias("data")).mapInArrow(run, "id long, n_shingles long, set_hash binary, signature binary")


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, list of row tuples without the key) of rows that come sorted by their first column."""
    key, held = None, []
    for b in it:
        for k, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(rest)
    if held:
        yield key, held


def buckets(nodes: DataFrame, most: int = BUCKET) -> DataFrame:
    """(bucket, id, oversize) of the nodes (id, signature) that share a key with another; buckets of equal members are one.

    Each task sorts its share of (key, id) rows; a bucket's name is a hash of its members, so that the many keys that
    near copies share make one bucket, not sixty.
    """
    spark = nodes.sparkSession

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(b.num_rows, -1)
                ids = np.repeat(b.column(0).to_numpy(), sig.shape[1])
                flat = pa.RecordBatch.from_arrays([pa.array(keys_of(sig).reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])
                for k in range(0, flat.num_rows, 50_000):
                    yield flat.slice(k, 50_000)

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in it if b.num_rows]
        if not got:
            return
        key, ids = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(key)))
        shared = np.repeat(size > 1, size)
        if not shared.any():
            return
        start, size = np.cumsum(size[size > 1]) - size[size > 1], size[size > 1]
        ids = ids[shared]
        one = _mix(ids.view(np.uint64) * _M1 + _M3)
        name = _mix(np.add.reduceat(one, start) + np.bitwise_xor.reduceat(_mix(one), start) * _M1 + size.astype(np.uint64))
        _, kept = np.unique(name, return_index=True)
        keep = np.zeros(len(name), bool)
        keep[kept] = True
        rows = np.repeat(keep, size)
        out = [np.repeat(name, size)[rows].view(np.int64), ids[rows], np.repeat(size, size)[rows].astype(np.int64)]
        flat = pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["bucket", "id", "n"])
        for k in range(0, flat.num_rows, 50_000):
            yield flat.slice(k, 50_000)

    keyed = nodes.select("id", "signature").mapInArrow(index, "key long, id long").repartition(partitions(spark), "key")
    found = keyed.mapInArrow(meet, "bucket long, id long, n long")
    return found.groupBy("bucket", "id").agg((F.max("n") > most).alias("oversize"))


def loose_links(nodes: DataFrame, far: int, most: int = BUCKET) -> DataFrame:
    """(u, v): links that span, in each bucket, what is tied by signatures within ``far`` unequal symbols."""
    spark = nodes.sparkSession
    members = written(spark, buckets(nodes, most), "buckets")

    def tie(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, held in _groups(it):
                sig = np.frombuffer(b"".join(s for _, s in held), "<u2").reshape(len(held), -1)
                left = np.arange(len(held))
                while len(left) > 1:
                    todo, left = [left[0]], left[1:]
                    while todo and len(left):
                        i = todo.pop()
                        near = (sig[left] != sig[i]).sum(axis=1) <= far
                        for j in left[near].tolist():
                            yield held[i][0], held[j][0]
                            todo.append(j)
                        left = left[~near]

        yield from batches(rows(), pa.schema([("u", pa.int64()), ("v", pa.int64())]), 50_000)

    small = members.where("NOT oversize").join(nodes.select("id", "signature"), "id").select("bucket", "id", "signature")
    small = small.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
    large = members.where("oversize")
    hubs = large.groupBy(F.col("bucket").alias("at")).agg(F.min("id").alias("v"))
    large = large.join(hubs, F.col("bucket") == F.col("at")).select(F.col("id").alias("u"), "v")
    return small.mapInArrow(tie, "u long, v long").union(large)


def close_pairs(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Index pairs that span the graph of sets with ``100 * intersection >= percent * union``.

    A breadth-first search: each set reached is compared, by counting shared elements through postings, with all sets
    that aren't reached yet, so every component comes out whole.
    """
    left = np.arange(len(sets))
    todo: list[int] = []
    index, reached = None, np.zeros(len(sets), bool)
    while len(left):
        if index is None or len(left) < len(index.which) // 2:
            index = Postings([sets[i] for i in left], left)
        if not todo:
            todo.append(int(left[0]))
            reached[left[0]] = True
            left = left[1:]
            continue
        i = todo.pop()
        j = index.close_to(sets[i], percent)
        j = j[~reached[j]]
        for x in j.tolist():
            yield i, x
        todo.extend(j.tolist())
        reached[j] = True
        left = left[~reached[left]]


class Postings:
    """Sets with numbers ``which``, by element."""

    def __init__(self, sets: list[np.ndarray], which: np.ndarray) -> None:
        self.which, self.sizes = which, np.array([len(s) for s in sets], np.int64)
        element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(element, kind="stable")
        self.element, self.owner = element[by], owner[by]

    def close_to(self, found: np.ndarray, percent: int) -> np.ndarray:
        """Numbers of the sets that have ``percent`` hundredths of their union with ``found`` in common."""
        a, z = np.searchsorted(self.element, found, "left"), np.searchsorted(self.element, found, "right")
        n = z - a
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        j = np.flatnonzero(common)
        return self.which[j[100 * common[j] >= percent * (len(found) + self.sizes[j] - common[j])]]


class Union:
    """Which of the numbers 0 to n - 1 are known to be connected."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


_LINK, _LINK_SQL = pa.schema([("u", pa.int64()), ("v", pa.int64())]), "u long, v long"


def exact_links(docs: DataFrame, loose: DataFrame, id_col: str, text_col: str, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(u, v): links that span the exact components within each loose group (node, root).

    The sets of a group of up to ``block`` shingles meet in one task; for larger ones see ``large_links``.
    """
    spark = docs.sparkSession

    def load(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in it:
            got = [shingles(x.as_py(), hashes, width) for x in b.column(2)]
            for k in range(0, len(got), 256):
                part = b.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in got[k : k + 256]], pa.int64()), pa.array([s.tobytes() for s in got[k : k + 256]], pa.binary())], names=["root", "id", "n", "data"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, held in _groups(it):
                ids, sets = [r[0] for r in held], [np.frombuffer(r[1], np.uint64) for r in held]
                yield from ((ids[i], ids[j]) for i, j in close_pairs(sets, percent))

        yield from batches(rows(), _LINK, 50_000)

    texts = docs.select(column(id_col).cast("long").alias("id"), utf8(column(text_col)).alias("data"))
    texts = loose.join(texts, loose.node == texts.id).select("root", "id", "data")
    sets = written(spark, texts.mapInArrow(load, "root long, id long, n long, data binary").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SPREAD))), "sets")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))
    large = sets.groupBy(F.col("root").alias("group")).agg(F.sum("n").alias("total")).where(F.col("total") > block)
    if large.isEmpty():
        small, more = sets, None
    else:
        large = large.withColumn("part", salts)
        on = (F.col("root") == F.col("group")) & (F.col("salt") == F.col("part"))
        small, more = sets.join(large, on, "left_anti"), large_links(written(spark, sets.join(large, on, "left_semi"), "large"), percent, block)
    links = small.select("root", "id", "data").repartition(partitions(spark), "root").sortWithinPartitions("root").mapInArrow(compare, _LINK_SQL)
    return links if more is None else links.union(more)


def large_links(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """The links of loose groups too large for one task: ``sets`` (root, id, n, data, salt).

    All members are first compared with PIVOTS of them. Members that this connects to each other, most of them where a
    group is copies of one text, need no comparison among them; the rest of the group is cut into blocks, and all
    members stream past each block. So the work grows with members times blocks of the rest, memory stays at a block,
    and a row is sent once for each block.
    """
    spark = sets.sparkSession
    order = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("id"), "id"))
    chosen = sets.select("root", "id").withColumn("r", order).where(F.col("r") <= PIVOTS).select("root", "id")
    pivots = sets.join(chosen, ["root", "id"]).select("root", "id", "n", "data")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("salt")

    def with_pivots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(root, id, pivot): a pivot close to each member, and pivots that are connected."""

        def rows() -> Iterator[tuple]:
            at, index = None, None
            for b in it:
                for root, salt, kind, id_, data in zip(*(c.to_pylist() for c in b.columns)):
                    if (root, salt) != at:
                        at, index, ids, sets_, known = (root, salt), None, [], [], Union(PIVOTS)
                    found = np.frombuffer(data, np.uint64)
                    if kind == 0:
                        ids.append(id_)
                        sets_.append(found)
                        continue
                    index = index or Postings(sets_, np.arange(len(sets_)))
                    close = index.close_to(found, percent).tolist()
                    if close:
                        yield root, id_, ids[close[0]]
                        for k in close[1:]:
                            if known.join(close[0], k):
                                yield root, ids[k], ids[close[0]]

        yield from batches(rows(), pa.schema([("root", pa.int64()), ("id", pa.int64()), ("pivot", pa.int64())]), 50_000)

    both = pivots.select("root", salts, F.lit(0).alias("kind"), "id", "data").union(sets.select("root", "salt", F.lit(1).alias("kind"), "id", "data"))
    near = both.repartition(partitions(spark), "root", "salt").sortWithinPartitions("root", "salt", "kind").mapInArrow(with_pivots, "root long, id long, pivot long")
    near = written(spark, near, "near-pivots")

    def name_groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(root, pivot, name) of the pivots' components; a root has PIVOTS * SPREAD rows at most."""

        def rows() -> Iterator[tuple]:
            for root, held in _groups(it):
                number = {p: k for k, p in enumerate(sorted({x for pair in held for x in pair}))}
                known = Union(len(number))
                for a, b in held:
                    known.join(number[a], number[b])
                names = list(number)
                yield from ((root, p, names[known.root(k)]) for p, k in number.items())

        yield from batches(rows(), pa.schema([("root", pa.int64()), ("pivot", pa.int64()), ("name", pa.int64())]), 50_000)

    among = near.join(chosen, ["root", "id"], "left_semi").union(chosen.select("root", "id", F.col("id").alias("pivot"))).distinct()
    named = among.repartition(partitions(spark), "root").sortWithinPartitions("root").mapInArrow(name_groups, "root long, pivot long, name long")
    named = written(spark, named, "pivots")
    sizes = near.groupBy("root", "pivot").agg(F.countDistinct("id").alias("n")).join(named, ["root", "pivot"]).groupBy("root", "name").agg(F.sum("n").alias("n"))
    main = named.join(sizes.groupBy("root").agg(F.max_by("name", F.struct("n", "name")).alias("name")), ["root", "name"]).select("root", "pivot")
    settled = near.join(F.broadcast(main) if main.count() <= HOT_KEYS else main, ["root", "pivot"]).select("root", "id").distinct()
    marked = written(spark, sets.join(settled.withColumn("is_main", F.lit(True)), ["root", "id"], "left").withColumn("is_main", F.coalesce("is_main", F.lit(False))), "marked-sets")

    weights = marked.groupBy("root").agg(F.sum(F.when(~F.col("is_main"), F.col("n"))).alias("rest"))
    weights = weights.where("rest > 0").select(F.col("root").alias("group"), F.ceil(F.col("rest") / F.lit(max(block // 2, 1))).cast("long").alias("cuts"), salts.alias("part"))
    rows = marked.join(weights, (F.col("root") == F.col("group")) & (F.col("salt") == F.col("part")))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("cuts"))
    stream = rows.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"), "salt", F.lit(1).alias("kind"), "is_main", "id", "data")
    blocks = rows.where("NOT is_main").select("root", own.alias("cut"), salts, F.lit(0).alias("kind"), "is_main", "id", "data")

    def pass_by(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_() -> Iterator[tuple]:
            at, index = None, None
            for b in it:
                for root, cut, salt, kind, is_main, id_, data in zip(*(c.to_pylist() for c in b.columns)):
                    if (root, cut, salt) != at:
                        at, index, ids, sets_, place = (root, cut, salt), None, [], [], {}
                    found = np.frombuffer(data, np.uint64)
                    if kind == 0:
                        place[id_] = len(ids)
                        ids.append(id_)
                        sets_.append(found)
                        continue
                    if not ids:
                        continue
                    if index is None:
                        index, known = Postings(sets_, np.arange(len(sets_))), Union(len(sets_) + 1)  # the last is all that is main
                    close = index.close_to(found, percent).tolist()
                    me = len(ids) if is_main else place.get(id_)
                    for k in close:
                        if me is None:
                            me = k
                            yield id_, ids[k]
                        elif known.join(me, k):
                            yield id_, ids[k]

        yield from batches(rows_(), _LINK, 50_000)

    met = stream.union(blocks).repartition(partitions(spark), "root", "cut", "salt").sortWithinPartitions("root", "cut", "salt", "kind").mapInArrow(pass_by, _LINK_SQL)
    return near.select(F.col("id").alias("u"), F.col("pivot").alias("v")).union(met)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 85, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Links tie documents whose sets of ``width``-word shingles (words lower-cased for A-Z) have ``percent`` hundredths
    of their union in common. component_id is the least id reachable. Null and blank texts have empty sets and are
    linked with nothing; so are rows with a null id (component_id null, kept). Rows that repeat an id are one document.
    Ids are whole numbers, others raise TypeError; an empty table gives no rows; other columns are left out.
    """
    integral(docs, id_col)
    spark = docs.sparkSession
    seen = written(spark, profiles(docs, id_col, text_col, width, percent), "profiles")
    linked = seen.where("n_shingles > 0 AND id IS NOT NULL")
    nodes = linked.groupBy("set_hash").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n"))
    nodes = written(spark, nodes, "nodes")
    loose = components(loose_links(nodes.select("id", "signature"), far_for(chunks_for(percent)), bucket))
    close = exact_links(docs.where(column(id_col).isNotNull()), loose, id_col, text_col, width, percent, block)
    firsts = nodes.where("n > 1").select(F.col("set_hash").alias("hash"), F.col("id").alias("v"), "n")
    same = join_hot(linked.select("set_hash", F.col("id").alias("u")), "set_hash", firsts, "hash", "n", linked.count()).where("u != v").select("u", "v")
    found = components(close.union(same))
    out = seen.join(found, F.col("id") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the least id; columns as they came.

    Rows of null ids stay. Rows that repeat the id that stays, stay too. Null, blank and long texts and empty tables
    fare as in ``near_dedup``.
    """
    name = free_name(docs, "gone")
    gone = near_dedup(docs, id_col, text_col, width, percent).where("NOT kept").select(column(id_col).alias(name)).distinct()
    return docs.join(gone, column(id_col) == F.col(name), "left_anti")
