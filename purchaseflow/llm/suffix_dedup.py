"""Removal of long passages that an earlier document has, byte for byte, by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. To sort
suffixes on many machines, each window of ``length`` bytes is dealt by its least GRAM-byte hash: equal windows have
equal least hashes, so they meet in one class. Windows next to each other mostly share theirs, and such a run is
handled as one string (its context). Hashes only say who must meet; every removal rests on bytes. The stages:

1. scan: every text gives the class of each run, packed in blocks. A class that several rows of a block have is told
   to these rows right away, so of a hot class each block sends one entry;
2. meet: rows learn which of their classes another row has, and everybody which classes have too many contexts (HOT);
3. mark: texts meet what they were told and cut out the contexts in question. Of equal contexts of a block, those of
   later documents go and the first one stands for them. Runs of hot classes are cut into their single windows, each a
   class of its own, so no class grows with the corpus;
4. sort: equal contexts of a class are one string with its least document. Where a class has several strings they
   are suffix-sorted (linear grouping), and equal windows, now neighbours, get their least document;
5. cut: texts, with all other columns, meet the spans of steps 3 and 4.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, integral, partitions, portions, utf8, written
from .suffix_sort import suffix_array

GRAM = 20
#: Windows of a run at most; a context is then fully covered by its first and last window.
RUN = 50
#: Contexts of a class that one task may have to sort; beyond it, the class's windows are dealt singly.
HOT = 4096
#: Bytes of text that are hashed at once.
SLICE = 1 << 19
NOBODY = (1 << 63) - 1
_U = np.uint64
_LETTERS = np.array([int.from_bytes(hashlib.sha256(b"letter %d" % i).digest()[:8], "little") for i in range(256)], _U)
_BASE = np.array([0x9E3779B97F4A7C15], _U)
_M1, _M2 = _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_LOW, _TAG = _U((1 << 48) - 1), _U((1 << 32) - 1)
#: Runs that step 1 sends off together, and contexts that step 3 does.
BLOCK, HELD = 750_000, 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _M1
    return x ^ (x >> _U(29))


def window_hashes(letters: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Polynomial hashes of all windows of each size, by doubling."""
    powers = [(1, letters, _BASE)]
    while powers[-1][0] * 2 <= max(sizes):
        k, h, m = powers[-1]
        powers.append((2 * k, h[: len(h) - k] * m + h[k:], m * m))
    out = []
    for size in sizes:
        whole, done = None, 0
        for k, h, m in powers:
            if size & k:
                if whole is None:
                    whole, done = h, k
                else:
                    n = len(letters) - done - k + 1
                    whole, done = whole[:n] * m + h[done : done + n], done + k
        out.append(whole)
    return out


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


@dataclass
class Runs:
    """Runs of windows with one least gram: begin and end (first and last window's start) in their text, by text."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    gram: np.ndarray
    code: np.ndarray
    hashes: np.ndarray
    start: np.ndarray

    def gram_places(self, which: np.ndarray, length: int) -> np.ndarray:
        """Where the least gram stands in the contexts of the runs ``which``; -1 where it has more than one place."""
        n = self.end[which] - self.begin[which] + length - min(GRAM, length) + 1
        first = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(first, n)
        seen = np.flatnonzero(self.hashes[np.repeat(self.start[which], n) + inside] == np.repeat(self.gram[which], n))
        at = np.searchsorted(seen, first)
        once = np.append(at[1:], len(seen)) - at == 1
        return np.where(once, inside[seen[np.minimum(at, len(seen) - 1)]], -1) if len(seen) else np.full(len(which), -1)


def find_runs(texts: list[bytes], length: int) -> Runs:
    """The runs of all texts, in order. Texts shorter than a window have none."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    if not len(sizes) or sizes.max() < length:
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none.astype(_U), none.astype(_U), none.astype(_U), none)
    starts = np.cumsum(sizes) - sizes
    grams, windows = window_hashes(_LETTERS[flat], (min(GRAM, length), length))
    hashes = _mix(grams)
    least = least_in(hashes, length - min(GRAM, length) + 1)
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    local = np.arange(len(owner)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0))
    at = starts[owner] + local
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (local[1:] == 0)
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    new |= (np.arange(len(at)) - first[number]) % RUN == 0
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    code = _mix(_mix(windows[at[first]]) * _M2 + windows[at[last]]) + (last - first).astype(_U)
    return Runs(owner[first], local[first], local[last], least[first], _mix(code), hashes, at[first])


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of texts of about SLICE bytes."""
    size, begin = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield begin, k + 1
            size, begin = 0, k + 1
    if begin < len(texts):
        yield begin, len(texts)


def order_of(doc: int | None) -> int:
    """Null ids come after all others and own nothing."""
    return NOBODY if doc is None else doc


def packed(*arrays: np.ndarray) -> bytes:
    """The arrays end to end, each after its number of values: a byte, or 255 and eight bytes, as most blobs are small."""
    return b"".join((bytes([len(a)]) if len(a) < 255 else b"\xff" + struct.pack("<q", len(a))) + a.tobytes() for a in arrays)


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n, at = blob[at], at + 1
        if n == 255:
            (n,) = struct.unpack_from("<q", blob, at)
            at += 8
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _dealt(classes: np.ndarray, parts: int) -> np.ndarray:
    return ((classes >> _U(40)) * _U(0x9E3779B1) % _U(parts)).astype(np.int64)


def _home(tags: np.ndarray, parts: int) -> np.ndarray:
    """The part where a row's text is, by the low half of its key, its tag."""
    return (tags % _U(parts)).astype(np.int64)


#: Kinds of the rows that stages send each other. Within a part, lesser kinds come first.
CLASSES, HOTS, TOLD, GONE, CONTEXTS, TEXT = range(6)
_BLOB = pa.schema([("target", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_BLOB_SQL = "target int, kind int, blob binary"


class Blobs:
    """Rows (target, kind, blob), sent on in Arrow batches of bounded size."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, bytes]] = []
        self.load = 0

    def add(self, target: int, kind: int, blob: bytes) -> None:
        self.rows.append((target, kind, blob))
        self.load += len(blob) + 40

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or self.load > 8 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), _BLOB.types)], schema=_BLOB)
            self.rows, self.load = [], 0


def _number(parts: int) -> str:
    """The type of a part's number."""
    return "<u2" if parts < 1 << 16 else "<u4"


def _grouped(by: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of equal neighbours."""
    heads = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.empty(0, np.int64)
    return zip(heads.tolist(), np.append(heads, len(by))[1:].tolist())


def _stretches(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of stretches of ``n``, one after the other."""
    return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)


def _split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit numbers as four and two bytes."""
    return values.astype("<u4"), (values >> _U(32)).astype("<u2")


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(_U) | high.astype(_U) << _U(32)


def _runs_of(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours that are equal as (value, how often), at most 65,535 each."""
    if not len(tags):
        return tags.astype("<u4"), np.empty(0, "<u2")
    new = np.append(True, tags[1:] != tags[:-1])
    first = np.flatnonzero(new)
    new |= (np.arange(len(tags)) - first[np.cumsum(new) - 1]) % 65535 == 0
    first = np.flatnonzero(new)
    return tags[first].astype("<u4"), np.diff(np.append(first, len(tags))).astype("<u2")


def _tell(out: Blobs, tag: np.ndarray, gram: np.ndarray, parts: int) -> None:
    """Blobs for the homes: of each row (tag) the low halves of the classes that another row has. A tag or half that
    happens to stand for two things only makes a context travel for nothing."""
    pair = np.unique(tag << _U(32) | gram & _TAG)
    tag, gram = pair >> _U(32), pair & _TAG
    home = _home(tag, parts)
    by = np.argsort(home, kind="stable")
    tag, gram, home = tag[by], gram[by], home[by]
    at = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else ()
    for a, z in zip(at, np.append(at, len(home))[1:]):
        out.add(int(home[a]), TOLD, packed(*_runs_of(tag[a:z]), gram[a:z].astype("<u4")))


def _scan(length: int, parts: int):
    """Step 1. A blob for each part: the classes (48 bits) that one row of this block has, with its tag, and those that
    several have, with the number of their contexts and the homes of their rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blobs()
        held: list[tuple[np.ndarray, ...]] = []
        tags: list[int] = []

        def flush() -> None:
            gram, code, row = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, _U),) * 3
            held.clear()
            if not len(gram):
                return
            by = np.lexsort((code, gram))
            gram, code, row = gram[by], code[by], row[by]
            tag = np.array(tags, _U)[row]
            new = np.append(True, gram[1:] != gram[:-1])
            heads = np.flatnonzero(new)
            contexts = np.add.reduceat((new | np.append(True, code[1:] != code[:-1])).astype(np.int64), heads)
            several = np.minimum.reduceat(row, heads) != np.maximum.reduceat(row, heads)
            size = np.diff(np.append(heads, len(gram)))
            hit = np.repeat(several, size)
            _tell(out, tag[hit], gram[hit], parts)
            many, contexts = gram[heads[several]], contexts[several]
            pair = np.unique(np.repeat(np.arange(len(many)), size[several]) << 32 | _home(tag[hit], parts))
            n_homes, homes = np.bincount(pair >> 32, minlength=len(many)), pair & 0xFFFFFFFF
            gram, tag = gram[heads[~several]], tag[heads[~several]]
            part, part_many = _dealt(gram, parts), _dealt(many, parts)
            by, by_many = np.lexsort((tag, part)), np.argsort(part_many, kind="stable")
            gram, tag, part, many, contexts, part_many = gram[by], tag[by], part[by], many[by_many], contexts[by_many], part_many[by_many]
            homes = homes[_stretches((np.cumsum(n_homes) - n_homes)[by_many], n_homes[by_many])]
            n_homes = n_homes[by_many]
            before = np.append(0, np.cumsum(n_homes))
            targets = np.union1d(part, part_many)
            cuts, cuts_many = (np.searchsorted(x, [targets, targets + 1]).T.tolist() for x in (part, part_many))
            for p, (a, z), (b, y) in zip(targets.tolist(), cuts, cuts_many):
                where = homes[before[b] : before[y]].astype(_number(parts))
                out.add(p, CLASSES, packed(*_split(gram[a:z] & _LOW), *_runs_of(tag[a:z]), *_split(many[b:y] & _LOW), contexts[b:y].astype("<u4"), n_homes[b:y].astype(_number(parts)), where))

        for b in portions(it):
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in slices(texts):
                runs = find_runs(texts[a:z], length)
                held.append((runs.gram, runs.code, runs.text + len(tags)))
                tags += [k & 0xFFFFFFFF for k in keys[a:z]]
                if sum(len(h[0]) for h in held) > BLOCK:
                    flush()
                    tags.clear()
                yield from out.batches()
        flush()
        yield from out.batches(last=True)

    return run


def _meet(parts: int, hot: int):
    """Step 2. TOLD blobs for homes, those of step 1 as they came; and for each home those of its rows' classes that have more than ``hot`` contexts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blobs()
        by_part: dict[int, list[list[np.ndarray]]] = defaultdict(list)
        for b in it:
            for part, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
                if kind == TOLD:
                    out.add(part, TOLD, blob)
                else:
                    by_part[part].append(unpacked(blob, "<u4", "<u2", "<u4", "<u2", "<u4", "<u2", "<u4", _number(parts), _number(parts)))
            yield from out.batches()
        for part in list(by_part):
            low, high, tag, n, low_many, high_many, contexts, n_homes, homes = (np.concatenate(x) for x in zip(*by_part.pop(part)))
            gram, tag = np.append(_joined(low, high), _joined(low_many, high_many)), np.repeat(tag, n).astype(_U)
            weight = np.append(np.ones(len(tag), np.int64), contexts.astype(np.int64))
            single = np.arange(len(gram)) < len(tag)
            by = np.argsort(gram, kind="stable")
            gram, weight, single, place = gram[by], weight[by], single[by], by
            heads = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            shared = np.add.reduceat(np.where(single, 1, 2), heads) > 1
            size = np.diff(np.append(heads, len(gram)))
            hit = np.repeat(shared, size) & single
            _tell(out, tag[place[hit]], gram[hit], parts)
            too_many = np.repeat((np.add.reduceat(weight, heads) > hot) & shared, size)
            alone, several = too_many & single, too_many & ~single
            which = place[several] - len(tag)
            n_homes = n_homes.astype(np.int64)
            told = np.append(_home(tag[place[alone]], parts), homes[_stretches((np.cumsum(n_homes) - n_homes)[which], n_homes[which])].astype(np.int64))
            many = np.append(gram[alone], np.repeat(gram[several], n_homes[which]))
            by = np.lexsort((many, told))
            told, many = told[by], many[by]
            for a, z in _grouped(told):
                out.add(int(told[a]), HOTS, packed(*_split(np.unique(many[a:z]))))
                yield from out.batches()
            yield from out.batches()
        yield from out.batches(last=True)

    return run


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the bytes in [begin, end); touching ones join."""
    if not len(begin):
        return begin, end
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    heads = np.flatnonzero(new)
    return begin[heads], end[np.append(heads[1:], len(begin)) - 1]


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _gone(out: Blobs, key: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, parts: int) -> None:
    """Blobs for the homes: spans to remove, with key and id (its low half) of their row."""
    home = _home(key.astype(_U) & _TAG, parts)
    by = np.lexsort((begin, key, home))
    key, doc, begin, end, home = key[by], (doc & 0xFFFFFFFF).astype("<u4")[by], begin.astype("<i4")[by], end.astype("<i4")[by], home[by]
    at = np.flatnonzero(np.append(True, home[1:] != home[:-1])) if len(home) else ()
    for a, z in zip(at, np.append(at, len(home))[1:]):
        out.add(int(home[a]), GONE, packed(key[a:z].astype("<i8"), doc[a:z], begin[a:z], end[a:z]))


class Held:
    """Contexts of a block of texts, each string once, with the places where it stands."""

    def __init__(self, length: int, parts: int) -> None:
        self.length, self.parts = length, parts
        self.docs: list[int] = []
        self.keys: list[int] = []
        self.strings: dict[bytes, int] = {}
        self.classes: list[int] = []
        self.places: list[int] = []
        self.which: list[int] = []  # of each place: string, text, begin
        self.owner: list[int] = []
        self.begin: list[int] = []
        self.load = 0

    def add(self, texts: list[bytes], docs: list[int], keys: list[int], told: np.ndarray, hot: np.ndarray) -> None:
        runs = find_runs(texts, self.length)
        tag = np.array(keys, np.int64).astype(_U)[runs.text] & _TAG
        shared = np.flatnonzero(_within(tag << _U(32) | runs.gram & _TAG, told))
        single = _within(runs.gram[shared] & _LOW, hot)
        base = len(self.docs)
        calm = shared[~single]
        strings, classes, places = self.strings, self.classes, self.places
        which = []
        begin, owner = runs.begin[calm].tolist(), runs.text[calm]
        for k, a, z, g, p in zip(owner.tolist(), begin, (runs.end[calm] + self.length).tolist(), runs.gram[calm].tolist(), runs.gram_places(calm, self.length).tolist()):
            i = strings.setdefault(texts[k][a:z], len(classes))
            if i == len(classes):
                classes.append(g)
                places.append(p)
            which.append(i)
        self.which += which
        self.begin += begin
        self.owner += (owner + base).tolist()
        for r in shared[single].tolist():
            k = int(runs.text[r])
            for a in range(int(runs.begin[r]), int(runs.end[r]) + 1):
                s = texts[k][a : a + self.length]
                i = strings.setdefault(s, len(classes))
                if i == len(classes):
                    classes.append(xxhash.xxh3_64_intdigest(s))
                    places.append(-1)
                self.which.append(i)
                self.begin.append(a)
                self.owner.append(base + k)
        self.docs += docs
        self.keys += keys
        self.load = len(self.docs) // 20 + len(self.which)

    def settle(self, out: Blobs, pack: zstandard.ZstdCompressor) -> None:
        """GONE where a context of a lesser document stands in this block too; CONTEXTS of those that have the least."""
        doc, key = np.array(self.docs, np.int64), np.array(self.keys, np.int64)
        which, owner, begin = (np.array(x, np.int64) for x in (self.which, self.owner, self.begin))
        size = np.array([len(s) for s in self.strings], np.int64)
        least = np.full(len(size), NOBODY)
        np.minimum.at(least, which, doc[owner])
        gone = doc[owner] > least[which]
        at = (owner[gone] << 32) + begin[gone]
        start, stop = merged(at, at + size[which[gone]])
        o = start >> 32
        _gone(out, key[o], doc[o], start - (o << 32), stop - (o << 32), self.parts)
        which, owner, begin = which[~gone], owner[~gone], begin[~gone]
        classes, places = np.array(self.classes, "<u8"), np.array(self.places, "<i4")
        part = _dealt(classes, self.parts)[which]
        by = np.argsort(part, kind="stable")
        strings = list(self.strings)
        heads = np.flatnonzero(np.append(True, part[by][1:] != part[by][:-1])) if len(by) else ()
        for a, z in zip(heads, np.append(heads, len(by))[1:]):
            r = by[a:z]
            w, o = which[r], owner[r]
            flat = np.frombuffer(b"".join([strings[i] for i in w.tolist()]), np.uint8)
            out.add(int(part[r[0]]), CONTEXTS, pack.compress(packed(classes[w], key[o], doc[o], begin[r].astype("<i4"), places[w], size[w].astype("<i4"), flat)))


def _mark(length: int, parts: int):
    """Step 3. A task has its part sorted by kind, so what texts are told is read before them. Rows: target, kind, blob, doc, key."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, out = zstandard.ZstdCompressor(level=3), Blobs()
        told, hot = np.empty(0, _U), np.empty(0, _U)
        more_told: list[np.ndarray] = []
        more_hot: list[np.ndarray] = []
        held = Held(length, parts)
        for b in portions(it):
            texts, rows = [], []
            for k, (kind, blob) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if kind == TEXT:
                    rows.append(k)
                    texts.append(blob)
                elif kind == TOLD:
                    tag, n, gram = unpacked(blob, "<u4", "<u2", "<u4")
                    more_told.append(np.repeat(tag, n).astype(_U) << _U(32) | gram.astype(_U))
                else:
                    more_hot.append(_joined(*unpacked(blob, "<u4", "<u2")))
            if not rows:
                continue
            if more_told:
                told = np.unique(np.concatenate([told, *more_told]))
                more_told.clear()
            if more_hot:
                hot = np.unique(np.concatenate([hot, *more_hot]))
                more_hot.clear()
            side = pa.array(rows, pa.int64())
            docs, keys = [order_of(d) for d in b.column(3).take(side).to_pylist()], b.column(4).take(side).to_pylist()
            for a, z in slices(texts):
                held.add(texts[a:z], docs[a:z], keys[a:z], told, hot)
                if held.load > HELD:
                    held.settle(out, pack)
                    held = Held(length, parts)
                yield from out.batches()
        held.settle(out, pack)
        yield from out.batches(last=True)

    return run


def owners(strings: list[bytes], docs: list[int], length: int) -> list[np.ndarray]:
    """For each window of each string the least document of any equal window among the strings.

    The strings stand end to end, each with the least letter after it; in the order of their suffixes equal windows
    are neighbours, and one pass over the order gathers their least document.
    """
    text: list[int] = []
    valid: list[int] = []
    begins = []
    for k, s in enumerate(strings):
        begins.append(len(text))
        text += s
        text.append(-1)
        valid += [k] * (len(s) - length + 1) + [-1] * length
    whole = b"\0".join(strings)
    text[-1] = -2
    least = [0] * len(text)
    group: list[int] = []
    best, now = 0, None
    for s in suffix_array(text):
        k = valid[s]
        if k < 0:
            continue
        window = whole[s : s + length]
        if window != now:
            for x in group:
                least[x] = best
            group, best, now = [], docs[k], window
        elif docs[k] < best:
            best = docs[k]
        group.append(s)
    for x in group:
        least[x] = best
    return [np.array(least[b : b + len(s) - length + 1], np.int64) for b, s in zip(begins, strings)]


def trimmed(strings: list[tuple[bytes, int]], length: int) -> list[tuple[int, int]]:
    """Begin and end of what can be in an equal window of each of the distinct contexts (text, place of the gram) of a class.

    A window has ``length`` bytes and holds the gram, so of what stands before the gram in it and what stands after it
    one has ``side`` bytes at least. Where no other context has the same ``side`` bytes before its gram, equal windows
    reach less far to the left, and likewise to the right; contexts left too short for a window are (0, 0).
    """
    gram = min(GRAM, length)
    side = (length - gram + 1) // 2
    if side == 0 or any(p < 0 for _, p in strings):
        return [(0, len(s)) for s, _ in strings]
    before: dict[bytes, int] = defaultdict(int)
    after: dict[bytes, int] = defaultdict(int)
    for s, p in strings:
        if p >= side:
            before[s[p - side : p]] += 1
        if len(s) >= p + gram + side:
            after[s[p + gram : p + gram + side]] += 1
    out = []
    for s, p in strings:
        a = 0 if p >= side and before[s[p - side : p]] > 1 else max(0, p - side + 1)
        z = len(s) if len(s) >= p + gram + side and after[s[p + gram : p + gram + side]] > 1 else min(len(s), p + gram + side - 1)
        out.append((a, z) if z - a >= length else (0, 0))
    return out


def _sort(length: int, parts: int):
    """Step 4. GONE blobs for the homes, those of step 3 as they came."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out = zstandard.ZstdDecompressor(), Blobs()
        got = []
        for b in it:
            for target, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
                if kind == GONE:
                    out.add(target, GONE, blob)
                else:
                    got.append(unpacked(unpack.decompress(blob), "<u8", "<i8", "<i8", "<i4", "<i4", "<i4", "u1"))
            yield from out.batches()
        if not got:
            yield from out.batches(last=True)
            return
        *columns, flat = zip(*got)
        kind, key, doc, begin, place, size = (np.concatenate(x) for x in columns)
        data, end = b"".join(flat), np.cumsum(size, dtype=np.int64)
        del got, columns, flat
        by = np.argsort(kind, kind="stable")
        heads = np.flatnonzero(np.append(True, kind[by][1:] != kind[by][:-1]))
        n = np.diff(np.append(heads, len(by)))
        by, n = by[np.repeat(n > 1, n)], n[n > 1]  # a class with one context has nothing to meet
        key, doc, begin, place, size, end = (x[by].tolist() for x in (key, doc, begin, place, size, end))
        found: list[tuple[int, int, int, int]] = []

        def send() -> None:
            if found:
                _gone(out, *(np.array(x, np.int64) for x in zip(*found)), parts)
                found.clear()

        at = 0
        for many in n.tolist():
            strings: dict[bytes, list[int]] = {}
            for r in range(at, at + many):
                strings.setdefault(data[end[r] - size[r] : end[r]], []).append(r)
            at += many
            least = {}
            for s, rows in strings.items():
                least[s] = d = min(doc[r] for r in rows)
                if len(rows) > 1:
                    found += [(key[r], doc[r], begin[r], begin[r] + len(s)) for r in rows if doc[r] > d]
            if len(strings) > 1:
                cuts = trimmed([(s, place[rows[0]]) for s, rows in strings.items()], length)
                kept: dict[bytes, int] = {}
                for (s, d), (a, z) in zip(least.items(), cuts):
                    if z:
                        kept[s[a:z]] = min(d, kept.get(s[a:z], d))
                if not kept:
                    continue
                firsts = dict(zip(kept, owners(list(kept), list(kept.values()), length))) if len(kept) > 1 else {s: np.full(len(s) - length + 1, d) for s, d in kept.items()}
                for (s, rows), (a, z) in zip(strings.items(), cuts):
                    if z:
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], firsts[s[a:z]] < least[s], [False]]).astype(np.int8))).tolist()
                        found += [(key[r], doc[r], begin[r] + a + b, begin[r] + a + y - 1 + length) for b, y in zip(edge[::2], edge[1::2]) for r in rows if doc[r] == least[s]]
            if len(found) > 500_000:
                send()
                yield from out.batches()
        send()
        yield from out.batches(last=True)

    return run


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
_SPANS_SQL = "array<struct<begin:int,end:int>>"


def kept_text(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its spans, these narrowed to whole characters."""
    at, out = 0, []
    for begin, end in spans:
        while begin < len(data) and data[begin] & 0xC0 == 0x80:
            begin += 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:begin])
        at = max(begin, end)
    return b"".join([*out, data[at:]])


def _cut(as_text: bool):
    """Step 5. (data, spans, row) of texts, or (text, row), from rows (target, kind, blob, doc, key, row) sorted by target
    and kind. Both are made here, as a second pass over the rows would need twice as many Python workers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: dict[tuple[int, int], list[np.ndarray]] = defaultdict(list)
        for b in portions(it):
            blobs, rows = b.column(2), []
            for k, kind in enumerate(b.column(1).to_pylist()):
                if kind == TEXT:
                    rows.append(k)
                    continue
                key, doc, begin, end = unpacked(blobs[k].as_py(), "<i8", "<u4", "<i4", "<i4")
                by = np.lexsort((doc, key))
                key, doc, both = key[by], doc[by], np.stack([begin[by], end[by]])
                heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
                for h, z, k_, d in zip(heads.tolist(), np.append(heads[1:], len(by)).tolist(), key[heads].tolist(), doc[heads].tolist()):
                    said[k_, d].append(both[:, h:z])
            if not rows:
                continue
            side = pa.array(rows, pa.int64())
            spans = []
            for doc, key in zip(b.column(3).take(side).to_pylist(), b.column(4).take(side).to_pylist()):
                found = said.get((key, order_of(doc) & 0xFFFFFFFF))
                spans.append(list(zip(*(x.tolist() for x in merged(*np.concatenate(found, axis=1))))) if found else [])
            data, row = blobs.take(side), b.column(5).take(side)
            if as_text:
                texts = pa.array([kept_text(x.as_py(), found) for x, found in zip(data, spans)], pa.binary())
                yield pa.RecordBatch.from_arrays([texts.cast(pa.string()), row], names=["text", "row"])
            else:
                yield pa.RecordBatch.from_arrays([data, pa.array([[{"begin": a, "end": z} for a, z in found] for found in spans], _SPANS), row], names=["data", "spans", "row"])

    return run


def _spans(docs: DataFrame, id_col: str, text_col: str, names: list[str], length: int, parts: int | None, hot: int, as_text: bool) -> DataFrame:
    """(data binary, spans, row struct) of every row: its UTF-8 bytes, the maximal runs to remove, its columns ``names``;
    or (text, row), what is left.

    A row is named by 64 bits of its id and text and, again, by its id; rows equal in both fare alike."""
    integral(docs, id_col)
    parts = parts or partitions(docs.sparkSession)
    rows = docs.select(column(id_col).cast("long").alias("doc"), utf8(column(text_col)).alias("data"), F.struct(*(column(c).alias(c) for c in names)).alias("row"))
    rows = rows.withColumn("key", F.xxhash64("doc", "data"))
    side = rows.schema["row"].dataType
    nothing = {"doc": F.lit(None).cast("long"), "key": F.lit(None).cast("long"), "row": F.lit(None).cast(side)}
    home = F.pmod(F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(parts)).cast("int")

    def at_home(blobs: DataFrame, *more: str) -> DataFrame:
        """Blobs together with the texts that they are for, texts last."""
        texts = rows.select(home.alias("target"), F.lit(TEXT).alias("kind"), F.col("data").alias("blob"), *more)
        both = blobs.select("target", "kind", "blob", *(nothing[c].alias(c) for c in more)).union(texts)
        return both.repartitionById(parts, "target").sortWithinPartitions("target", "kind")

    met = rows.select("key", "data").mapInArrow(_scan(length, parts), _BLOB_SQL).repartitionById(parts, "target").mapInArrow(_meet(parts, hot), _BLOB_SQL)
    contexts = at_home(met, "doc", "key").mapInArrow(_mark(length, parts), _BLOB_SQL).repartitionById(parts, "target")
    gone = written(docs.sparkSession, contexts.mapInArrow(_sort(length, parts), _BLOB_SQL), "gone")
    return at_home(gone, "doc", "key", "row").mapInArrow(_cut(as_text), StructType.fromDDL("text string" if as_text else f"data binary, spans {_SPANS_SQL}").add("row", side))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """(id, data binary, spans array<struct<begin,end>>) of every row: its UTF-8 bytes and the maximal runs to remove.

    Ids are whole numbers (others raise TypeError). Null text counts as empty. Null ids come after all others. Rows
    with the same id never remove from each other. Extra columns are left out, whatever their names. Texts shorter
    than ``length`` bytes keep all. An empty table gives no rows.
    """
    found = _spans(docs, id_col, text_col, [id_col], length, parts, hot, as_text=False)
    return found.select(F.col("row")[id_col].alias(id_col), "data", "spans")


def remaining(data: Column, spans: Column) -> Column:
    """The bytes that no span covers, in order."""
    begins = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["begin"]), F.array(F.length(data)))
    return F.aggregate(F.zip_with(begins, ends, lambda a, z: F.substring(data, a + 1, z - a)), F.lit(b""), lambda acc, x: F.concat(acc, x))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, parts: int | None = None, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` with their columns, their text without the passages that a document with a smaller id has.

    A span that begins or ends inside a UTF-8 character is narrowed to whole characters. Null text becomes empty text.
    All else is as in ``repeated_spans``; the other columns travel with the text and come out as they came.
    """
    others = [c for c in docs.columns if c != text_col]
    cut = _spans(docs, id_col, text_col, others, length, parts, hot, as_text=True)
    return cut.select(*((F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns))
