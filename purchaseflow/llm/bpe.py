"""Byte-pair encoding by backtracking, and decoding by an offset table.

The encoder takes at each position the longest vocabulary token (found by an Aho-Corasick automaton) and accepts it
only if the merges would really leave the previous token and this one side by side; else it tries the next shorter
prefix token, and steps back where none fits. A position found dead is marked, so each is left once and the work is
linear. The result is that of merging pair by pair in rank order.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import column, portions, utf8

#: Entries of each of a task's caches (chunks, words, token pairs); beyond it a cache starts anew.
CACHE_WORDS = 200_000


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte: printable Latin-1 letters stand for
    themselves, and the other bytes, in order, get the letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in printable}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A BPE vocabulary file in JSON (``model.vocab``, ``model.merges``, ``added_tokens``) with an end-of-word suffix.

    Inside, a token is a string over 512 symbols: byte b as chr(b), and chr(256 + b) where it ends a word.
    """

    def __init__(self, data: str) -> None:
        parsed = json.loads(data)
        model = parsed["model"]
        self.suffix: str = model["end_of_word_suffix"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.words = regex.compile(parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        def inner(token: str) -> str:
            ends = token.endswith(self.suffix)
            codes = [byte_of[c] for c in (token[: -len(self.suffix)] if ends else token)]
            return "".join(map(chr, codes[:-1])) + chr(codes[-1] + 256 * ends)

        self.token = {i: inner(t) for t, i in ids.items()}
        of = {s: i for i, s in self.token.items()}
        self.length = {i: len(s) for i, s in self.token.items()}
        self.rank: dict[int, int] = {i: -1 for i in self.token}
        self.parts = {i: (i, i) for i in self.token}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            x, y = ids[a], ids[b]
            z = of[self.token[x] + self.token[y]]
            self.merge[x, y] = z
            if self.rank[z] < 0:
                self.rank[z], self.parts[z] = rank, (x, y)
        self.automaton = ahocorasick.Automaton()
        for s, i in of.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.shorter = {i: next((of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in of), None) for i, s in self.token.items()}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging in rank order can leave ``left`` and ``right`` as neighbours.

        The tokens are taken apart again in reverse order of their merges; at no time may the two pieces that touch
        have a merge that would have come before the merge just undone.
        """
        pair = left << 32 | right
        if (known := self.fits.get(pair)) is not None:
            return known
        a, b, before, out = left, right, 1 << 60, True
        while True:
            joined = self.merge.get((a, b))
            if joined is not None and self.rank[joined] < before:
                out = False
                break
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # of equal merges the left one came first, so the right one is undone first
                before, a = ra, self.parts[a][1]
            else:
                before, b = rb + 1, self.parts[b][0]
        if len(self.fits) >= CACHE_WORDS:
            self.fits.clear()
        self.fits[pair] = out
        return out

    def longest(self, text: str, at: int) -> int:
        return next(self.automaton.iter_long(text, at))[1]

    def encode_word(self, data: bytes) -> list[int]:
        """Token ids of one word (UTF-8, not empty)."""
        text = data[:-1].decode("latin-1") + chr(256 + data[-1])
        size, alive, out, at = len(text), bytearray(b"\x01") * (len(text) + 1), [], 0
        following: int | None = self.longest(text, 0)
        while following is not None:
            token, last = following, out[-1] if out else None
            while True:
                end = at + self.length[token]
                if alive[end] and (last is None or self.compatible(last, token)):
                    out.append(token)
                    at = end
                    following = self.longest(text, end) if end < size else None
                    break
                token = self.shorter[token]
                if token is None:
                    alive[at] = 0
                    out.pop()
                    at -= self.length[last]
                    following = last
                    break
        return out

    def encode_plain(self, text: str) -> bytes:
        """Packed ids of a text without special tokens: NFC, lower case letter by letter, words by the file's pattern."""
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return b"".join([self.known.get(w) or self.learn(w) for w in self.words.findall(text)])

    def learn(self, word: str) -> bytes:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        out = pack(self.encode_word(word.encode()))
        if len(word) <= 64:
            self.known[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; the strings of special tokens stand for these, as in the files' own library."""
        if self.cut is None or not any(t in text for t in self.special):
            return self.encode_plain(text)
        return b"".join(pack([self.special[part]]) if k % 2 else self.encode_plain(part) for k, part in enumerate(self.cut.split(text)))


def pack(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class OffsetTable:
    """The strings of all tokens, special ones too, end to end, and where each begins."""

    def __init__(self, data: str) -> None:
        parsed = json.loads(data)
        texts = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
        pieces = [texts.get(i, "").encode() + b" " for i in range(max(texts) + 1)]
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' own strings with one space between, gathered through the offset table."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        place = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        place += np.arange(ends[-1])
        return self.bytes[place].tobytes()[:-1]


class Chunks(dict):
    """The packed ids of each chunk (a run without white space; no token crosses white space), in a bounded cache."""

    def __init__(self, vocabulary: Vocabulary, most: int = CACHE_WORDS) -> None:
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self.vocabulary.encode(chunk.decode())
        if len(chunk) <= 64:
            self[chunk] = out
        return out


class Encoder:
    """Encodes whole texts (UTF-8) to arrays of ids."""

    def __init__(self, vocabulary: Vocabulary, most: int = CACHE_WORDS) -> None:
        self.packed = Chunks(vocabulary, most).__getitem__

    def encode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.packed, data.split())), dtype=np.int32)


@lru_cache(2)
def _load(kind: type, digest: str, path: str) -> Vocabulary | OffsetTable:
    with open(path, encoding="utf-8") as f:
        return kind(f.read())


def _shipped(spark: SparkSession, path: str) -> tuple[str, str]:
    """Sends the vocabulary file to the executors; its name there and a digest of it."""
    with open(path, "rb") as f:
        digest = hashlib.sha1(f.read()).hexdigest()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1], digest


def _tokens(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    name, digest = _shipped(docs.sparkSession, vocabulary)
    schema = StructType().add("id", docs.schema[id_col].dataType).add("ids", ArrayType(IntegerType()))
    schema = schema.add("text", "string") if decoded else schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_load(Vocabulary, digest, SparkFiles.get(name)))
        table = _load(OffsetTable, digest, SparkFiles.get(name)) if decoded else None
        for b in portions(it, 512):
            rows = [encoder.encode(x.as_py()) for x in b.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32())
            out = [b.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)]
            if table:
                out.append(pa.array(map(table.decode, rows), pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(column(id_col).alias("id"), utf8(column(text_col)).alias("data")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each whole text, without a shuffle. ``vocabulary`` is a file's path on the driver.

    Null counts as empty and gives no ids; repeated rows are encoded each; ids pass through, null or not. Long texts are
    encoded whole, 512 rows at a time; other columns are left out, whatever their names. An empty table gives no rows.
    """
    return _tokens(docs, vocabulary, id_col, text_col, False)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text): what ``decode`` gives of ``encode``'s rows, in one pass, so that ids leave the task once."""
    return _tokens(docs, vocabulary, id_col, text_col, True)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text) of rows with token ids; special tokens are kept. Null ids count as none. Ids outside the
    vocabulary raise an error, as nothing can be said for them. An empty table gives no rows."""
    name, digest = _shipped(encoded.sparkSession, vocabulary)
    schema = StructType().add("id", encoded.schema[id_col].dataType).add("ids", ArrayType(IntegerType())).add("text", "string")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _load(OffsetTable, digest, SparkFiles.get(name))
        for b in it:
            lists = b.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [table.decode(flat[a:z]) for a, z in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=schema.names)

    rows = encoded.select(column(id_col).alias("id"), F.coalesce(column(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
