"""Toxicity by subword bags: a word is the mean of its character n-grams' vectors, a text the mean of its words', and a
linear softmax over that mean is trained jointly with the vectors.

The fit reads a bounded sample of labelled rows (``SAMPLE``, half of it for either label, by a hash of the id). Tasks count
in how many texts of either label each n-gram occurs; n-grams that don't depend on the label get no vector, so rare ones can't
be learned by heart. What the tasks send to the driver is a sparse row for each text of the sample. The softmax is
linear in the mean, so for scoring all vectors become one number for each n-gram, which an automaton finds in a word in one
pass; a misspelling that was never seen shares most n-grams with what was.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, portions, written

#: Labelled rows that a fit reads at most.
SAMPLE = 6_000
#: n-grams with vectors at most, and the numbers of a vector.
GRAMS, DIM = 1024, 4
SHORTEST, LONGEST = 3, 6
#: Standard errors by which an n-gram's share of texts must differ between the labels.
FAR = 4.0
EPOCHS, RATE, DECAY, SCALE = 150, 0.02, 1e-6, 50.0


def grams(word: str) -> set[str]:
    """A word's distinct n-grams, edges and the whole word included."""
    edged = f"<{word}>"
    return {edged[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(edged) - n + 1)} | {edged}


def bag(text: str | None) -> list[str]:
    """The distinct lower-cased words of a text, in order of their first occurrence."""
    return list(dict.fromkeys((text or "").lower().split()))


@dataclass(frozen=True)
class Model:
    """``kept``: sorted n-grams that have vectors; ``vectors``: theirs; ``weights`` and ``bias`` of the softmax over labels 0 and 1."""

    kept: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def vector(self, word: str) -> np.ndarray:
        """The mean over all n-grams of a word; those without a vector count as zero."""
        own = grams(word)
        return self.vectors[[k for k, g in enumerate(self.kept) if g in own]].sum(0) / len(own)

    def probability(self, text: str | None) -> float:
        """Of label 1; the plain form of what ``score`` computes."""
        words = bag(text)
        mean = sum((self.vector(w) for w in words), np.zeros(self.vectors.shape[1])) / max(1, len(words))
        z = SCALE * mean @ self.weights + self.bias
        e = np.exp(z - z.max())
        return float(e[1] / e.sum())

    def slopes(self) -> dict[str, float]:
        """What each n-gram adds to the difference of the two labels' logits."""
        each = SCALE * self.vectors @ (self.weights[:, 1] - self.weights[:, 0])
        return dict(zip(self.kept, each.tolist(), strict=True))


def held_out(id_col: str) -> Column:
    """Whether a row is in the fold that no fit may read: crc32 of the id's text is divisible by 5 (a null id: empty text)."""
    return F.crc32(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = SAMPLE) -> DataFrame:
    """(text, label) of at most ``size`` labelled rows outside the held-out fold, ``size`` / 2 of either label at most.

    The ids are drawn from the labels by hash, so the documents are only filtered, not shuffled: the drawn ids are
    broadcast, ``size`` rows at most. Rows whose label is null or neither 0 nor 1 are left out; an id with several
    labels or texts gives a row for each pair.
    """
    drawn = None
    for label in (0, 1):
        part = labels.where((column(label_col) == label) & ~held_out(id_col)).select(column(id_col).alias("_drawn"), F.lit(label).alias("label"))
        part = part.orderBy(F.xxhash64("_drawn"), "_drawn").limit(size // 2)
        drawn = part if drawn is None else drawn.union(part)
    return docs.select(column(id_col).alias("_id"), column(text_col).cast("string").alias("text")).join(F.broadcast(drawn), F.col("_id") == F.col("_drawn")).select("text", "label")


def _counted(sample: DataFrame) -> DataFrame:
    """(gram, n0, n1): texts of either label that have an n-gram; a row a gram and task before the shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(50_000)(grams)
        counts = Counter(), Counter()
        for b in portions(it):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found: set[str] = set()
                for w in bag(text):
                    found.update(known(w))
                counts[label].update(found)
        for label, own in enumerate(counts):
            n, zero = pa.array(list(own.values()), pa.int64()), pa.array([0] * len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), zero if label else n, n if label else zero], names=["gram", "n0", "n1"])

    return sample.select("text", "label").mapInArrow(run, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _rows(sample: DataFrame, kept: list[str]) -> DataFrame:
    """(label, at, share): for each text the places in ``kept`` of its n-grams, 16 bits each, and their shares of its mean."""
    place = {g: k for k, g in enumerate(kept)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(200_000)
        def known(word: str) -> tuple[list[int], int]:
            own = grams(word)
            return sorted(place[g] for g in own if g in place), len(own)

        for b in portions(it):
            at, share = [], []
            for text in b.column(0).to_pylist():
                words, sums = bag(text), {}
                for w in words:
                    hit, n = known(w)
                    for g in hit:
                        sums[g] = sums.get(g, 0.0) + 1 / (n * len(words))
                keys = sorted(sums)
                at.append(np.array(keys, np.int16).tobytes())
                share.append(np.array([sums[k] for k in keys], np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["label", "at", "share"])

    return sample.select("text", "label").mapInArrow(run, "label int, at binary, share binary")


def train(rows: list[tuple[int, bytes, bytes]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, weights, bias) by Adam over all rows at once; both labels weigh alike, whatever their numbers."""
    y = np.array([r[0] for r in rows], np.int64)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[1]) // 2 for r in rows])
    gram = np.frombuffer(b"".join(r[1] for r in rows), np.int16)
    share = SCALE * np.frombuffer(b"".join(r[2] for r in rows), np.float32)
    rng = np.random.default_rng(7)
    vectors, weights, bias = rng.uniform(-0.1 / DIM, 0.1 / DIM, (size, DIM)), rng.uniform(-1, 1, (DIM, 2)), np.zeros(2)
    heavy = np.array([0.5 / max(1, (y == k).sum()) for k in (0, 1)])[y]
    params = [vectors, weights, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for epoch in range(1, EPOCHS + 1):
        mean = np.stack([np.bincount(doc, share * vectors[gram, k], len(rows)) for k in range(DIM)], 1)
        z = mean @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), y] -= 1
        p *= heavy[:, None]
        back = p @ weights.T
        slopes = np.stack([np.bincount(gram, share * back[doc, k], size) for k in range(DIM)], 1)
        for k, g in enumerate((slopes + DECAY * vectors, mean.T @ p, p.sum(0))):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] -= RATE * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.99**epoch)) + 1e-10)
    return vectors, weights, bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", size: int = SAMPLE) -> Model:
    """A model from the labelled rows outside the held-out fold; see ``labelled_sample`` for which ones.

    Only text and label are read. Long texts are read whole, null and empty ones have no words. Without any labelled row all
    texts score one half; with one label only, all lean to it.
    """
    sample = written(docs.sparkSession, labelled_sample(docs, labels, id_col, text_col, label_col, size), "labelled")
    n = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = (max(1, n.get(k, 0)) for k in (0, 1))
    p = (F.col("n0") + F.col("n1")) / (n0 + n1)
    far = F.abs(F.col("n1") / n1 - F.col("n0") / n0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    best = _counted(sample).select("gram", far.alias("far")).where(F.col("far") >= FAR).orderBy(F.desc("far"), "gram").limit(GRAMS)
    kept = sorted(r["gram"] for r in best.collect())
    rows = sorted((r["label"], bytes(r["at"]), bytes(r["share"])) for r in _rows(sample, kept).collect())
    return Model(kept, *train(rows, len(kept)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row: the chance of label 1, and whether it is at least one half.

    Map-only. Of the row only id and text are used, extra columns of any name are left out; null and empty texts, which have
    no words, score by the bias alone; long texts are scored whole; rows that repeat give rows that repeat, equal texts
    equal scores; an empty table gives an empty one. The id keeps its name and type.
    """
    slopes, lean = model.slopes(), float(model.bias[1] - model.bias[0])
    source = docs.select(column(id_col).alias("_id"), column(text_col).cast("string").alias("_text"))
    out = source.select("_id", F.lit(0.0).alias("_z")).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = ahocorasick.Automaton()
        for g in slopes:
            finder.add_word(g, g)
        finder.make_automaton()

        @lru_cache(200_000)
        def known(word: str) -> float:
            hit = {g for _, g in finder.iter(f"<{word}>")} if slopes else None
            return sum(slopes[g] for g in sorted(hit)) / len(grams(word)) if hit else 0.0

        for b in portions(it):
            found = []
            for text in b.column(1).to_pylist():
                words = bag(text)
                z = lean + sum(map(known, words)) / max(1, len(words))
                found.append(1 / (1 + math.exp(-min(max(z, -700.0), 700.0))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.float64())], names=out.names)

    scored = source.mapInArrow(run, out)
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), F.col("_z").alias("score"), (F.col("_z") >= 0.5).cast("int").alias("predicted"))
