"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Documents are counted by their pattern of votes (at
most 3 ** labellers patterns), and expectation-maximisation on these counts estimates how often each labeller is right
on good and on bad documents, with no true labels. The posterior of its pattern is a document's weak label; a hashed
linear scorer is fitted to the weak labels of a bounded sample and scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import column, portions, utf8, written
from .quality_rules import MEASURES, measure_text

#: Documents that the scorer is fitted to, at most; taken by a hash of the text, half from either weak label.
SAMPLE = 4096
#: Hashed features.
DIMS = 1 << 14
GOOD, BAD, NONE = 1, 0, 2
ROUNDS = 200
#: Score from which a document is kept. The fit weighs both labels alike, good ones are far more: so below one half.
THRESHOLD = 0.3

# Very frequent function words of English, German, French and Spanish, lower case.
COMMON = frozenset(
    """the of and to in is was that it for on with as by at be this from are or an a
    der die das und den von zu mit des auf für ist im dem nicht ein eine
    le la les et un une du en est que dans qui au pour ne pas sur
    el los las de y del por con no se lo como su""".encode().split()
)


@dataclass(frozen=True)
class Facts:
    """What the labellers look at: MEASURES, distinct words, common words."""

    m: dict[str, int]
    distinct: int
    common: int


def facts(data: bytes) -> Facts:
    words = data.lower().split()
    return Facts(dict(zip(MEASURES, measure_text(data))), len(set(words)), sum(map(COMMON.__contains__, words)))


def _vote(good: bool, bad: bool) -> int:
    return BAD if bad else GOOD if good else NONE


#: Name and vote of each labeller. A labeller that sees too little of what it judges votes nothing.
LABELLERS = (
    ("symbols", lambda f: _vote(f.m["n_symbols"] == 0, 10 * f.m["n_symbols"] > f.m["n_words"])),
    ("repeats", lambda f: _vote(10 * f.m["n_repeat_words"] < f.m["n_words"], f.m["n_words"] >= 30 and 2 * f.m["n_repeat_words"] > f.m["n_words"])),
    ("shouting", lambda f: _vote(f.m["n_letters"] < 10 or 4 * f.m["n_upper"] < f.m["n_letters"], f.m["n_letters"] >= 10 and 10 * f.m["n_upper"] > 6 * f.m["n_letters"])),
    ("marks", lambda f: _vote(50 * f.m["n_marks"] < f.m["n_words"], 10 * f.m["n_marks"] > 3 * f.m["n_words"])),
    ("lines", lambda f: _vote(f.m["n_lines"] >= 3 and not f.m["n_dup_lines"], f.m["n_lines"] >= 6 and 2 * f.m["n_dup_lines"] > f.m["n_lines"])),
    ("common_words", lambda f: _vote(10 * f.common > f.m["n_words"], f.m["n_words"] >= 30 and 100 * f.common < 3 * f.m["n_words"])),
    ("digits", lambda f: _vote(20 * f.m["n_digits"] < f.m["word_chars"], f.m["n_words"] >= 20 and 10 * f.m["n_digits"] > 3 * f.m["word_chars"])),
    ("vocabulary", lambda f: _vote(f.m["n_words"] >= 50 and 5 * f.distinct > 2 * f.m["n_words"] or f.m["n_words"] < 2000 and 2 * f.distinct > f.m["n_words"], 50 <= f.m["n_words"] < 2000 and 5 * f.distinct < f.m["n_words"])),
)


def votes(f: Facts) -> int:
    """The pattern of votes, a digit (base 3) for each labeller."""
    out = 0
    for _, label in LABELLERS:
        out = 3 * out + label(f)
    return out


def digits(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, d = divmod(pattern, 3)
        out.append(d)
    return out[::-1]


@dataclass(frozen=True)
class Estimate:
    """Share of good documents, and for each labeller and class the shares of votes BAD, GOOD, NONE."""

    prior: float
    shares: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes_of = np.array([digits(p) for p in patterns.tolist()]).reshape(len(patterns), len(LABELLERS))
        log = np.log(np.array([1 - self.prior, self.prior]))[:, None] + sum(np.log(self.shares[j, :, votes_of[:, j]]).T for j in range(len(LABELLERS)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))

    def accuracies(self) -> list[tuple[str, float, float]]:
        """(labeller, share right on bad documents it votes on, the same on good ones)."""
        return [(name, *(float(s[c, c] / (s[c, 0] + s[c, 1])) for c in (BAD, GOOD))) for (name, _), s in zip(LABELLERS, self.shares)]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Estimate:
    """EM over pattern counts, from the share of good votes. Shares are smoothed by one vote, so none is ever 0."""
    votes_of = np.array([digits(p) for p in patterns.tolist()]).reshape(len(patterns), len(LABELLERS))
    good, bad = (votes_of == GOOD).sum(axis=1), (votes_of == BAD).sum(axis=1)
    q = np.where(bad > 0, 0.5 * good / np.maximum(good + 2 * bad, 1), 0.95)
    found = None
    for _ in range(rounds):
        weight = np.stack([counts * (1 - q), counts * q])
        prior = float((weight[1].sum() + 1) / (weight.sum() + 2))
        shares = np.empty((len(LABELLERS), 2, 3))
        for j in range(len(LABELLERS)):
            for v in range(3):
                shares[j, :, v] = weight[:, votes_of[:, j] == v].sum(axis=1) + 1
        shares /= shares.sum(axis=2, keepdims=True)
        before, found = found, Estimate(prior, shares)
        q = found.posterior(patterns)
        if before is not None and np.abs(before.shares - shares).max() < 1e-7:
            break
    return found


_SMALL = bytes([*range(97, 123), *range(128, 256)])
_SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


def shape(word: bytes) -> bytes:
    """A word with each run of letters, capitals or digits as one character, and other characters once each in a row."""
    if not word.translate(None, _SMALL):  # most words
        return b"a" if word else b""
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    return re.sub(rb"(.)\1+", rb"\1", word)


def _slot(kind: bytes, value: bytes) -> int:
    return xxhash.xxh3_64_intdigest(kind + value) % DIMS


class WordSlots(dict):
    """The two features of a word, its lower-case self and its shape, packed as 16-bit numbers, in a bounded cache."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 300_000:
            self.clear()
        out = np.array([_slot(b"w", word.lower()), _slot(b"s", shape(word))], np.uint16).tobytes()
        if len(word) <= 64:
            self[word] = out
        return out


def ratio_slots(f: Facts) -> list[int]:
    """Features of the document as a whole: shares in tenths."""
    m = f.m
    tenths = lambda a, b: min(10, 10 * a // b) if b else 11
    shares = (("repeat", m["n_repeat_words"], m["n_words"]), ("symbol", m["n_symbols"], m["n_words"]), ("upper", m["n_upper"], m["n_letters"]), ("mark", m["n_marks"], m["n_words"]), ("line", m["n_dup_lines"], m["n_lines"]))
    return [_slot(b"r", f"{name}{tenths(a, b)}".encode()) for name, a, b in shares]


def word_features(words: list[bytes], slots: WordSlots) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's words and how often each occurs."""
    times = np.bincount(np.frombuffer(b"".join(map(slots.__getitem__, words)), np.uint16), minlength=DIMS)
    found = np.flatnonzero(times)
    return found.astype(np.uint16), times[found].astype(np.uint32)


@dataclass(frozen=True)
class Seen:
    """A text as the scorer sees it: its words' slots as shares of all words, and a 1 in each slot of ``ratio_slots``."""

    n_words: int
    slot: bytes
    times: bytes
    shares: bytes

    def vector(self) -> tuple[np.ndarray, np.ndarray]:
        shares = np.frombuffer(self.shares, np.uint16)
        value = np.frombuffer(self.times, np.uint32) / max(self.n_words, 1)
        return np.concatenate([np.frombuffer(self.slot, np.uint16), shares]).astype(np.int64), np.concatenate([value, np.ones(len(shares))])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 300, rate: float = 0.1, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for soft labels, by full-batch Adam steps; the same rows give the same fit."""
    w, bias = np.zeros(DIMS), 0.0
    if not rows:
        return w, bias
    slot, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1))
    m, v = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[slot], minlength=len(rows)) + bias
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(slot, value * e[row], minlength=DIMS) + ridge * w, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, pattern, weak_label (posterior of good), score, kept (score >= threshold).

    Null text counts as empty; a text without words gets the votes of its emptiness and a score like any other. Null
    and repeated ids pass through, equal texts get equal scores, and long texts are measured whole. Other columns are
    left out, whatever their names. An empty table gives no rows. A score just at the threshold is kept.

    Texts are read, split and measured once: pattern and packed features of each are written to the shared folder
    (some bytes for each distinct word), and the fit and the scores come from there.
    """
    spark = docs.sparkSession
    kind = StructType().add("id", docs.schema[id_col].dataType)
    rows = docs.select(column(id_col).alias("id"), utf8(column(text_col)).alias("data"))

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = WordSlots()
        for b in portions(it):
            out = []
            for x in b.column(1):
                d = x.as_py()
                f, words = facts(d), d.split()
                slot, times = word_features(words, slots)
                out.append((votes(f), xxhash.xxh3_64_intdigest(d) >> 1, len(words), slot.tobytes(), times.tobytes(), np.array(ratio_slots(f), np.uint16).tobytes()))
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", "pattern", "code", "n_words", "slot", "times", "shares"])

    packed = StructType.fromDDL("pattern int, code long, n_words long, slot binary, times binary, shares binary")
    seen = written(spark, rows.mapInArrow(judge, StructType([*kind, *packed])), "votes")
    texts = seen.groupBy("pattern", "code").agg(F.count(F.lit(1)).alias("n"))
    counts = texts.groupBy("pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).collect()  # at most 3 ** labellers rows
    patterns, n = np.array([r["pattern"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.float64)
    model = estimate(patterns, n) if len(n) else Estimate(0.5, np.full((len(LABELLERS), 2, 3), 1 / 3))
    weak = dict(zip(patterns.tolist(), model.posterior(patterns).tolist())) if len(n) else {}

    # the sample: the distinct texts with the least hashes of either weak label; a margin of six deviations over the share
    # of hashes expected makes sure of as many as there may be, and their number is bounded, so are the rows sent
    taken = []
    for label, most in ((True, sample - sample // 2), (False, sample // 2)):
        of = [r["pattern"] for r in counts if (weak[r["pattern"]] > 0.5) == label]
        there = sum(r["texts"] for r in counts if (weak[r["pattern"]] > 0.5) == label)
        if there:
            cut = min(1.0, (most + 6 * most**0.5 + 20) / there) * (1 << 63)
            near = seen.where(F.col("pattern").isin(of) & (F.col("code") <= F.lit(min(int(cut), (1 << 63) - 1))))
            taken += sorted(near.drop("id").dropDuplicates(["code"]).collect(), key=lambda r: r["code"])[:most]
    taken.sort(key=lambda r: r["code"])
    w, bias = fit([(*Seen(r["n_words"], r["slot"], r["times"], r["shares"]).vector(), weak[r["pattern"]]) for r in taken])

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(it):
            z = []
            for text in zip(*(c.to_pylist() for c in b.columns[2:])):
                slot, value = Seen(*text).vector()
                z.append(bias + float(w[slot] @ value))
            p = b.column(1).to_pylist()
            s = 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([weak[x] for x in p], pa.float64()), pa.array(s, pa.float64())], names=["id", "pattern", "weak_label", "score"])

    scored = seen.select("id", "pattern", "n_words", "slot", "times", "shares").mapInArrow(score, StructType([*kind, *StructType.fromDDL("pattern int, weak_label double, score double")]))
    return scored.withColumn("kept", F.col("score") >= threshold).withColumnRenamed("id", id_col)
