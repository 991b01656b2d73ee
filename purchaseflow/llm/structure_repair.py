"""Repair of conversation structure by a min-plus program over a grammar.

A turn is a symbol: the initial of its role and its first fault. Conversations become strings of symbols, cut into blocks;
Re-Pair finds rules (a symbol for a frequent pair) over the distinct strings of all conversations, and each rule has one
transfer matrix: for each pair of states of the wanted form the cheapest cost and, as a rope, its edits. A rule's matrix
is the min-plus product of its two parts', so it is computed once and used wherever the pair stands. A string is
the product of the few symbols that are left of it, a conversation the product of its blocks.

The wanted form is (s?(ua)+)? over role initials. States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3
after an assistant turn; 0 and 3 may end. Ties go to the ASCII-least string of edits. No two strings that lead from one state to
another over the same turns at the same cost are prefixes of each other (what is longer has inserts more), so the least of
a whole is made of the least of its parts, and the product keeps it.
"""

from __future__ import annotations

import hashlib
import os.path
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import batches, column, forget, join_hot, partitions, portions, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Terminal symbols: initials (s, u, a, any other) times faults (none, blank, duplicate, truncated).
INITIALS, LETTERS = "suao", "ABCDEFGHIJKLMNOP"
BLANK, DUPLICATE, CUT = 1, 2, 3
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FREE = {(0, 2): "I", (0, 3): "II", (1, 2): "I", (1, 3): "II", (2, 3): "I", (3, 2): "I"}
_LEGAL = {"su", "ua", "au"}
_NEEDED = {0: "u", 1: "u", 2: "a", 3: "u"}
ROLES = {"u": "user", "a": "assistant"}
#: A rule must save this share of all symbols, and there are RULES at most; what they don't cover is multiplied out.
WORTH, RULES = 1000, 256
#: Bits of the rows of a block: strings are cut at 4,096 symbols.
BLOCK_BITS = 12
_LEAF = 256
SPACE = " \t\n\x0b\x0c\r"

Rope = str | tuple  # a text, or (left, right, length)
Matrix = list[list[tuple[int, Rope] | None]]


def _pieces(rope: Rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        r = stack.pop()
        if not isinstance(r, str):
            stack += (r[1], r[0])
        elif r:
            yield r


def text_of(rope: Rope) -> str:
    return rope if isinstance(rope, str) else "".join(_pieces(rope))


def _cat(a: Rope, b: Rope) -> Rope:
    n = (len(a) if isinstance(a, str) else a[2]) + (len(b) if isinstance(b, str) else b[2])
    return text_of(a) + text_of(b) if n <= _LEAF else (a, b, n)


def _less(a: Rope, b: Rope) -> bool:
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    x, y = _pieces(a), _pieces(b)
    left = right = ""
    while True:
        left, right = left or next(x, ""), right or next(y, "")
        if not left or not right:
            return not left and bool(right)
        n = min(len(left), len(right))
        if left[:n] != right[:n]:
            return left[:n] < right[:n]
        left, right = left[n:], right[n:]


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and _less(new[1], old[1])


def row_times(row: list[tuple[int, Rope] | None], m: Matrix) -> list[tuple[int, Rope] | None]:
    out: list[tuple[int, Rope] | None] = [None] * 4
    for mid, had in enumerate(row):
        if had:
            for q, then in enumerate(m[mid]):
                if then and (out[q] is None or had[0] + then[0] <= out[q][0]):
                    new = (had[0] + then[0], _cat(had[1], then[1]))
                    if _better(new, out[q]):
                        out[q] = new
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [row_times(row, b) for row in a]


INSERTS: Matrix = [[(0, "") if p == q else (INSERT * len(_FREE[p, q]), _FREE[p, q]) if (p, q) in _FREE else None for q in range(4)] for p in range(4)]


def terminal(letter: str) -> Matrix:
    """Inserts before a turn and then what may be done with it."""
    initial, fault = INITIALS[LETTERS.index(letter) // 4], LETTERS.index(letter) % 4
    own: Matrix = [[(DELETE, "D") if p == q else None for q in range(4)] for p in range(4)]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        for (p, out), q in _STEP.items():
            for edit, cost, may in (("K", KEEP, out == initial), ("R", REROLE, out in "ua")):
                if may and _better((cost + extra, edit), own[p][q]):
                    own[p][q] = (cost + extra, edit)
    return times(INSERTS, own)


@dataclass(frozen=True)
class Counts:
    """Faults in a string of symbols, pairs of neighbours that the form doesn't allow, and the initials at its ends."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str

    def __add__(self, other: Counts) -> Counts:
        seam = self.last + other.first not in _LEGAL
        return Counts(self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated, self.illegal + other.illegal + seam, self.first, other.last)


def _count(letter: str) -> Counts:
    initial, fault = INITIALS[LETTERS.index(letter) // 4], LETTERS.index(letter) % 4
    return Counts(int(fault == BLANK), int(fault == DUPLICATE), int(fault == CUT), 0, initial, initial)


class Grammar:
    """Rules in the order in which they were found; a rule's symbol stands for a pair of earlier symbols."""

    def __init__(self, pairs: Iterable[str] = ()):
        self.rules: list[tuple[str, str]] = []
        self.add(pairs)

    def add(self, pairs: Iterable[str]) -> None:
        for pair in pairs:
            self.rules.append((chr(0x4E00 + len(self.rules)), pair))

    def compress(self, text: str) -> str:
        for symbol, pair in self.rules:
            text = text.replace(pair, symbol)
        return text

    def evaluate(self) -> dict[str, tuple[Matrix, Counts]]:
        """Matrix and counts of every symbol, bottom-up: a rule's parts come before it."""
        known = {letter: (terminal(letter), _count(letter)) for letter in LETTERS}
        for symbol, (a, b) in self.rules:
            (m, c), (n, d) = known[a], known[b]
            known[symbol] = times(m, n), c + d
        return known


def pairs_of(text: str, weight: int, into: Counter) -> None:
    """Adds a string's pairs of neighbours, of a run of one symbol every second pair only: they can't overlap."""
    taken = False
    for a, b, before in zip(text, text[1:], " " + text, strict=False):
        taken = a == b == before and not taken
        if not taken:
            into[a + b] += weight


def chosen(counts: list[tuple[str, int]], least: int) -> list[str]:
    """Pairs in order of frequency that share no symbol with a more frequent one, whose replacement would change their count."""
    used: set[str] = set()
    out = []
    for pair, n in counts:
        if n >= least and not used & set(pair):
            out.append(pair)
            used |= set(pair)
    return out


def learn(strings: DataFrame, symbols: int) -> Grammar:
    """Re-Pair over (seq, n): in each round the most frequent pairs of the compressed strings become rules.

    Pairs are counted by the tasks that hold the strings; of all counts, which are as many as pairs of symbols at most, the
    first 64 come to the driver.
    """
    grammar, least = Grammar(), max(2, symbols // WORTH)
    while len(grammar.rules) < RULES:
        rules = grammar

        def run(it: Iterator[pa.RecordBatch], rules: Grammar = rules) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for b in it:
                for text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    pairs_of(rules.compress(text), n, found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        top = strings.select("seq", "n").mapInArrow(run, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(64).collect()
        found = chosen([(r["pair"], r["n"]) for r in top], least)[: RULES - len(grammar.rules)]
        if not found:
            break
        grammar = Grammar([pair for _, pair in grammar.rules] + found)
    return grammar


_EVALUATED = "e_seq string, uses long, costs array<int>, audits array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string"
_EVALUATED_ARROW = pa.schema([("e_seq", pa.string()), ("uses", pa.int64()), ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string())])


def _evaluated(strings: DataFrame, grammar: Grammar) -> DataFrame:
    """Matrix and counts of each distinct string."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = grammar.evaluate()
        for b in it:
            for text, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first, *rest = grammar.compress(text)
                m, c = known[first]
                for symbol in rest:
                    m, c = times(m, known[symbol][0]), c + known[symbol][1]
                flat = [x for row in m for x in row]
                yield text, n, [x[0] if x else -1 for x in flat], [text_of(x[1]) if x else None for x in flat], c.blank, c.duplicate, c.truncated, c.illegal, c.first, c.last

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(rows(portions(it)), _EVALUATED_ARROW, weight=lambda r: 20 * len(r[0]) + 200)

    return strings.select("seq", "n").mapInArrow(run, _EVALUATED)


def _folded(blocks: DataFrame) -> DataFrame:
    """One row a conversation from its blocks in order. What all four states' edits begin with is settled and set aside."""
    fields = ["blank", "duplicate", "truncated", "illegal", "cost"]
    out = StructType([blocks.schema["conv"], *(StructField(f, LongType()) for f in fields), StructField("audit", StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            now: list | None = None

            def close() -> tuple:
                conv, row, counts, settled = now
                ends = row_times(row, INSERTS)
                best = ends[0] if ends[0] and (not ends[3] or _better(ends[0], ends[3])) else ends[3]
                return conv, counts.blank, counts.duplicate, counts.truncated, counts.illegal, best[0], "".join(settled) + text_of(best[1])

            for b in it:
                kind = b.schema.field("conv").type
                for r in b.to_pylist():
                    if now is None or now[0] != r["conv"]:
                        if now:
                            yield close()
                        now = [r["conv"], [(0, ""), None, None, None], None, []]
                    flat = [(c, a) if c >= 0 else None for c, a in zip(r["costs"], r["audits"], strict=True)]
                    row = row_times(now[1], [flat[4 * p : 4 * p + 4] for p in range(4)])
                    texts = [text_of(x[1]) for x in row if x]
                    n = len(os.path.commonprefix(texts))
                    now[3].append(texts[0][:n])
                    now[1] = [(x[0], text_of(x[1])[n:]) if x else None for x in row]
                    own = Counts(*(r[f] for f in ("blank", "duplicate", "truncated", "illegal", "first", "last")))
                    now[2] = own if now[2] is None else now[2] + own
            if now:
                yield close()

        for b in _typed(rows(), lambda: kind, [pa.int64()] * 5 + [pa.string()], out.names):
            yield b

    narrow = blocks.select("conv", "block", "costs", "audits", "blank", "duplicate", "truncated", "illegal", "first", "last")
    return narrow.repartition(partitions(blocks.sparkSession), "conv").sortWithinPartitions("conv", "block").mapInArrow(run, out)


def _typed(rows: Iterator[tuple], kind, rest: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches whose first column has the type that ``kind()`` tells once a row is there."""
    held, load = [], 0
    for row in rows:
        held.append(row)
        load += 200 + sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= 2000 or load >= 16 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), [kind(), *rest], strict=True)], names=names)
            held, load = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), [kind(), *rest], strict=True)], names=names)


@dataclass(frozen=True)
class Repair:
    """``audits``: a row a conversation; ``rows``: its turns in order (conv, at, turn, role, text), to replay edits on."""

    audits: DataFrame
    rows: DataFrame
    conv_col: str


def _symbol(role: Column, text: Column, repeated: Column) -> Column:
    end = F.rtrim(text, F.lit(SPACE))
    fault = F.when(end == "", BLANK).when(repeated, DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    place = F.when(F.left(role, F.lit(1)) == "s", 0).when(F.left(role, F.lit(1)) == "u", 1).when(F.left(role, F.lit(1)) == "a", 2).otherwise(3)
    return F.substring(F.lit(LETTERS), place * 4 + fault + 1, F.lit(1))


def repair(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bits: int = BLOCK_BITS) -> Repair:
    """The cheapest edits that give every conversation the form (s?(ua)+)?.

    Turns are in order of turn (nulls first), then of role and text; null roles and texts count as one space. A turn's first
    fault counts: blank (white space only), duplicate (role and text came before in the conversation), truncated (the
    last character but white space is none of ``.!?``). Edits: keep, rerole to user or assistant, delete (all that may be
    done with blank and duplicate turns), insert an empty user or assistant turn. ``audits`` has of each conversation gaps
    (numbers missing between the least and the greatest turn), blank, duplicate, truncated, illegal (neighbours whose
    initials are none of su, ua, au), cost and audit, the initials of the edits in order.

    ``conversations`` may name more ids: those without turns have zeros and an empty audit, as an empty table gives an
    empty one. A null id is one conversation. Repeated rows are turns of their own, so duplicates. Extra columns are left
    out. Texts of any length are compared by sha256. Turns are sorted over all tasks by range and matched by their place
    in that order, so a conversation may have any number of turns; only its blocks' matrices, one for 4,096 turns, meet.
    """
    spark = turns.sparkSession
    named = turns.select(
        column(conv_col).alias("conv"), column(turn_col).alias("turn"),
        F.coalesce(column(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(column(text_col).cast("string"), F.lit(" ")).alias("text"),
    )
    # bounds of ranges are drawn from short keys; rows alike in these stay in one task and are sorted there
    dealt = named.repartitionByRange(partitions(spark), "conv", "turn", "role", F.left("text", F.lit(32)))
    rows = written(spark, dealt.sortWithinPartitions("conv", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id()), "turns")

    firsts = rows.groupBy("conv", "role", F.sha2("text", 256).alias("key")).agg(F.min("at").alias("first_at")).select("first_at")
    # the fault of a turn that repeats another is the same letter plus what the join finds
    letters = rows.select("conv", "at", _symbol(F.col("role"), F.col("text"), F.lit(False)).alias("once"), _symbol(F.col("role"), F.col("text"), F.lit(True)).alias("again"))
    marked = letters.join(firsts, F.col("at") == F.col("first_at"), "left").select("conv", "at", F.when(F.col("first_at").isNull(), F.col("again")).otherwise(F.col("once")).alias("letter"))
    strung = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")
    blocks = written(spark, marked.groupBy("conv", F.shiftright("at", block_bits).alias("block")).agg(strung.alias("seq")), "blocks")

    strings = written(spark, blocks.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "strings")
    size = strings.agg(F.sum(F.col("n") * F.length("seq")).alias("symbols"), F.sum("n").alias("blocks")).first()
    grammar = learn(strings, size["symbols"] or 0)
    side = _evaluated(strings, grammar)
    # no more than a thousand strings, which are of 4,096 symbols at most, are broadcast
    joined = join_hot(blocks, "seq", side, "e_seq", "uses", size["blocks"] or 0, keys=1000)
    folded = _folded(joined)

    listed = named.select("conv", F.col("turn").cast("decimal(20,0)").alias("turn"))
    if conversations is not None:
        listed = listed.union(conversations.select(column(conv_col), F.lit(None).cast("decimal(20,0)")))
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = listed.groupBy("conv").agg(F.coalesce(missing, F.lit(0)).try_cast("long").alias("gaps"))
    found = gaps.join(folded.withColumnRenamed("conv", "f_conv"), F.col("conv").eqNullSafe(F.col("f_conv")), "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    audits = found.select("conv", "gaps", *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))
    audits = written(spark, audits, "audits")
    forget(strings)
    forget(blocks)
    return Repair(audits.withColumnRenamed("conv", conv_col), rows, conv_col)


def replay(edits: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that ``edits`` make of ``rows`` (role, text); the rows are read as they are needed."""
    state, source = 0, iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else _NEEDED[state]
        state = _STEP[state, initial]
        yield edit, role if edit == "K" else ROLES[initial], text


_HEAD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(found: Repair) -> DataFrame:
    """Every conversation's audit and then its turns in order; a partition has whole conversations."""
    heads = found.audits.withColumnRenamed(found.conv_col, "conv").withColumns({"at": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    both = heads.unionByName(found.rows.select("conv", "at", "role", "text"), allowMissingColumns=True)
    return both.repartition(partitions(both.sparkSession), "conv").sortWithinPartitions("conv", "at")


def _conversations(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]], pa.DataType]]:
    """(audit row, its turns) of each conversation; the turns are to be used up before the next is asked for."""
    lines = ((r, b.schema.field("conv").type) for b in portions(it) for r in b.to_pylist())
    waiting: list = [next(lines, None)]

    def own() -> Iterator[tuple[str, str]]:
        while (line := next(lines, None)) is not None:
            if line[0]["at"] == -1:
                waiting.append(line)
                return
            yield line[0]["role"], line[0]["text"]

    while waiting and (line := waiting.pop()) is not None:
        turns = own()
        yield line[0], turns, line[1]
        for _ in turns:
            pass


def repaired_turns(found: Repair) -> DataFrame:
    """(conversation, place, edit, role, text) of all turns after the repair, place from 0. A conversation of any length streams
    through one task; only its audit, a letter a turn, is held."""
    out = StructType([StructField("conv", found.audits.schema[found.conv_col].dataType), StructField("place", LongType()), *(StructField(c, StringType()) for c in ("edit", "role", "text"))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for head, turns, kind in _conversations(it):
                for place, (edit, role, text) in enumerate(replay(head["audit"], turns)):
                    yield head["conv"], place, edit, role, text

        yield from _typed(rows(), lambda: kind, [pa.int64()] + [pa.string()] * 3, out.names)

    return _streamed(found).mapInArrow(run, out).withColumnRenamed("conv", found.conv_col)


def digests(found: Repair) -> DataFrame:
    """The audits with ``repaired_sha256``: of ``role:text`` of the repaired turns, joined by newlines."""
    names = ["conv", *_HEAD, "audit", "repaired_sha256"]
    out = StructType([StructField("conv", found.audits.schema[found.conv_col].dataType), *(StructField(c, LongType()) for c in _HEAD), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for head, turns, kind in _conversations(it):
                state, before = hashlib.sha256(), ""
                for _, role, text in replay(head["audit"], turns):
                    state.update(f"{before}{role}:{text}".encode("utf-8", "surrogatepass"))
                    before = "\n"
                yield head["conv"], *(head[c] for c in _HEAD), head["audit"], state.hexdigest()

        yield from _typed(rows(), lambda: kind, [pa.int64()] * 6 + [pa.string()] * 2, names)

    return _streamed(found).mapInArrow(run, out).withColumnRenamed("conv", found.conv_col)
