"""Chat formatting by a grammar round trip.

Each turn is rendered, the rendered text is parsed again by the deterministic parser below, and the recovered turn
is compared with the source. While they differ, the next kind of control string that the text holds is escaped and
the turn rendered anew. A turn's segment begins with its own mark and ends at the first end mark of its kind, so
the conversation is the segments in turn order with nothing between, and parses turn by turn.

    user        [INST] text [/INST]
    assistant   [ANS] text </s>
    other role  [ROLE name] text [/ROLE]
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Kinds of control strings: first character, backslashes put in by escaping, rest. One backslash more escapes, one less restores.
CONTROLS = tuple(re.compile(rf"({a})(\\*)({b})") for a, b in (("<", "/s>"), ("<", "s>"), (r"\[", "/INST"), (r"\[", "INST"), (r"\[", "/ANS"), (r"\[", "ANS"), (r"\[", "/ROLE"), (r"\[", "ROLE")))
ENDS = {"[INST] ": " [/INST]", "[ANS] ": " </s>"}
ANSWER = "[ANS] "
_BEGIN = re.compile(r"\[INST\] |\[ANS\] |\[ROLE ([^\]]*)\] ")
_ESCAPED = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?(?:INST|ANS|ROLE))")


def escape(text: str, kind: re.Pattern) -> str:
    return kind.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] if m[1] else m[5]) + (m[3] if m[1] else m[6]), text)


def render_raw(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where its text begins and ends in it."""
    begin = {"user": "[INST] ", "assistant": ANSWER}.get(role, f"[ROLE {quote(role, safe='')}] ")
    return begin + text + ENDS.get(begin, " [/ROLE]"), len(begin), len(begin) + len(text)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a rendered conversation; begin and end hold the escaped text.

    The grammar needs no look back: a begin mark, then text up to the first end mark of its kind.
    """
    at = 0
    while at < len(rendered):
        m = _BEGIN.match(rendered, at)
        if not m:
            raise ValueError(f"no turn begins at {at}")
        close = ENDS.get(m[0], " [/ROLE]")
        end = rendered.find(close, m.end())
        if end < 0:
            raise ValueError(f"the turn at {at} does not end")
        role = "user" if m[0] == "[INST] " else "assistant" if m[0] == ANSWER else unquote(m[1])
        yield role, unescape(rendered[m.end() : end]), m.end(), end
        at = end + len(close)


def clean(text: str, escaped: str) -> bool:
    """No control string is left bare in what stands for ``text``."""
    return not any(m[2] == "" for kind in CONTROLS for m in kind.finditer(escaped))


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn's segment that parses back to just this turn; null role and text count as empty."""
    role, text = role or "", text or ""
    held, pending = text, list(CONTROLS)
    while True:
        segment, begin, end = render_raw(role, held)
        try:
            same = [x[:2] for x in parse(segment)] == [(role, text)]
        except ValueError:
            same = False
        if same and clean(text, held):
            return segment, begin, end
        while pending and not pending[0].search(held):
            pending.pop(0)
        if not pending:
            raise ValueError(f"a turn of role {role!r} cannot be rendered")
        held = escape(held, pending.pop(0))


_OUT = "conv_id {kind}, turn {turn}, role string, segment string, loss_begin int, loss_end int"


def render(turns: DataFrame) -> DataFrame:
    """One row per turn of (conv_id, turn, role, text): its segment, and for assistant turns the loss span in it
    (code points; -1 for other roles). No shuffle; extra columns are left out; repeated rows are turns of their own.
    A turn of any length is one segment; null role and text count as empty; an empty table gives no rows."""
    src = turns.select("conv_id", "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    schema = _OUT.format(kind=src.schema["conv_id"].dataType.simpleString(), turn=src.schema["turn"].dataType.simpleString())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            got = [(s, *((i, j) if r == "assistant" else (-1, -1))) for r, (s, i, j) in zip(roles, map(render_turn, roles, texts))]
            seg, begin, end = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2).cast(pa.string()), pa.array(seg, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["conv_id", "turn", "role", "segment", "loss_begin", "loss_end"])

    return src.mapInArrow(run, schema)


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from its segments in order of (turn, role, segment); null ids are one conversation.

    Segments are sorted by Spark and streamed through hashes, so a conversation of any length takes no memory. A hash
    over all turns in order is one sequence: the turns of one conversation meet in one task, and only these.
    """
    spark = rendered.sparkSession
    kind = rendered.schema["conv_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        now, state, done = None, None, []

        def close() -> None:
            if state:
                n, turns, chars, loss, size = state
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [()] * 6
            kinds = [schema, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in it:
            schema = b.column(0).type
            for conv, segment, begin, end in zip(b.column("conv_id").to_pylist(), b.column("segment").to_pylist(), b.column("loss_begin").to_pylist(), b.column("loss_end").to_pylist(), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if begin >= 0:
                    learned = unescape(segment[begin:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(segment)
            if len(done) >= 2000:
                yield flush()
        close()
        if done:
            yield flush()

    dealt = rendered.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
