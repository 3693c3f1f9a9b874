"""Chat formatting: roles recovered from transcripts by a hidden Markov model.

A transcript is lines of text.  The hidden state of a line is its role and whether it
opens a turn; what is seen is the kind of speaker marker at its start and features of the
line (blank, question, list or code, length).  Viterbi finds the best state sequence, so
a marker that names nobody known ("Speaker 2:", "Kim:") gets its role from the order of
turns and the look of its lines.  The turns are then rendered in one canonical form.

Rows are sorted by conversation and turn over all tasks, and cut into segments of at most
``SEGMENT`` turns, so a conversation of any length never meets in one task.  The segments
are decoded as one transcript all the same: each gives the best scores from every state
before it to every state at its end (a max-plus matrix); these small matrices are chained,
first within a task's run of a conversation and then over its runs, which settles the
states at all borders, and every segment is then decoded between its own two.

Edge cases: null texts count as empty, null roles and roles other than system, user and
assistant get an anonymous marker; null turns come first.  Ties in turn are ordered by
role and text; repeated rows are turns of their own; rows with a null conv_id are one
conversation.  A text's own lines may look like markers and then open turns: every parsed
turn is returned, with the turn in which it begins, and ``recovered`` tells whether that
turn came back whole.  A turn that no parsed turn begins in has a row with nothing
rendered; what a parsed turn holds beyond a segment is rendered as a turn of its own.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

ROLES = ("system", "user", "assistant")
SEGMENT = 256
# The words of speaker markers.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "student", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a"),
}
_KIND = {w: i for i, r in enumerate(ROLES) for w in MARKERS[r]}
_MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*\*|\[|<\|?)?(?P<name>[^\W\d_][\w .'-]{0,23}?)\s*(?:\*\*:?|:\*\*|\]:?|\|?>|:)(?:\s|$)")
#: Marker kinds: the three roles, an unknown name, none.
UNKNOWN, NONE = 3, 4


def marker(line: str) -> tuple[int, str]:
    """Kind of the marker that opens a line, and the rest of the line."""
    found = _MARKER.match(line)
    if not found:
        return NONE, line
    name = found["name"].strip().lower()
    if name not in _KIND and len(name.split()) > 2:
        return NONE, line
    return _KIND.get(name, UNKNOWN), line[found.end() :]


def looks(line: str) -> int:
    """blank 0, question 1, list or code 2, short 3, long 4."""
    text = line.strip()
    if not text:
        return 0
    if text.endswith("?"):
        return 1
    if re.match(r"(?:[-*+] |\d+[.)] |```|\|)", text):
        return 2
    return 3 if len(text) < 120 else 4


# States: opening a turn by role, then going on with one by role.
_OPEN_MARKER = np.array([[0.9, 0.002, 0.002, 0.09, 0.006], [0.002, 0.85, 0.002, 0.14, 0.006], [0.002, 0.002, 0.85, 0.14, 0.006]])
_ON_MARKER = np.tile([0.001, 0.001, 0.001, 0.007, 0.99], (3, 1))
EMIT_MARKER = np.log(np.concatenate([_OPEN_MARKER, _ON_MARKER]))
EMIT_LOOK = np.log(
    np.array([[0.05, 0.02, 0.08, 0.35, 0.5], [0.05, 0.35, 0.02, 0.38, 0.2], [0.05, 0.05, 0.1, 0.35, 0.45], [0.1, 0.02, 0.2, 0.33, 0.35], [0.1, 0.2, 0.1, 0.35, 0.25], [0.1, 0.04, 0.25, 0.31, 0.3]])
)
_TURN = np.array([[0.05, 0.9, 0.05], [0.01, 0.04, 0.95], [0.01, 0.95, 0.04]])
#: From a line of a role: half open a new turn, half go on.
_STEP = np.concatenate([0.5 * _TURN, 0.5 * np.eye(3) + 1e-12], axis=1)
MOVE = np.log(np.concatenate([_STEP, _STEP]))
START = np.log(np.array([0.3, 0.5, 0.2, 1e-6, 1e-6, 1e-6]))


def _emitted(kinds: list[int], look: list[int]) -> np.ndarray:
    return EMIT_MARKER[:, kinds].T + EMIT_LOOK[:, look].T


def viterbi(kinds: list[int], look: list[int], start: int | None = None, end: int | None = None) -> list[int]:
    """The best states of the lines; after a line of state ``start`` and with the last in state ``end``, if given."""
    if not kinds:
        return []
    emit = _emitted(kinds, look)
    score, back = (START if start is None else MOVE[start]) + emit[0], []
    for row in emit[1:]:
        step = score[:, None] + MOVE
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    out = [int(score.argmax()) if end is None else end]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def cells(kinds: list[int], look: list[int]) -> np.ndarray:
    """Best scores of the lines by state before them (the last row: nothing before) and state of the last."""
    emit = _emitted(kinds, look)
    out = np.concatenate([MOVE, START[None]]) + emit[0]
    for row in emit[1:]:
        out = (out[:, :, None] + MOVE).max(axis=1) + row
    return out


def settle(matrices: list[np.ndarray], start: int, end: int | None) -> list[tuple[int, int]]:
    """State before (6: nothing) and at the end of each of the segments on the best path from ``start`` to ``end``."""
    ahead = [matrices[0][start]]
    for m in matrices[1:]:
        ahead.append((ahead[-1][:, None] + m[:6]).max(axis=0))
    at = int(ahead[-1].argmax()) if end is None else end
    out = []
    for i in range(len(matrices) - 1, -1, -1):
        before = int((ahead[i - 1] + matrices[i][:6, at]).argmax()) if i else start
        out.append((before, at))
        at = before
    return out[::-1]


def parse(text: str | None) -> list[tuple[str, str]]:
    """(role, text) of the turns of a transcript."""
    if not text:
        return []
    lines = text.split("\n")
    found = [marker(x) for x in lines]
    states = viterbi([k for k, _ in found], [looks(rest) for _, rest in found])
    turns: list[tuple[str, list[str]]] = []
    for line, (kind, rest), state in zip(lines, found, states, strict=True):
        if state < 3 or not turns:
            turns.append((ROLES[state % 3], [rest if kind != NONE else line]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(own)) for role, own in turns]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form of a conversation."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def parse_transcripts(df: DataFrame) -> DataFrame:
    """(id, turn, role, text, rendered) of transcripts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, role, text, render([(role, text)])) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (role, text) in enumerate(parse(t))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "turn", "role", "text", "rendered"])

    return df.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, turn int, role string, text string, rendered string")


#: Spellings with which transcripts are written: the last of each names nobody.
SPELLINGS = {
    "system": ("System:", "### System:", "[system]"),
    "user": ("User:", "Human:", "**User:**", "<|user|>", "Q:", "Speaker one:"),
    "assistant": ("Assistant:", "AI:", "**Assistant:**", "<|assistant|>", "A:", "Speaker two:"),
}


_TURN_TYPE = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("marker", pa.string())])
SEGMENTS = "conv_id long, seg long, run long, turns array<struct<turn:long,role:string,text:string,marker:string>>, cells array<double>"


def _read(turns: list[dict]) -> tuple[list[str], list[int], list[tuple[int, str]]]:
    """Lines of a transcript of turns, the turn of each, and its marker kind and rest."""
    lines, of = [], []
    for k, t in enumerate(turns):
        own = f"{t['marker']} {t['text']}".split("\n")
        lines += own
        of += [k] * len(own)
    return lines, of, [marker(x) for x in lines]


def segments(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, run, turns, cells): the turns in order with markers of many spellings, cut into segments.

    ``seg`` numbers them in order, ``run`` is the first one of the same conversation in the
    same task; ``cells`` is null where a segment is known to be a whole conversation.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role"))
    spelled = F.coalesce(
        *[F.when(role == r, F.element_at(F.array(*[F.lit(x) for x in s]), (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(s))) + 1).cast("int"))) for r, s in SPELLINGS.items()], F.lit("Speaker:")
    )
    rows = C.stable(conversations).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        spelled.alias("marker"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", "turn", "role", "text", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = first = TaskContext.get().partitionId() << 33
        begin = seg
        conv, held = None, []

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            """The held turns as a segment; ``last``: of what the task has of its conversation."""
            found = None
            if not last or seg != first or first == begin or ended:
                _, _, marks = _read(held)
                found = cells([k for k, _ in marks], [looks(x) for _, x in marks]).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([seg]), pa.array([first]), pa.array([held], pa.list_(_TURN_TYPE)), pa.array([found], pa.list_(pa.float64()))], ["conv_id", "seg", "run", "turns", "cells"]
            )

        ended = False
        for batch in batches:
            for own, turn in zip(batch.column(0).to_pylist(), batch.select(["turn", "role", "text", "marker"]).to_pylist(), strict=True):
                if held and (own != conv or len(held) == segment):
                    yield from out(own != conv)
                    seg += 1
                    held = []
                    if own != conv:
                        first = seg
                conv = own
                held.append(turn)
        ended = True  # the conversation may go on in the next task
        if held:
            yield from out(True)

    return rows.mapInArrow(run, SEGMENTS)


def _borders(segs: DataFrame) -> DataFrame:
    """(seg, start, end): states before and at the end of the segments of (conv_id, seg, run, cells)."""

    def matrices(pdf: pd.DataFrame, name: str) -> tuple[pd.DataFrame, list[np.ndarray]]:
        pdf = pdf.sort_values(name)
        return pdf, [np.asarray(x).reshape(7, 6) for x in pdf.cells]

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = matrices(pdf, "seg")
        whole = own[0]
        for m in own[1:]:
            whole = (whole[:, :, None] + m[:6]).max(axis=1)
        return pd.DataFrame({"conv_id": pdf.conv_id.iloc[:1], "run": pdf.run.iloc[:1], "cells": [whole.ravel()]})

    def over_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = matrices(pdf, "run")
        return pd.DataFrame([(r, *x) for r, x in zip(pdf.run, settle(own, 6, None), strict=True)], columns=["run", "start", "end"])

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = matrices(pdf, "seg")
        return pd.DataFrame([(s, *x) for s, x in zip(pdf.seg, settle(own, int(pdf.start.iloc[0]), int(pdf.end.iloc[0])), strict=True)], columns=["seg", "start", "end"])

    runs = segs.groupBy("run").applyInPandas(joined, "conv_id long, run long, cells array<double>")
    settled = runs.groupBy("conv_id").applyInPandas(over_runs, "run long, start int, end int")
    return segs.join(settled, "run").groupBy("run").applyInPandas(within, "seg long, start int, end int")


def recover(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, segment, nth, turn, role, role_pred, recovered, rendered): the turns parsed from transcripts, and where they begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, seg, turns, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines, of, marks = _read(turns)
                states = viterbi([k for k, _ in marks], [looks(x) for _, x in marks], None if start == 6 else start, end)
                opens = [i for i, state in enumerate(states) if state < 3 or not i]
                n = 0
                begun = [of[i] for i in opens]
                for j, (a, b) in enumerate(zip(opens, [*opens[1:], len(lines)], strict=True)):
                    k, role = of[a], ROLES[states[a] % 3]
                    for missed in range(of[opens[j - 1]] + 1 if j else 0, k):  # turns that began within the parsed turn before
                        out.append((conv, seg, n, turns[missed]["turn"], turns[missed]["role"], ROLES[states[of.index(missed)] % 3], False, ""))
                        n += 1
                    kind, rest = marks[a]
                    text = "\n".join([rest if kind != NONE and states[a] < 3 else lines[a], *lines[a + 1 : b]])
                    whole = begun.count(k) == 1 and text == turns[k]["text"] and (not a or of[a - 1] != k)
                    out.append((conv, seg, n, turns[k]["turn"], turns[k]["role"], role, whole, render([(role, text)])))
                    n += 1
                for missed in range(begun[-1] + 1, len(turns)):
                    out.append((conv, seg, n, turns[missed]["turn"], turns[missed]["role"], ROLES[states[of.index(missed)] % 3], False, ""))
                    n += 1
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "segment", "nth", "turn", "role", "role_pred", "recovered", "rendered"])

    segs = C.written(segments(conversations, segment), "chat-segments")
    borders = _borders(segs.where("cells IS NOT NULL").select("conv_id", "seg", "run", "cells"))
    rows = segs.select("conv_id", "seg", "turns").join(borders, "seg", "left").select("conv_id", "seg", "turns", F.coalesce("start", F.lit(6)).alias("start"), "end")
    return rows.mapInArrow(run, "conv_id long, segment long, nth int, turn long, role string, role_pred string, recovered boolean, rendered string")
