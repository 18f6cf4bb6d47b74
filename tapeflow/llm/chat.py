"""Chat formatting: a declarative template, a state machine over roles, loss flags by segment.

Rows come out segment by segment in conversation order, so no conversation is ever held
whole: a task reads its rows sorted by (conversation, turn) and keeps a few counters.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """What stands before and after a role's text, and whether the text is under the loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role and the allowed steps between states.

    ``turns``: role -> Turn. ``steps``: (state, role) -> next state, from state ``start``.
    A conversation is valid if every turn has a step, complete if it also ends in ``ends``. Roles without
    a Turn are written with ``other_before`` (which holds ``{}`` for the role) and
    ``other_after``. ``controls`` are all strings that may not appear unescaped in a text.
    """

    turns: dict[str, Turn]
    steps: dict[tuple[str, str], str]
    ends: frozenset[str]
    start: str = "start"
    other_before: str = "<|role {}|>"
    other_after: str = "<|end|>"
    extra_controls: tuple[str, ...] = ()
    _pattern: list = field(default_factory=list, compare=False)

    def controls(self) -> list[str]:
        marks = [m.strip() for t in self.turns.values() for m in (t.before, t.after)]
        other = [*self.other_before.split("{}"), self.other_after]
        return sorted({m for m in [*marks, *other, *self.extra_controls] if m}, key=lambda m: (-len(m), m))

    def escape(self, text: str) -> str:
        """Control strings get an escape sign behind their first character; signs are doubled."""
        if not self._pattern:
            self._pattern.append(re.compile("|".join(map(re.escape, [ESCAPE, *self.controls()]))))
        return self._pattern[0].sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text)

    def escape_role(self, role: str) -> str:
        """A role within its mark: nothing in it may look like the mark's end, a control's own end included."""
        tail = self.other_before.split("{}")[1]
        return self.escape(role).replace(tail, tail[0] + ESCAPE + tail[1:])

    def marks(self, role: str) -> tuple[str, str, bool]:
        turn = self.turns.get(role)
        if turn:
            return turn.before, turn.after, turn.loss
        return self.other_before.format(self.escape_role(role)), self.other_after, False


def unescape(text: str) -> str:
    """Inverse of Template.escape: a sign that follows a sign stays once, any other goes."""
    out, i = [], 0
    while (at := text.find(ESCAPE, i)) >= 0:
        out.append(text[i:at])
        if text.startswith(ESCAPE * 2, at):
            out.append(ESCAPE)
            i = at + 2
        else:
            i = at + 1
    out.append(text[i:])
    return "".join(out)


#: Marks of a widely used instruction format, one block a turn.
INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>", loss=True),
    },
    steps={
        ("start", "system"): "asked", ("start", "user"): "user", ("asked", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    },
    ends=frozenset({"assistant"}),
)

_SEGMENTS = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("seg", pa.int32()), ("text", pa.string()),
    ("loss", pa.bool_()), ("state", pa.string()),
])


def _ordered(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments (conv_id, turn, seg, text, loss, state) in conversation order within partitions.

    Three segments a turn: mark, escaped text, mark; only a text can be under the loss mask.
    ``state`` is the machine's state after the turn, ``invalid`` from the first step not allowed on.
    Turns go by number, nulls first, equal numbers by role and text; each repeated row is a
    turn. Null role and text count as empty; null conv_id is a conversation of its own; an
    unknown role is written under its name and is never under the loss. Extra columns are
    ignored. An empty table gives no segment.
    """
    def run(batches):
        conv, state, started = None, template.start, False
        for batch in batches:
            ids, turns, roles, texts = (c.to_pylist() for c in batch.columns)
            out = [[], [], [], [], [], []]
            for c, t, role, text in zip(ids, turns, roles, texts, strict=True):
                if not started or c != conv:
                    conv, state, started = c, template.start, True
                state = template.steps.get((state, role), "invalid")
                before, after, loss = template.marks(role)
                for seg, (piece, under) in enumerate(((before, False), (template.escape(text), loss), (after, False))):
                    for col, v in zip(out, (c, t, seg, piece, under, state), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, _SEGMENTS, strict=True)], schema=_SEGMENTS)

    return _ordered(conversations).mapInArrow(run, "conv_id long, turn long, seg int, text string, loss boolean, state string")


class Reader:
    """Turns of one formatted conversation, read from its text alone, piece by piece.

    ``feed`` returns the (role, text) pairs that are complete; at most one turn is buffered.
    """

    def __init__(self, template: Template):
        self.template, self.buffer = template, ""
        opens = [(t.before, t.after, role) for role, t in template.turns.items()]
        self.opens = sorted(opens, key=lambda o: -len(o[0]))
        self.other = template.other_before.split("{}")

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.buffer += piece
        out = []
        while (turn := self._next()) is not None:
            out.append(turn)
        return out

    def _next(self) -> tuple[str, str] | None:
        for before, after, role in self.opens:
            if self.buffer.startswith(before):
                return self._cut(len(before), after, role)
        head, tail = self.other
        if self.buffer.startswith(head):
            at = self.buffer.find(tail, len(head))
            if at >= 0:
                return self._cut(at + len(tail), self.template.other_after, unescape(self.buffer[len(head) : at]))
        return None

    def _cut(self, start: int, after: str, role: str) -> tuple[str, str] | None:
        """Up to the first closing mark; its control string can't occur in an escaped text."""
        control = after.strip()
        at = self.buffer.find(control, start)
        if at < 0:
            return None
        lead = after.index(control)
        end = at - lead + len(after)
        if len(self.buffer) < end:
            return None
        text = self.buffer[start : at - lead]
        self.buffer = self.buffer[end:]
        return role, unescape(text)


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read from the formatted text and the mask alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and
    loss_sha256 (unescaped text under the mask), formatted_chars, valid, complete. Takes the output of
    ``format_chats`` as it is partitioned; digests are fed piece by piece. A conversation whose
    formatted text can't be read to its end is an error.
    """
    types = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                       ("valid", pa.bool_()), ("complete", pa.bool_())])

    def run(batches):
        now = None

        def row():
            if now["reader"].buffer:
                raise ValueError(f"conversation {now['conv_id']} has a broken turn")
            return (now["conv_id"], now["turns"], now["digest"].hexdigest(), now["loss"], now["loss_digest"].hexdigest(),
                    now["chars"], now["state"] != "invalid", now["state"] in template.ends)

        for batch in batches:
            done = []
            ids, _, _, texts, masks, states = (c.to_pylist() for c in batch.columns)
            for c, text, loss, state in zip(ids, texts, masks, states, strict=True):
                if now is None or now["conv_id"] != c:
                    if now is not None:
                        done.append(row())
                    now = {"conv_id": c, "reader": Reader(template), "turns": 0, "digest": hashlib.sha256(), "loss": 0,
                           "loss_digest": hashlib.sha256(), "chars": 0, "state": ""}
                now["chars"] += len(text)
                now["state"] = state
                if loss:
                    own = unescape(text)
                    now["loss"] += len(own)
                    now["loss_digest"].update(own.encode())
                for role, said in now["reader"].feed(text):
                    now["turns"] += 1
                    now["digest"].update(f"{role}\n{said}\n".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done, strict=True), types, strict=True)], schema=types)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row(), types, strict=True)], schema=types)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                    "formatted_chars long, valid boolean, complete boolean")
