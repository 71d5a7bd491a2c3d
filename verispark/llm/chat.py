"""Chat formatting: turns become text segments with loss flags, and can be read back.

A declarative ``Template`` names the control strings and which roles carry loss;
a finite-state machine over roles says which turn may follow which.  For every
turn three segments are emitted, in order: the header, the text (the only one
that can carry loss) and the end mark.

* Control strings inside texts and roles are escaped reversibly: an opening
  ``<`` + backslashes + ``|`` gets one more backslash, so no text can contain the
  beginning of a control string, and removing one backslash restores it.
* Rows are shuffled by conversation and sorted by turn, then handled as a stream:
  only one turn is in memory, however long a conversation is.  Texts are escaped
  before the shuffle's consumer needs them, row by row.

Defined results.  A null text is empty; a null role is the empty role (which no
transition allows).  Turns with equal numbers are ordered by role and text; null
turns come first.  Repeated rows are turns of their own.  A conversation that
breaks the turn order is still formatted, with ``valid`` false from the first
offending turn on.  Null conversation ids form one conversation.  An empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn_no long, part string, segment string, loss boolean, valid boolean"
BATCH_BYTES = 4 << 20

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")


@dataclass(frozen=True)
class Template:
    """Control strings, loss roles and the state machine of the turn order."""

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: frozenset = frozenset({"assistant"})
    #: state -> {role: next state}
    transitions: dict = field(
        default_factory=lambda: {
            "begin": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    first: str = "begin"
    #: states in which a conversation may end
    final: frozenset = frozenset({"answered"})

    def __post_init__(self):
        if not (self.start.startswith("<|") and self.end.startswith("<|")):
            raise ValueError("control strings begin with '<|', which is what texts are escaped against")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """Roles also stay on their line: backslash and line feed are written as two characters."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class TurnMachine:
    def __init__(self, template: Template):
        self.template, self.state, self.valid = template, template.first, True

    def step(self, role: str) -> bool:
        """Whether all turns up to and including this one are in order."""
        following = self.template.transitions.get(self.state, {}).get(role) if self.valid else None
        self.valid = following is not None
        self.state = following if self.valid else self.state
        return self.valid

    @property
    def complete(self) -> bool:
        return self.valid and self.state in self.template.final


class _Out:
    """Columns of segments, given out in batches of bounded size."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += len(row[3])

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * 6
        self.rows, self.size = [], 0
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def segment_batches(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, role, text) -> segments; the state is one conversation's machine."""
    out, conv, begun, machine, turn = _Out(), None, False, None, 0
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c) for c in ("conv_id", "role", "text"))):
            conv_id, role, text = conv_id.as_py(), role.as_py() or "", text.as_py() or ""
            if not begun or conv_id != conv:
                conv, begun, machine, turn = conv_id, True, TurnMachine(template), 0
            valid = machine.step(role)
            out.add(conv, turn, "header", f"{template.start}{escape_role(role)}{template.after_role}", False, valid)
            out.add(conv, turn, "text", escape(text), role in template.loss_roles, valid)
            out.add(conv, turn, "end", template.end + template.after_turn, False, valid and machine.complete)
            turn += 1
            if out.size >= BATCH_BYTES:
                yield out.batch()
    yield out.batch()


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """All turns of a conversation in one partition, one after the other."""
    columns = [F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")]
    return conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chat(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of every conversation; joined in their order they are its formatted text."""
    template = template or Template()
    return sorted_turns(conversations).mapInArrow(lambda it: segment_batches(it, template), SEGMENTS)


class Reader:
    """Reads one formatted conversation back, piece by piece, into roles and texts.

    It looks only at the formatted characters and at the loss mask.
    """

    def __init__(self, template: Template):
        self.template, self.waiting, self.masked = template, "", []
        self.turns, self.all, self.loss = 0, hashlib.sha256(), hashlib.sha256()
        self.loss_chars = self.chars = 0

    def feed(self, segment: str, loss: bool) -> None:
        t = self.template
        self.chars += len(segment)
        if loss:
            plain = unescape(segment)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.waiting += segment
        if not segment.startswith(t.end):  # escaped texts and headers never begin with the end mark
            return
        head, _, rest = self.waiting.removeprefix(t.start).partition(t.after_role)
        text = rest.removesuffix(t.end + t.after_turn)
        self.all.update(f"{unescape_role(head)}\n{unescape(text)}\n".encode())
        self.turns, self.waiting = self.turns + 1, ""


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def read_back_batches(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ_BACK.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    conv, reader, valid, rows = None, None, True, []

    def result():
        r = reader
        return conv, r.turns, r.all.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars, valid

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    for part in batches:
        for conv_id, segment, loss, ok in zip(*(part.column(c).to_pylist() for c in ("conv_id", "segment", "loss", "valid"))):
            if reader is None or conv_id != conv:
                if reader is not None:
                    rows.append(result())
                conv, reader = conv_id, Reader(template)
            reader.feed(segment, loss)
            valid = ok
        if len(rows) >= 10_000:
            yield batch()
            rows.clear()
    if reader is not None:
        rows.append(result())
    yield batch()


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, from the segments of ``format_chat`` in their order.

    ``valid`` says that the turn order held to the end and that it may end there.
    """
    template = template or Template()
    return segments.mapInArrow(lambda it: read_back_batches(it, template), READ_BACK)
