"""Conversations as training text with typed content parts.

Every turn is ``<|turn|>role<|body|>content<|end|>``. A visitor flattens the content parts of a turn
in order: text as it is, an image, audio or document part as a numbered placeholder
(``<|image:0|>``, ...), with the attachment's reference and its expanded token count recorded.
Control strings inside roles and texts are escaped by one more backslash behind their first
character, so ``</s>`` becomes ``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``; unescaping takes one away
again, whatever the text. Neighbouring text parts are joined before they are escaped. The loss mask
covers the text of assistant turns, part by part, without markers and placeholders.

Turns are dealt by conversation, sorted and streamed, and a conversation is put out when the next
begins, so a task holds one conversation at a time beside its batch.

Defined cases: null text, role or part is empty; an unknown part type is an error; turns of equal
number are ordered by role and text, null first, and repeated rows are turns of their own; rows
without a conversation id form one conversation; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,units:double>"
# Tokens that one unit of a part takes: an image tile, a second of audio, a document page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 700}

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_CONTROL = r"/?s>|\|[a-z_]+(?::\d+)?\|>|/?INST\]|/?SYS>>"
_ESCAPE = re.compile(rf"([<\[])(?=\\*(?:{_CONTROL}))")
_UNESCAPE = re.compile(rf"([<\[])\\(?=\\*(?:{_CONTROL}))")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass
class Flattened:
    """What the visitor has gathered of one conversation."""

    unit_tokens: Mapping[str, int]
    pieces: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    turns: int = 0

    def write(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def turn(self, role: str, parts: list[dict]) -> None:
        self.write(TURN + escape(role) + BODY)
        text: list[str] = []
        for part in [*parts, None]:
            kind = None if part is None else part["type"] or "text"
            if kind == "text":
                text.append(part["text"] or "")
                continue
            self.visit_text("".join(text), role == "assistant")
            text = []
            if part is not None:
                self.visit_attachment(kind, part)
        self.write(END)
        self.turns += 1

    def visit_text(self, text: str, learned: bool) -> None:
        start = self.length
        self.write(escape(text))
        if learned and text:
            self.loss.append({"start": start, "end": self.length})

    def visit_attachment(self, kind: str, part: dict) -> None:
        if kind not in self.unit_tokens:
            raise ValueError(f"unknown content part {kind!r}")
        number = len(self.attachments)
        tokens = -int(-(part["units"] or 0) * self.unit_tokens[kind] // 1)
        self.attachments.append(
            {"number": number, "type": kind, "ref": part["ref"], "turn": self.turns, "at": self.length, "tokens": tokens}
        )
        self.write(f"<|{kind}:{number}|>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and contents of a formatted conversation, unescaped; placeholders stay."""
    return [(unescape(role), unescape(body)) for role, body in _TURNS.findall(formatted)]


def read_loss(formatted: str, spans: list[dict]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_ATTACHED = pa.list_(
    pa.struct(
        [("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("turn", pa.int64()), ("at", pa.int64()), ("tokens", pa.int64())]
    )
)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        conv, role, parts = (batch.column(i) for i in range(3))
        for i in range(batch.num_rows):
            yield conv[i].as_py(), role[i].as_py() or "", [p for p in parts[i].as_py() or [] if p is not None]


def _formatted(unit_tokens: Mapping[str, int], kind: pa.DataType) -> Callable:
    def out(conv, done: Flattened) -> pa.RecordBatch:
        columns = [
            pa.array([conv], kind),
            pa.array([done.turns], pa.int64()),
            pa.array(["".join(done.pieces)], pa.string()),
            pa.array([done.loss], _SPANS),
            pa.array([done.attachments], _ATTACHED),
        ]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "formatted", "loss_spans", "attachments"])

    def run(batches):
        now, gathered, ready = None, None, []
        for conv, role, parts in _rows(batches):
            if gathered is None or conv != now:
                if gathered is not None:
                    ready.append(out(now, gathered))
                now, gathered = conv, Flattened(unit_tokens)
                if len(ready) >= 500 or sum(b.nbytes for b in ready[-1:]) > 1 << 20:
                    yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                    ready = []
            gathered.turn(role, parts)
        if gathered is not None:
            ready.append(out(now, gathered))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return run


def format_parts(turns: DataFrame, unit_tokens: Mapping[str, int] = UNIT_TOKENS) -> DataFrame:
    """Format ``conv_id, turn, role, parts`` (an array of ``PART``), one row per conversation:
    ``conv_id, n_turns, formatted, loss_spans, attachments``.
    """
    kind = dict(turns.dtypes)["conv_id"]
    arrow = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    rows = turns.select("conv_id", "role", F.col("parts").cast(f"array<{PART}>").alias("parts"), "turn")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts"))
    return ordered.select("conv_id", "role", "parts").mapInArrow(
        _formatted(dict(unit_tokens), arrow),
        f"conv_id {kind}, n_turns bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, "
        "attachments array<struct<number:bigint,type:string,ref:string,turn:bigint,at:bigint,tokens:bigint>>",
    )


def format_turns(turns: DataFrame) -> DataFrame:
    """Format ``conv_id, turn, role, text``: each turn is one text part."""
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("double").alias("units"),
    )
    return format_parts(turns.select("conv_id", "turn", "role", F.array(part).alias("parts")))
