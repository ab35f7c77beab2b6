"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio or document. A visitor with one method
for each kind flattens them in order: text is escaped, the others become numbered placeholders whose
attachment (kind, reference, expanded token count) is recorded. Turns stand between markers, and any
control string inside text, as well as the escape character, gets a backslash, so reading back gives
the very same messages; read with the attachments, typed parts come back as well (neighbouring texts as
one). The loss mask is a list of code point spans of the output: what the assistant said, without markers.

Null roles, texts and references are empty, null parts are left out, and sizes that are null, negative or
no number count as the least. A part of unknown kind becomes a placeholder named `other`, whose attachment
keeps the kind and has no tokens. Messages of one turn number are ordered by role and text; an empty
conversation table gives no rows. Whole conversations make one row, as each is one training text. Clashing
extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm.arrow import column
from slotwise.session import ship_package

TURN, END = "<turn:", "</turn>"
_OPEN = re.compile(r"<turn:((?:[^\\>]+|\\.)*)>\n", re.S)
_TO_END = re.compile(r"((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)
#: Control strings: markers of this template, placeholders, and headings that other templates use.
CONTROL = re.compile(r"\\|(?=<turn:|</turn>|<\|(?:image|audio|document|other):|### (?:Assistant|User|System|Human):)")
_PLACE = re.compile(r"((?:[^\\<]+|\\.|<(?!\|(?:image|audio|document|other):\d+\|>))*)(?:<\|(?:image|audio|document|other):(\d+)\|>)?", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\\\" if m.group() else "\\", text)


def _size(x: float | None) -> float:
    """x if it is a finite number above 0, else 0."""
    return x if x is not None and x > 0 and math.isfinite(x) else 0


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of messages and writes the formatted text."""

    image_patch: int = 14
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 512
    train_roles: tuple[str, ...] = ("assistant",)
    out: list[str] = field(default_factory=list)
    at: int = 0
    attachments: list[dict] = field(default_factory=list)
    loss: list[dict] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def message(self, role: str, parts: list[dict]) -> None:
        self.write(f"{TURN}{escape(role).replace('>', chr(92) + '>')}>\n")
        begin = self.at
        for part in parts:
            if part is not None:
                getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)
        if role in self.train_roles:
            self.loss.append({"start": begin, "end": self.at})
        self.write(f"{END}\n")

    def visit_text(self, part: dict) -> None:
        self.write(escape(part.get("text") or ""))

    def attach(self, kind: str, part: dict, tokens: int, name: str | None = None) -> None:
        self.write(f"<|{name or kind}:{len(self.attachments)}|>")
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part.get("ref") or "", "tokens": tokens})

    def visit_image(self, part: dict) -> None:
        p = self.image_patch
        self.attach("image", part, math.ceil((_size(part.get("width")) or p) / p) * math.ceil((_size(part.get("height")) or p) / p))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil(_size(part.get("seconds")) * self.audio_tokens_per_second))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, int(_size(part.get("pages")) or 1) * self.document_tokens_per_page)

    def visit_other(self, part: dict) -> None:
        self.attach(part["type"], part, 0, "other")


def _turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text as it stands) of each turn."""
    at = 0
    while at < len(formatted):
        head = _OPEN.match(formatted, at)
        body = _TO_END.match(formatted, head.end()) if head else None
        if body is None:
            raise ValueError(f"no turn at {at}")
        yield unescape(head.group(1)), body.group(1)
        at = body.end()


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders stay in the text as they are."""
    return [(role, unescape(body)) for role, body in _turns(formatted)]


def read_parts(formatted: str, attachments: list) -> list[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) of each turn: ("text", text), or the kind and reference of an attachment. Escaped text is never taken for a placeholder."""
    out = []
    for role, body in _turns(formatted):
        parts: list[tuple[str, str]] = []
        for m in _PLACE.finditer(body):
            if m.group(1):
                parts.append(("text", unescape(m.group(1))))
            if m.group(2) is not None:
                parts.append((attachments[int(m.group(2))]["kind"], attachments[int(m.group(2))]["ref"]))
        out.append((role, parts))
    return out


_PART = T.StructType([T.StructField(n, t) for n, t in (("type", T.StringType()), ("text", T.StringType()), ("ref", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("seconds", T.DoubleType()), ("pages", T.IntegerType()))])
PARTS = T.ArrayType(_PART)
_LONG = T.LongType()
_SPAN = T.StructType([T.StructField("start", _LONG), T.StructField("end", _LONG)])
_ATTACHMENT = T.StructType([T.StructField("ordinal", _LONG), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("tokens", _LONG)])


def text_part(text: str) -> F.Column:
    """The typed content of a plain text column."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in _PART.fields[2:]])
    return F.array(part).cast(PARTS)


def format_conversations(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Rows conv_id, formatted, attachments, loss (spans of formatted), expanded_tokens of attachments."""
    ship_package(messages.sparkSession)
    c = {n: F.col(f"`{n}`") for n in (conv_id, turn, role, parts)}
    grouped = messages.groupBy(c[conv_id].alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(c[turn].alias("turn"), F.coalesce(c[role], F.lit("")).alias("role"), c[parts].alias("parts")))).alias("m"))
    schema = T.StructType([grouped.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("attachments", T.ArrayType(_ATTACHMENT)), T.StructField("loss", T.ArrayType(_SPAN)), T.StructField("expanded_tokens", _LONG)])
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in range(4)]
            for listed in column(batch, "m"):
                f = Flattener()
                for m in listed.as_py():
                    f.message(m["role"], m["parts"] or [])
                for to, x in zip(made, ("".join(f.out), f.attachments, f.loss, sum(a["tokens"] for a in f.attachments)), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([column(batch, "conv_id"), *[pa.array(x, t) for x, t in zip(made, types[1:], strict=True)]], names=schema.names)

    return grouped.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Rows conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from formatted."""
    source = formatted.select("conv_id", "formatted", "loss")
    schema = T.StructType([source.schema["conv_id"], T.StructField("n_turns", _LONG), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", _LONG), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", _LONG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in range(5)]
            for text, loss in zip(column(batch, "formatted").to_pylist(), column(batch, "loss").to_pylist(), strict=True):
                turns = read_back(text)
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest()
                for to, x in zip(made, (len(turns), whole, len(said), hashlib.sha256(said.encode("utf-8")).hexdigest(), len(text)), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([column(batch, "conv_id"), *[pa.array(x, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for x, f in zip(made, schema.fields[1:], strict=True)]], names=schema.names)

    return source.mapInArrow(run, schema)
