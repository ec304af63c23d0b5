r"""Chat formatting with typed content parts.

A visitor flattens a turn's parts (text, image, audio, document) into one text with ordered
placeholders and records for each placeholder its attachment's reference and how many tokens it
expands to. The template marks turns:

    user        [INST]text[/INST]
    assistant   <s>text</s>
    any other   [TURN]role[TEXT]text[/TURN]

Control strings inside texts and roles get a backslash after their first character, and one more if
they have some already, so reading takes exactly one off and any text comes back unchanged. The loss
mask covers assistants' texts.

A formatted table has a row for each turn; a conversation is its rows' concatenation by position. It
is written that way so that formatting needs no shuffle, and reading streams through a conversation of
any length with a few hash states. Digests are sequential by nature: one conversation's digest is one
task's work, in bounded memory.

Edge cases: null text and null role are empty; null conv_ids are one conversation, null turns come
first; rows with equal turns are ordered by role and text, repeated rows all stay; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import common

_CONTROL = r"/?s>|\|[a-z]{1,16}:\d{1,9}\|>|/?INST\]|/?TURN\]|TEXT\]"
_PLAIN = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_QUOTED = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
_MARK = re.compile(r"</?s>|\[/?INST\]|\[/?TURN\]|\[TEXT\]")
_PLACE = re.compile(r"<\|([a-z]{1,16}):(\d{1,9})\|>")
#: What ends a turn that begins so.
_ENDS = {"[INST]": "[/INST]", "<s>": "</s>", "[TURN]": "[/TURN]"}


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _QUOTED.sub(r"\1\2\3", text)


@dataclass
class Attachment:
    kind: str
    ref: str
    tokens: int


@dataclass
class Flattened:
    text: str = ""
    attachments: list[Attachment] = field(default_factory=list)


class Flattener:
    """Visits content parts in order. A part is a string or a dict with a type.

    {"type": "text", "text"}; {"type": "image", "ref", "width", "height"}: a token for each patch of
    `patch` pixels square; {"type": "audio", "ref", "seconds"}: `rate` tokens a second;
    {"type": "document", "ref", "parts"}: a placeholder, then its parts, as often nested as need be;
    its tokens are its marker alone, as its parts count for themselves.
    """

    def __init__(self, patch: int = 14, rate: float = 25.0):
        self.patch, self.rate = patch, rate

    def flatten(self, content: Any) -> Flattened:
        out = Flattened()
        pieces: list[str] = []
        self._visit(content, out, pieces)
        out.text = "".join(pieces)
        return out

    def _visit(self, part: Any, out: Flattened, pieces: list[str]) -> None:
        if part is None:
            return
        if isinstance(part, str):
            part = {"type": "text", "text": part}
        if isinstance(part, (list, tuple)):
            for x in part:
                self._visit(x, out, pieces)
            return
        visit = getattr(self, f"visit_{part.get('type')}", None)
        if visit is None:
            raise ValueError(f"no content part of type {part.get('type')!r}")
        visit(part, out, pieces)

    def _place(self, kind: str, part: dict, tokens: int, out: Flattened, pieces: list[str]) -> None:
        pieces.append(f"<|{kind}:{len(out.attachments)}|>")
        out.attachments.append(Attachment(kind, part.get("ref") or "", tokens))

    def visit_text(self, part: dict, out: Flattened, pieces: list[str]) -> None:
        pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict, out: Flattened, pieces: list[str]) -> None:
        across, down = (math.ceil((part.get(k) or 0) / self.patch) for k in ("width", "height"))
        self._place("image", part, max(1, across * down), out, pieces)

    def visit_audio(self, part: dict, out: Flattened, pieces: list[str]) -> None:
        self._place("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.rate)), out, pieces)

    def visit_document(self, part: dict, out: Flattened, pieces: list[str]) -> None:
        self._place("document", part, 1, out, pieces)
        self._visit(part.get("parts"), out, pieces)


def format_turn(role: str | None, content: Any, flattener: Flattener | None = None) -> tuple[str, tuple[int, int] | None, list[Attachment]]:
    """The formatted turn, the span of it under the loss mask (assistants only), its attachments."""
    flat = (flattener or Flattener()).flatten(content)
    role = role or ""
    if role == "user":
        return f"[INST]{flat.text}[/INST]", None, flat.attachments
    if role == "assistant":
        return f"<s>{flat.text}</s>", (3, 3 + len(flat.text)), flat.attachments
    return f"[TURN]{escape(role)}[TEXT]{flat.text}[/TURN]", None, flat.attachments


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; placeholders stay as they are in the text."""
    at = 0
    while at < len(formatted):
        start = _MARK.match(formatted, at)
        if start is None or start[0] not in _ENDS:
            raise ValueError(f"no turn begins at {at}")
        middle = None
        for mark in _MARK.finditer(formatted, start.end()):
            if mark[0] == "[TEXT]" and start[0] == "[TURN]" and middle is None:
                middle = mark
            elif mark[0] == _ENDS[start[0]]:
                break
            else:
                raise ValueError(f"{mark[0]} at {mark.start()} within a turn")
        else:
            raise ValueError(f"the turn at {at} has no end")
        body = unescape(formatted[(middle or start).end() : mark.start()])
        if start[0] == "[TURN]":
            if middle is None:
                raise ValueError(f"the turn at {at} has no role")
            yield unescape(formatted[start.end() : middle.start()]), body
        else:
            yield "user" if start[0] == "[INST]" else "assistant", body
        at = mark.end()


FORMATTED = "conv_id long, turn long, role string, formatted string, mask_start int, mask_end int, attachments array<struct<kind:string,ref:string,tokens:int>>"


def format_turns(turns: DataFrame, content: str = "text") -> DataFrame:
    """A FORMATTED row for each row of turns (conv_id, turn, role, content); no shuffle.

    content: a column of text, or of arrays of structs with type, text, ref, width, height, seconds.
    """
    d = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flattener = Flattener()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
        for b in batches:
            done = [format_turn(r, c, flattener) for r, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            spans = [x[1] or (None, None) for x in done]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([x[0] for x in done], pa.string()), pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32())]
                + [pa.array([[vars(a) for a in x[2]] for x in done], kind)],
                ["conv_id", "turn", "role", "formatted", "mask_start", "mask_end", "attachments"],
            )

    return common.map_arrow(d, run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        if start is not None:
            text = unescape(formatted[start:end])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """A DIGEST row for each conversation, parsed back from FORMATTED rows."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for b in batches:
            for conv, text, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_start", "mask_end")), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        done.append(state.row(now))
                    now, state = conv, _Digest()
                state.add(text, start, end)
            if len(done) >= 1000:
                yield batch(done)
                done = []
        if state is not None:
            yield batch([*done, state.row(now)])

    d = formatted.select("conv_id", "turn", "role", "formatted", "mask_start", "mask_end")
    # rows of one turn and role go by their texts, as they were before control strings were escaped
    d = d.withColumn("plain", F.regexp_replace("formatted", _QUOTED.pattern, "$1$2$3"))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "plain").drop("plain")
    return common.map_arrow(d, run, DIGEST)


def round_trip(turns: DataFrame) -> DataFrame:
    """Formats turns (conv_id, turn, role, text), writes them, and reads digests back from what was written."""
    return digests(common.stored(format_turns(turns), "formatted"))
