"""Chat formatting with typed content parts (operator 6).

A message is a list of parts (text, image, audio, document).  A visitor walks them in order: text is
escaped, attachments become numbered placeholders, their references are recorded and the tokens they
will stand for are counted.  Every message becomes one segment::

    <turn:ROLE>text<image:0>more text</turn>\\n

Template strings start with ``<``; in texts ``\\`` and ``<`` get a leading ``\\``, in roles ``>`` too, so
no text can open a turn or a placeholder, and reading back undoes it exactly.  The loss mask covers
the texts of assistant messages.

The formatted output keeps one row per message, so a conversation of any length never becomes one
value.  ``read_back`` streams the segments of a conversation in order through one task with constant
state (a SHA-256 over a conversation is sequential by definition).

Defined results: null text is empty, a null role is the empty role, null conversation ids form one
conversation; equal turns are ordered by role and segment, repeated rows are kept; unknown part types
are treated as documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TYPE = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
SEGMENT_TYPE = (
    "conv_id bigint, turn bigint, segment string, placeholders int, tokens bigint,"
    " attachments array<struct<ordinal:int,type:string,ref:string,tokens:bigint>>"
)
_ATTACHMENT = pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
_SEGMENTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("segment", pa.string()),
        ("placeholders", pa.int32()),
        ("tokens", pa.int64()),
        ("attachments", pa.list_(_ATTACHMENT)),
    ]
)
TILE = 512  # pixels of an image tile
TILE_TOKENS = 170
IMAGE_TOKENS = 85
AUDIO_TOKENS = 25  # per second
PAGE_TOKENS = 300

_ESCAPE = re.compile(r"[\\<]")
_ROLE_ESCAPE = re.compile(r"[\\<>]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_PIECES = re.compile(r"<(?:image|audio|document):[0-9]+>|(?:[^\\<]|\\.)+", re.S)
_HEAD = re.compile(r"<turn:((?:[^\\<>]|\\.)*)>", re.S)
_FOOT = "</turn>\n"


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


class PartVisitor:
    """Flattens the parts of one message; ``count`` gives the tokens of a text."""

    def __init__(self, count):
        self.count, self.out, self.attachments, self.tokens = count, [], [], 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_document)(part)

    def visit_text(self, part):
        text = part.get("text") or ""
        self.tokens += self.count(text)
        self.out.append(escaped(text))

    def visit_image(self, part):
        across = math.ceil((part.get("width") or TILE) / TILE)
        down = math.ceil((part.get("height") or TILE) / TILE)
        self._attach("image", part, IMAGE_TOKENS + TILE_TOKENS * max(1, across * down))

    def visit_audio(self, part):
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS))

    def visit_document(self, part):
        self._attach("document", part, PAGE_TOKENS * max(1, part.get("pages") or 1))

    def _attach(self, kind, part, tokens):
        ordinal = len(self.attachments)
        self.out.append(f"<{kind}:{ordinal}>")
        self.attachments.append({"ordinal": ordinal, "type": kind, "ref": part.get("ref"), "tokens": tokens})
        self.tokens += tokens


def text_parts(text):
    """A plain text column as parts."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            *(F.lit(None).cast(kind).alias(name) for name, kind in empty.items()),
        )
    ).cast(PART_TYPE)


def format_messages(messages: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Segments of ``messages(conv_id, turn, role, parts)``.

    ``tokenizer`` is the path of a tokenizer file for text tokens; without it white-space separated
    words are counted.
    """

    def run(batches):
        if tokenizer:
            from tokenizers import Tokenizer

            encoder = Tokenizer.from_file(tokenizer)
            encoder.encode_special_tokens = True
            count = lambda text: len(encoder.encode(text, add_special_tokens=False).ids)
        else:
            count = lambda text: len(text.split())
        for batch in batches:
            ids, turns, roles, parts = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for conv, turn, role, items in zip(ids, turns, roles, parts, strict=True):
                visitor = PartVisitor(count)
                for part in items or ():
                    visitor.visit(part or {})
                head = _ROLE_ESCAPE.sub(r"\\\g<0>", role or "")
                rows.append(
                    {
                        "conv_id": conv,
                        "turn": turn,
                        "segment": f"<turn:{head}>{''.join(visitor.out)}{_FOOT}",
                        "placeholders": len(visitor.attachments),
                        "tokens": visitor.tokens,
                        "attachments": visitor.attachments,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _SEGMENTS)

    columns = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "parts")
    return columns.mapInArrow(run, SEGMENT_TYPE)


def parse_segment(segment: str) -> tuple[str, str, list[str]]:
    """Role, text and placeholders of a segment."""
    head = _HEAD.match(segment)
    if not head or not segment.endswith(_FOOT):
        raise ValueError("not a formatted turn")
    body = segment[head.end() : len(segment) - len(_FOOT)]
    pieces = _PIECES.findall(body)
    if sum(map(len, pieces)) != len(body):
        raise ValueError("unescaped control string in a turn")
    texts = [unescaped(p) for p in pieces if p[0] != "<"]
    return unescaped(head[1]), "".join(texts), [p for p in pieces if p[0] == "<"]


DIGEST_TYPE = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint, tokens bigint"
)


class _Conversation:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars, self.tokens = conv, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment, tokens):
        role, text, _ = parse_segment(segment)
        self.turns += 1
        self.chars += len(segment)
        self.tokens += tokens
        self.all.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self):
        return (
            self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(),
            self.chars, self.tokens,
        )


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted segments."""

    def run(batches):
        now, names = None, [c.split()[0] for c in DIGEST_TYPE.split(", ")]
        types = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST_TYPE.split(", ")]

        def batch_of(rows):
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            done = []
            for conv, segment, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv)
                now.add(segment, tokens)
            yield batch_of(done)
        if now is not None:
            yield batch_of([now.row()])

    return (
        segments.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "segment")
        .select("conv_id", "segment", "tokens")
        .mapInArrow(run, DIGEST_TYPE)
    )
