"""Chat formatting of messages with typed content parts.

A visitor flattens the parts of each message in order: text is escaped, every attachment becomes a numbered placeholder and
is recorded with its reference and the number of tokens it expands to. The template marks turns; control strings inside
texts and roles are escaped so that reading the output gives back what went in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<ordinal:int,type:string,ref:string,tokens:bigint>"


def escape(text: Column) -> Column:
    """Put one backslash more between ``<`` and ``|``; no control string can begin inside the result."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    """As :func:`escape`, and a line break, which ends the role in the template, is written as ``\\n``."""
    one_line = F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n")
    return escape(one_line)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class PartVisitor:
    """How each type of part is counted; text parts are written out, all others leave a placeholder.

    Unknown types leave a placeholder that expands to no tokens. A part without type is text.
    """

    patch: int = 14
    audio_tokens_per_second: float = 12.5
    tokens_per_page: int = 512
    extra: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def tokens(self, part: Column) -> Column:
        counts = {
            "image": F.ceil(part["width"] / self.patch) * F.ceil(part["height"] / self.patch),
            "audio": F.ceil(part["seconds"] * self.audio_tokens_per_second),
            "document": part["pages"].cast("bigint") * self.tokens_per_page,
            **{kind: rule(part) for kind, rule in self.extra.items()},
        }
        value = F.lit(0).cast("bigint")
        for kind, count in counts.items():
            value = F.when(part["type"] == kind, count.cast("bigint")).otherwise(value)
        return F.coalesce(value, F.lit(0).cast("bigint"))

    def is_text(self, part: Column) -> Column:
        return part.isNotNull() & F.coalesce(part["type"] == "text", F.lit(True))

    def attachments(self, parts: Column) -> Column:
        """The attachments in order, numbered from 0 within the message."""
        kept = F.filter(parts, lambda p: p.isNotNull() & ~self.is_text(p))
        return F.transform(
            kept, lambda p, i: F.struct(i.alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), self.tokens(p).alias("tokens")),
        ).cast(f"array<{ATTACHMENT}>")

    def flatten(self, parts: Column) -> Column:
        """The parts as one text; a placeholder names the number of its attachment."""
        kept = F.filter(parts, lambda p: p.isNotNull())

        def visit(part: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(kept, F.lit(1), i), lambda p: ~self.is_text(p)))
            kind = F.regexp_replace(F.coalesce(part["type"], F.lit("")), "[^A-Za-z0-9_-]", "_")
            return F.when(self.is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<|"), kind, F.lit(":"), before.cast("string"), F.lit("|>"))
            )

        return F.array_join(F.transform(kept, visit), "")


def text_part(text: Column) -> Column:
    """One text part, as messages without typed parts have it."""
    fields = {"type": F.lit("text"), "text": F.coalesce(text.cast("string"), F.lit(""))}
    names = ("type", "text", "ref", "width", "height", "seconds", "pages")
    return F.array(F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(PART))


def format_messages(
    messages: DataFrame, parts: Column, role: str = "role", learn_from: str = "assistant", visitor: PartVisitor | None = None,
) -> DataFrame:
    """Add ``formatted``, ``loss_start``, ``loss_length``, ``attachments`` and ``expanded_tokens`` to each message.

    The formatted conversation is the concatenation of its messages by turn. The loss mask of a message is a span of code
    points of ``formatted``: the content of messages whose role is ``learn_from``, nothing of the others. Null parts or
    roles count as empty; other columns stay. Every message is a row, so no conversation has to fit into one value.
    """
    visitor = visitor or PartVisitor()
    given = F.coalesce(F.col(role).cast("string"), F.lit(""))
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    head = F.concat(F.lit(TURN_START), escape_role(given), F.lit("\n"))
    content = visitor.flatten(parts)
    learned = given == learn_from
    return messages.withColumns({
        "formatted": F.concat(head, content, F.lit(TURN_END + "\n")),
        "loss_start": F.when(learned, F.length(head)).cast("bigint"),
        "loss_length": F.when(learned, F.length(content)).otherwise(0).cast("bigint"),
        "attachments": visitor.attachments(parts),
        "expanded_tokens": F.aggregate(visitor.attachments(parts), F.lit(0).cast("bigint"), lambda total, a: total + a["tokens"]),
    })


_MESSAGE = re.compile(re.escape(TURN_START) + r"(.*?)\n(.*)" + re.escape(TURN_END) + "\n", re.DOTALL)


def parse_message(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted message."""
    found = _MESSAGE.fullmatch(formatted)
    if found is None:
        raise ValueError("not a formatted message")
    return unescape_role(found[1]), unescape(found[2])


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Conversation:
    """Running digests of one conversation, whatever its length."""

    def __init__(self, key):
        self.key, self.turns, self.loss_chars, self.chars = key, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, length: int) -> None:
        role, text = parse_message(formatted)
        self.turns += 1
        self.chars += len(formatted)
        self.turns_sha.update(f"{role}\n{text}\n".encode())
        if start is not None:
            masked = unescape(formatted[start : start + length])
            self.loss_chars += len(masked)
            self.loss_sha.update(masked.encode())

    def row(self) -> tuple:
        return self.key, self.turns, self.turns_sha.hexdigest(), self.loss_chars, self.loss_sha.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Read formatted messages back: per conversation its turns, loss text and length, as counts and SHA-256 digests.

    Rows go by turn, equal turns by their formatted text; a null turn comes first; rows without a key form one conversation.
    A digest is sequential, so a conversation is read by one task, row by row, with a fixed amount of memory.
    """
    key_type = formatted.schema[key].dataType.simpleString()
    rows = formatted.select(key, turn, "formatted", "loss_start", "loss_length")
    ordered = rows.repartition(key).sortWithinPartitions(key, turn, "formatted")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, done = None, []

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types: list[pa.DataType] = []
        for batch in batches:
            if not types:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = (batch.column(i).to_pylist() for i in (0, 2, 3, 4))
            for conv, text, start, length in zip(*columns, strict=True):
                if current is None or conv != current.key:
                    if current is not None:
                        done.append(current.row())
                    current = _Conversation(conv)
                current.add(text, start, length)
                if len(done) >= 5000:
                    yield flush()
        if current is not None:
            done.append(current.row())
            yield flush()

    return ordered.mapInArrow(digest, f"{key} {key_type}, {DIGEST}")
