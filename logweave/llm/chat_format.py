"""Operator 5: chat formatting with a grammar round trip.

Grammar of a formatted conversation:

    conversation := turn*
    turn         := "<<SYS>>" body "<</SYS>>"               system
                  | "[INST]" body "[/INST]"                 user
                  | "<s>" body "</s>"                       assistant
                  | "[ROLE]" body "[/ROLE]" body "[END]"    any other role, which is the first body
    body         := characters; a backslash takes the next character as it is, and no control string stands in a body

A turn is rendered as it is, parsed again by a deterministic parser and
compared with its source; where they differ its content is escaped (every
backslash doubled, a backslash after the first character of each control
string) and compared again; at last the whole conversation is parsed and
compared.  The loss mask has the bodies of the assistant's turns.

Conversations are gathered on the JVM side, by one shuffle; one conversation
is one output row, so it is in one task as a whole.

Edge cases: null texts and roles are empty; turns come by (turn, role, text),
null turns first; a null conv_id is a conversation of its own; repeated rows
are repeated turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[END]")
CONTROL = (*(m for pair in MARKS.values() for m in pair), *OTHER)
ANY = "|".join(map(re.escape, CONTROL))
STARTS = re.compile(f"(?=(?:{ANY}))(.)")
BODY = re.compile(rf"(?:[^\\<\[]|\\[\s\S]|(?!{ANY})[<\[])*+")
ROLE_OF = {begin: role for role, (begin, _) in MARKS.items()}

Turn = tuple[str, str]


def escape(text: str) -> str:
    return STARTS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


def _render(role: str, text: str, escaped: bool) -> tuple[str, str, str]:
    """What comes before the body, the body, what comes after it."""
    body = escape(text) if escaped else text
    if role in MARKS:
        return MARKS[role][0], body, MARKS[role][1]
    return OTHER[0] + (escape(role) if escaped else role) + OTHER[1], body, OTHER[2]


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, begin and end of the body) of each turn; None if it isn't a conversation."""
    turns, at = [], 0

    def body(closing: str) -> tuple[str, int, int] | None:
        nonlocal at
        begin, end = at, BODY.match(formatted, at).end()
        if not formatted.startswith(closing, end):
            return None
        at = end + len(closing)
        return unescape(formatted[begin:end]), begin, end

    while at < len(formatted):
        mark = next((m for m in (*ROLE_OF, OTHER[0]) if formatted.startswith(m, at)), None)
        if mark is None:
            return None
        at += len(mark)
        if mark == OTHER[0]:
            named = body(OTHER[1])
            if named is None:
                return None
            role, closing = named[0], OTHER[2]
        else:
            role, closing = ROLE_OF[mark], MARKS[ROLE_OF[mark]][1]
        got = body(closing)
        if got is None:
            return None
        turns.append((role, *got))
    return turns


def _same(formatted: str, turns: list[Turn]) -> bool:
    got = parse(formatted)
    return got is not None and [t[:2] for t in got] == turns


def format_conversation(turns: list[Turn]) -> tuple[str, list[tuple[int, int]], int]:
    """The formatted text, the spans of the loss mask, and how many turns were escaped."""
    parts, spans, at, escaped = [], [], 0, 0
    for role, text in turns:
        rendered = _render(role, text, False)
        if not _same("".join(rendered), [(role, text)]):
            escaped += 1
            rendered = _render(role, text, True)
        before, body, after = rendered
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        at += len(before) + len(body) + len(after)
        parts += rendered
    formatted = "".join(parts)
    if not _same(formatted, turns):
        raise ValueError("a formatted conversation doesn't parse to its turns")
    return formatted, spans, escaped


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (begin and end in code points of each masked body), escaped_turns."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    gathered = (conversations.select("conv_id", F.struct("turn", empty("role"), empty("text")).alias("t"))
                .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                turns = [(t["role"], t["text"]) for t in batch.column("turns")[k].as_py()]
                formatted, spans, escaped = format_conversation(turns)
                yield pa.record_batch([batch.column("conv_id").slice(k, 1), pa.array([formatted]),
                                       pa.array([[{"begin": a, "end": b} for a, b in spans]], SPANS),
                                       pa.array([escaped], pa.int32())], ["conv_id", "formatted", "loss_spans", "escaped_turns"])

    return gathered.mapInArrow(apply, f"conv_id {dict(conversations.dtypes)['conv_id']}, formatted string, "
                               "loss_spans array<struct<begin:int,end:int>>, escaped_turns int")


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def digests(formatted: DataFrame) -> DataFrame:
    """Reads the turns and the masked text back from the formatted text: counts and SHA-256 digests."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"conv_id": batch.column("conv_id").to_pylist(), "n_turns": [], "turns_sha256": [], "loss_chars": [],
                    "loss_sha256": [], "formatted_chars": []}
            for k in range(batch.num_rows):
                text = batch.column("formatted")[k].as_py()
                turns = parse(text)
                masked = "".join(unescape(text[s["begin"]:s["end"]]) for s in batch.column("loss_spans")[k].as_py())
                rows["n_turns"].append(len(turns))
                rows["turns_sha256"].append(hashlib.sha256("".join(f"{t[0]}\n{t[1]}\n" for t in turns).encode()).hexdigest())
                rows["loss_chars"].append(len(masked))
                rows["loss_sha256"].append(hashlib.sha256(masked.encode()).hexdigest())
                rows["formatted_chars"].append(len(text))
            yield pa.record_batch(rows, pa.schema([("conv_id", batch.schema.field("conv_id").type), ("n_turns", pa.int64()),
                                                   ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                                                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        apply, f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long")
